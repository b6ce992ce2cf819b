"""Operators for large training corpora. Nothing outside this subpackage imports it."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("token_counts", "simple8b", "warc", "language_id", "mixing", "quality", "toxicity", "ngram_jaccard", "hmm_scoring", "decontamination", "hard_negatives", "merkle", "secrets")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in import_module(f"tessel.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in import_module(f"tessel.llm.{m}").ORACLE.items()}
