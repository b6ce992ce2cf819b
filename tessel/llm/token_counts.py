"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings agree.

Texts of up to ``chunk`` characters are counted at once. A longer text is encoded in chunks that overlap; in the overlap of two
neighbours a boundary is looked for that is proven stable: white space stands before it (the tokenizer's pretokens never hold
white space, and no normalisation reaches across it), and from it on both encodings have equal tokens at equal places up to the
last token that the left chunk surely ends. The left chunk's tokens before the boundary and the right chunk's from it on are
joined. If no such boundary is found the overlap is widened, at worst to the whole left chunk.

Shorter texts are cut at ASCII white space alone, which the tokenizer always drops; what else it takes for white space it cuts at itself. Each
distinct word of a batch is encoded once.

Nulls count as empty texts: 0 bytes, 0 tokens. Rows that repeat are counted each. An empty table gives no rows. Extra columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessel.llm import _bpe
from tessel.llm._store import table

TOKENIZER = "word_bpe_49k.json"
LIMIT, CHUNK, OVERLAP = 2048, 32768, 512


def _encode(tokenizer, text: str, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    e = tokenizer.encode(text[begin:end], add_special_tokens=False)
    starts = np.fromiter((a for a, _ in e.offsets), np.int64, len(e)) + begin
    return np.array(e.ids, np.int64), starts


def _boundary(text: str, left: tuple, right: tuple, begin: int, end: int) -> int | None:
    """The first stable boundary of the overlap [begin, end) that leaves a whole agreeing word behind it."""
    stop = end
    while stop > begin and not text[stop - 1].isspace():
        stop -= 1  # the left chunk may have cut the word after this place
    for p in range(begin + 1, stop):
        if text[p - 1].isspace() and not text[p].isspace():
            i, j = np.searchsorted(left[1], p), np.searchsorted(right[1], p)
            k, m = np.searchsorted(left[1], stop), np.searchsorted(right[1], stop)
            if k > i and np.array_equal(left[0][i:k], right[0][j:m]) and np.array_equal(left[1][i:k], right[1][j:m]):
                return p
    return None


def encode_long(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """Ids of a text of any length, never encoding much more than ``chunk`` characters at once if it has white space."""
    parts: list[np.ndarray] = []
    begin, end = 0, min(chunk, len(text))
    left, since = _encode(tokenizer, text, begin, end), 0
    while end < len(text):
        wide = overlap
        while True:
            at = max(begin, end - wide)
            to = min(len(text), at + chunk + wide)
            right = _encode(tokenizer, text, at, to)
            if at == begin:
                p = begin  # the right chunk holds the whole left one
                break
            p = _boundary(text, left, right, at, end)
            if p is not None:
                break
            wide *= 2
        a, b = np.searchsorted(left[1], since), np.searchsorted(left[1], max(p, since))
        parts.append(left[0][a:b])
        left, since, begin, end = right, max(p, since), at, to
    parts.append(left[0][np.searchsorted(left[1], since) :])
    return np.concatenate(parts)


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit and n_chunks_spliced (boolean: counted by chunks) of each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _bpe.lower_case(tokenizer_path)
        for batch in batches:
            for part in _bpe.slices(batch, 1):
                texts = part.column(1).cast(pa.large_string()).fill_null("")
                huge = pc.greater(pc.utf8_length(texts), chunk)
                _, _, size, own, off = _bpe.coded(pc.ascii_split_whitespace(pc.if_else(huge, "", texts)), words)
                upto = np.concatenate([[0], np.cumsum(size[own], dtype=np.int64)])
                n = np.diff(upto[off])
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)).tolist():
                    n[i] = len(encode_long(words.t, texts[i].as_py(), chunk, overlap))
                yield pa.record_batch(
                    {
                        "k": part.column(0),
                        "n_bytes": pc.binary_length(texts),
                        "n_tokens": pa.array(n),
                        "over_limit": pa.array(n > limit),
                        "spliced": huge,
                    }
                )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(count, f"k {kind}, n_bytes long, n_tokens long, over_limit boolean, spliced boolean")
    return out.withColumnRenamed("k", key)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE: dict[str, str] = {}
