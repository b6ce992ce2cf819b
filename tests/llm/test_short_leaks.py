"""Verbatim copies of short items of ordinary words, whatever stands around them and however many texts there are."""

import math

import numpy as np
import pytest

from tessel.llm import decontamination
from tessel.llm._store import Workspace


@pytest.mark.parametrize(("texts", "share"), [(2000, 0.1), (20000, 0.1), (20000, 0.02)])
def test_short_items_of_ordinary_words(spark, texts, share):
    r = np.random.default_rng(11)
    ordinary = [f"o{i}" for i in range(round(8 / share))]
    rows = []
    for i in range(texts):
        w = [f"u{i}x{j}" for j in range(60)]
        for x in r.choice(ordinary, 8, replace=False):
            w.insert(int(r.integers(0, len(w) + 1)), x)
        rows.append(w)
    items, planted = [], set()
    for n in (3, 5, 6, 8, 10, 12, 20):
        for _ in range(6):
            q = len(items)
            items.append(list(r.choice(ordinary, n, replace=False)))
            at = int(r.integers(0, 61))
            rows[40 * q][at:at] = items[q]
            planted.add((40 * q, q))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["lcs_share"] for x in decontamination.leaks(spark, d, b, Workspace(spark, "t")).collect()}
    assert planted <= set(got) and min(got[p] for p in planted) == 1.0
    for i, q in set(got) - planted:  # the rest hold most of an item by chance
        n, words = len(items[q]), rows[i]
        stretches = [words[a : a + math.ceil(1.25 * n)] for a in range(len(words))]
        assert max(len(set(items[q]) & set(s)) for s in stretches) >= decontamination.LIKELY * n


def test_short_items_at_ends_marks_and_repeated_words(spark):
    rows = [(0, "one two three four"), (1, "x " * 3000 + "One, two; THREE four."), (2, "four three two one " * 20), (3, None), (4, ""), (5, "two"), (6, "la la la land"), (7, "one two"), (8, "three four")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four"), (2, "la la la land"), (3, ""), (4, None)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(spark, d.unionByName(d), b, Workspace(spark, "t")).collect()}
    assert got == {(0, 1), (1, 1), (6, 2)}
