"""Hard negatives against brute force: ties, odd vectors, repeated rows, long scores, empty tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import hard_negatives as op
from tessel.operators import tiles

SCHEMA = "id long, v array<double>, label int, anchor string, score int"


def brute(rows, is_anchor, n=5, k=5):
    good = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if None not in (i, v, y) and None not in v and all(map(math.isfinite, v))]
    dot = lambda a, b: max(-(2**63) + 2, min(2**63 - 2, sum(x * y for x, y in zip(a, b))))
    out = []
    for a, av, ay in good:
        if is_anchor(a):
            others = sorted((-dot(av, v), i, y) for i, v, y in good if i != a)
            for s, p, _ in [x for x in others if x[2] == ay][:n]:
                found = [(-z, i) for z, i, y in others if y != ay and 80 * -s <= 100 * -z <= 100 * -s][:k]
                out += [(a, p, r + 1, i, -s, z) for r, (z, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    return sorted(map(tuple, op.hard_negatives(df, F.col("id") % 10 == 0, **how).collect()))


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 1)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 4], int(r.integers(0, 3))) for i in range(400)]
    rows += [(1000, None, 1), (1010, [1.0, None, 0.5, 0.0], 1), (1020, [0.5, float("nan"), 0.0, 0.0], 1), (1030, [float("inf")] * 4, 2), (1040, [1.0, 1.0, 0.0, 0.0], None), (None, [1.0] * 4, 1)]
    rows += [(1050, [], 1), (1060, [0.75], 1), (1061, [0.5, 0.25, 0.5, 0.5, 0.9], 0), (-10, [0.5, 0.5, 0.0, 0.0], 2), rows[20], rows[25], rows[25]]
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and len(want) > 500
    assert run(spark, rows, positives=2, negatives=1) == brute(rows, lambda i: i % 10 == 0, 2, 1)


def test_scores_beyond_doubles(spark):
    big = float(2**30)
    rows = [(0, [big, 1.0], 1), (1, [big, 1.0], 1), (2, [big, 0.5], 2), (3, [big - 1, 0.0], 3), (4, [1e30, 0.0], 1), (5, [1e30, 0.0], 2), (6, [-1e30, 3.0], 2)]
    want = brute(rows, lambda i: i % 10 == 0)
    assert run(spark, rows) == want and any(x[4] > 2**60 for x in want)


def test_labels_of_texts_and_empty_tables(spark):
    rows = spark.createDataFrame([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.9], "ç"), (3, [0.1], "b")], "id int, v array<float>, label string")
    assert [tuple(x) for x in op.hard_negatives(rows, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 256 * 230)]
    for none in (rows.limit(0), rows.where("label = 'b'"), rows.where("id > 0")):
        assert not op.hard_negatives(none, F.col("id") == 0).count()


def test_query_makes_labels(spark, tmp_path):
    rows = [(0, [0.5, 0.5], 0), (7, [0.5, 0.5], 0), (8, [0.5, 0.5], 1), (9, [0.5, 0.4], 9), (14, [0.5, 0.5], 9)]
    spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, id string").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, op.op11_hard_negatives(spark, str(tmp_path)).collect()))
    changed = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    assert got == brute(changed, lambda i: i % 100 == 0) and {x[1] for x in got} == {7, 8}
