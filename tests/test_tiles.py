"""Tiled joins of vectors against brute force: keys of any type, bands, medians, vectors without a score."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import tiles
from tessel.plans import vectors


def _rows(kind, n=150):
    r = np.random.default_rng(0)
    v = r.normal(size=(6, 8))[r.integers(0, 6, n)] + 0.15 * r.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    key = (lambda i: i) if kind == "long" else (lambda i: f"fam-{i}")
    odd = [None, [1.0, 2.0], [None] * 8, [1.0] * 9, [float("nan")] * 8]
    return [(key(i), [float(x) for x in v[i]]) for i in range(n)], [(key(n + i), x) for i, x in enumerate(odd)] + [(None, [1.0] * 8)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_band_and_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(tiles, "HELD", 2)
    good, odd = _rows(kind)
    df = spark.createDataFrame(good + odd, f"id {kind}, v array<double>").withColumn("a", F.lit("clashing")).repartition(5)
    want = {tuple(sorted((i, j))): round(float(np.dot(a, b)), 6) for (i, a), (j, b) in itertools.combinations(good, 2)}
    band = {k: z for k, z in want.items() if 0.8 <= z < 0.97}
    got = {(x["a"], x["b"]): x["score"] for x in tiles.pairs(df, 0.8, 0.97, 6, 8, 20).collect()}
    assert got == pytest.approx(band) and band
    every = tiles.pairs(df, digits=6, tile_rows=20).collect()
    n = len(good) + len(odd) - 1
    assert len(every) == len({(x["a"], x["b"]) for x in every}) == n * (n - 1) // 2 and all(x["a"] < x["b"] for x in every)
    assert {(x["a"], x["b"]): x["score"] for x in every if (x["a"], x["b"]) in want} == pytest.approx(want)


@pytest.mark.parametrize("least, most", [(0.5, None), (-2.0, -0.5), (3.0, 9.0)])
def test_bounds_hold_for_any_lengths(spark, least, most):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(120, 3)) * r.exponential(1, (120, 1)))] + [(500, [0.0, 0.0, 0.0]), (501, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(3)
    v = {i: np.float32(x).astype(float) for i, x in rows}
    want = {(i, j) for i, j in itertools.combinations(v, 2) if least <= tiles.rounded(np.array(v[i] @ v[j]), 6) and (most is None or tiles.rounded(np.array(v[i] @ v[j]), 6) < most)}
    assert {(x["a"], x["b"]) for x in tiles.pairs(df, least, most, 6, 6, 16).collect()} == want and want


def test_text_keys_repeated_rows_and_ties(spark):
    rows = [("b", [1.0, 0.0], "x"), ("a", [1.0, 0.0], "x"), ("a", [1.0, 0.0], "x"), ("ç", [0.0, 1.0], None), ("c", [0.6, 0.8], "y"), (None, [1.0, 0.0], "x")]
    df = spark.createDataFrame(rows, "id string, v array<float>, label string").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("q", [0.0, 1.0]), (None, [1.0, 1.0])], "request string, q array<float>")
    got = [(x["request"], x["rank"], x["id"], x["label"]) for x in tiles.nearest(df, asked, 3, own=False, tile_rows=2).orderBy("request", "rank").collect()]
    assert got == [("a", 1, "b", "x"), ("a", 2, "c", "y"), ("a", 3, "ç", None), ("q", 1, "ç", None), ("q", 2, "c", "y"), ("q", 3, "a", "x")]
    labels = [(x["request"], x["rank"], x["label"]) for x in tiles.nearest(df, asked, 3, by_label=True, tile_rows=2).orderBy("request", "rank").collect()]
    assert labels == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, None), ("q", 1, None), ("q", 2, "y"), ("q", 3, "x")]
    with pytest.raises(ValueError):
        tiles.nearest(df, asked, 0)
    with pytest.raises(ValueError):
        tiles.nearest(df, asked.selectExpr("1 AS request", "q"), 3)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id string, v array<float>, label int")
    assert not tiles.pairs(e, 0.8).count() and not tiles.pairs(e).count() and not tiles.nearest(e, e.selectExpr("id AS request", "v AS q"), 3).count()


def test_median_of_buckets(spark):
    r = np.random.default_rng(2)
    rows = [(g, float(x)) for g, n in (("odd", 101), ("even", 100), ("one", 1)) for x in np.round(r.uniform(-1.5, 1.5, n), 2)] + [("odd", None), ("none", None), (None, 0.25), (None, 0.75), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {x["g"]: x for x in tiles.measures(df, "g", "x", bins=7).collect()}
    for g in ("odd", "even", "one", "none", None):
        own = [x for h, x in rows if h == g]
        x = [v for v in own if v is not None and v == v]
        assert got[g]["n"] == len(own)
        assert [got[g][c] for c in ("low", "high", "median")] == [f(x) if x else None for f in (min, max, np.median)] and got[g]["mean"] == (pytest.approx(np.mean(x)) if x else None)
    assert len(got) == 5 and not tiles.measures(df.limit(0), "g", "x").count()


def test_known_pairs(spark):
    fam = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "family string, v array<double>")
    known = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "zz")], "a string, b string")
    got = {(x["a"], x["b"]): (x["score"], x["largest"]) for x in vectors.pair_scores(fam, known).collect()}
    assert got == {("a", "b"): (0.6, 0.8), ("c", "b"): (0.8, 0.8), ("a", "zz"): (None, 0.8)}
