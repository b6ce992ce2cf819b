"""The vector index against all vectors: recall, dimensions, changes, cells read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators.tiles import nearest
from tessel.sources.tables import Tables
from tessel.sources.vector_index import VectorIndex


@pytest.fixture
def made(spark, tmp_path):
    r = np.random.default_rng(1)
    v = r.normal(size=(25, 16))[r.integers(0, 25, 600)] + 0.3 * r.normal(size=(600, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = spark.createDataFrame([(f"c{i}", [float(x) for x in v[i]], f"f{i % 7}") for i in range(600)], "id string, v array<float>, family string").repartition(3)
    index = VectorIndex(Tables(spark, str(tmp_path / "db")), "chunks")
    assert index.create(rows, 16, 12) and not index.create(rows, 16, 12)
    index.add(rows)
    asked = rows.where("CAST(substring(id, 2) AS INT) % 20 = 0").select(F.col("id").alias("request"), F.col("v").alias("q"))
    return index, rows, asked


def hits(df):
    return {(x["request"], x["rank"]): (x["id"], x["score"]) for x in df.collect()}


def test_recall_and_exact_mode(made):
    index, rows, asked = made
    want = hits(nearest(rows.withColumn("label", F.lit(0)), asked, 10))
    assert hits(index.search(asked, 10)) == want == hits(index.search(asked, 10, probes=12))
    got = hits(index.search(asked, 10, probes=3))
    found = {(q, i) for (q, _), (i, _) in got.items()} & {(q, i) for (q, _), (i, _) in want.items()}
    assert len(found) / len(want) >= 0.9 and index.count() == 600
    one = asked.limit(1)
    assert len({f.rsplit("/", 2)[-2] for f in index.probed(one, 3).inputFiles()}) == 3


def test_changes(spark, made):
    index, rows, asked = made
    moved = spark.createDataFrame([("c0", [0.0] * 15 + [1.0], "moved"), ("new", [0.0] * 14 + [0.6, 0.8], "new")], rows.schema)
    index.add(moved)
    q = spark.createDataFrame([("q", [0.0] * 15 + [1.0])], "request string, q array<float>")
    assert index.count() == 601 and [x["id"] for x in index.search(q, 1, 2).collect()] == ["c0"]
    index.delete(spark.createDataFrame([("c0",), ("unknown",)], "id string"))
    assert index.count() == 600 and [x["id"] for x in index.search(q, 1, 2).collect()] == ["new"]
    for bad in ([("x", [1.0])], [("x", None)], [("x", [None] * 16)], [(None, [0.5] * 16)], [("x", [0.5] * 16), ("x", [0.5] * 16)]):
        with pytest.raises(ValueError):
            index.add(spark.createDataFrame([(*b, "f") for b in bad], rows.schema))
    with pytest.raises(ValueError):
        index.search(spark.createDataFrame([("q", [1.0])], "request string, q array<float>"), 1)
    with pytest.raises(ValueError):
        index.create(rows.select("id", F.slice("v", 1, 3).alias("v"), "family"), 3, 4)
    assert index.count() == 600
    index.drop()
    index.drop()
    index.delete(asked.select(F.col("request").alias("id")))
    assert not index.exists() and not index.count() and not index.search(asked, 3, 2).count()
