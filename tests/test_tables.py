"""Tables that jobs change together, logs with numbers, stored searches."""

import pytest
from pyspark.sql import functions as F

from tessel.sources.tables import DELETE, Conflict, Executions, Log, Tables


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "db"))


def frame(spark, rows, schema="k string, n int"):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_jobs_hold_together_or_not_at_all(spark, tables):
    with tables.job() as job:
        job.create("a", "k string, n int", ["k"], 4)
        job.create("log", "k string, n int")
        job.merge("a", frame(spark, [("x", 1), ("y", 2), (None, 3)]))
        job.append("log", frame(spark, [("x", 1)]))
    assert rows(tables.read("a")) == [("x", 1), ("y", 2), (None, 3)] and tables.version() == 1 and tables.names() == ["a", "log"]

    class Died(Exception):
        pass

    with pytest.raises(Died), tables.job() as job:  # between two tables
        job.merge("a", frame(spark, [("x", 100)]))
        raise Died
    assert rows(tables.read("a")) == [("x", 1), ("y", 2), (None, 3)] and tables.version() == 1
    with tables.job() as job:
        job.merge("a", frame(spark, [("x", 10), (None, 30), ("z", 4)]).withColumn("more", F.lit(1)))
        assert rows(job.read("a")) == [("x", 10), ("y", 2), ("z", 4), (None, 30)] and rows(tables.read("a")) == [("x", 1), ("y", 2), (None, 3)]
        job.append("log", frame(spark, [("x", 10), ("x", 10)]))
        job.delete("a", frame(spark, [("y",), ("unknown",)], "k string"))
    assert rows(tables.read("a")) == [("x", 10), ("z", 4), (None, 30)] and rows(tables.read("log")) == [("x", 1), ("x", 10), ("x", 10)]
    assert rows(tables.read("a", 1)) == [("x", 1), ("y", 2), (None, 3)]
    assert rows(tables.get("a", {"k": "z"})) == [("z", 4)] and rows(tables.get("a", {"k": None})) == [(None, 30)] and rows(tables.get("a", {"k": "y"})) == []
    with pytest.raises(KeyError):
        tables.read("b")
    with pytest.raises(ValueError), tables.job() as job:
        job.create("a", "k string, m int", ["k"], 4)


def test_a_driver_that_is_gone_leaves_the_old_state(spark, tables):
    with tables.job() as job:
        job.create("a", "k string, n int", ["k"], 4)
        job.create("b", "k string, n int", ["k"], 4)
        job.put("a", frame(spark, [("x", 1)]))
    job = tables.job().__enter__()  # never ends
    job.merge("a", frame(spark, [("x", 2)]))
    job.merge("b", frame(spark, [("x", 2)]))
    again = Tables(spark, tables.path)
    assert rows(again.read("a")) == [("x", 1)] and rows(again.read("b")) == []
    assert again.sweep() == 0 and again.sweep(older_than_s=0) == 2 and rows(again.read("a")) == [("x", 1)]


def test_jobs_at_once(spark, tables):
    with tables.job() as job:
        job.create("a", "k string, n int", ["k"], 4)
        job.create("b", "k string, n int", ["k"], 4)
        job.create("log", "k string, n int")
    with tables.job() as late:
        late.append("log", frame(spark, [("late", 1)]))
        late.merge("b", frame(spark, [("b", 1)]))
        with tables.job() as early:
            early.merge("a", frame(spark, [("a", 1)]))
            early.append("log", frame(spark, [("early", 1)]))
    assert rows(tables.read("a")) == [("a", 1)] and rows(tables.read("b")) == [("b", 1)] and rows(tables.read("log")) == [("early", 1), ("late", 1)]
    with pytest.raises(Conflict), tables.job() as late:
        late.merge("a", frame(spark, [("a", late.read("a").count() + 1)]))
        with tables.job() as early:
            early.merge("a", frame(spark, [("a", 7)]))
    assert rows(tables.read("a")) == [("a", 7)]


def test_only_touched_buckets_are_written(spark, tables):
    with tables.job() as job:
        job.create("a", "k int, n int", ["k"], 8)
        job.put("a", spark.range(200).selectExpr("CAST(id AS INT) AS k", "0 AS n"))
    before = tables._state()["tables"]["a"]["buckets"]
    with tables.job() as job:
        job.merge("a", spark.createDataFrame([(5, 1)], "k int, n int"))
    after = tables._state()["tables"]["a"]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert tables.read("a").where("n = 1").count() == 1 and tables.read("a").count() == 200
    files = {f.rsplit("/", 2)[-2] for f in tables.get("a", {"k": 7}).inputFiles()}
    assert len(files) == 1


def test_log(spark, tables):
    log = Log(tables, "log", "chunk string, version string, n int", "chunk", "version")
    put = lambda *r: log.append(spark.createDataFrame(list(r), "chunk string, version string, n int").coalesce(1))
    gone = lambda *v: log.append(spark.createDataFrame([(x,) for x in v], "version string"), DELETE)
    put(("a", "v1", 1), ("b", "v1", 2), ("a", "v1", 3), ("c", "v2", 4), ("d", None, 5))
    gone("v1", "unknown")
    assert rows(log.replay()) == [("c", "v2", 4), ("d", None, 5)]
    put(("a", "v1", 6))
    gone("v2")
    want = [("a", "v1", 6), ("d", None, 5)]
    assert rows(log.replay()) == want and log.rows().count() == 9
    assert log.compact() and rows(log.replay()) == want and log.rows().count() == 2
    put(("d", None, 7), ("a", "v9", 8))
    gone("v1")
    assert rows(log.replay()) == [("a", "v9", 8), ("d", None, 7)]
    log.delete_all()
    assert rows(log.replay()) == [] and not log.rows().count()
    put(("z", "v1", 1))
    assert rows(log.replay()) == [("z", "v1", 1)]


def test_two_appends_at_once_and_compaction(spark, tables):
    log = Log(tables, "log", "chunk string, version string, n int", "chunk", "version")
    one = spark.createDataFrame([("a", "v", 1)], "chunk string, version string, n int")
    with tables.job() as job:  # an append that ends after another one stands behind it
        job.append("log", one.selectExpr("chunk", "version", "2 AS n", "'put' AS op", "0L AS row"))
        log.append(one)
    assert rows(log.replay()) == [("a", "v", 2)] and log.rows().select("seq.append").distinct().count() == 2
    with tables.job() as job:
        job.append("log", one.selectExpr("chunk", "version", "3 AS n", "'put' AS op", "0L AS row"))
        assert log.compact()
    assert rows(log.replay()) == [("a", "v", 3)]


def test_stored_searches(spark, tables):
    e = Executions(tables, "version:string,score:double", buckets=4)
    hits = [(r, p, f"v{p}", 1 - p / 10) for r in ("q1", "q2") for p in range(5)]
    results = spark.createDataFrame(hits, "request string, pos int, version string, score double").repartition(3)
    e.store(results, "c1", "2026-01-01", 2)
    e.store(results.withColumn("version", F.lit("other")), "c2", "2026-01-02", 3)  # stays as it was
    assert e.first_page("q1").first()["first_page"] == '[{"pos":0,"version":"v0","score":1.0},{"pos":1,"version":"v1","score":0.9}]'
    assert rows(e.page("q2", 2, "c1").select("stale", "pos", "version")) == [(False, 2, "v2"), (False, 3, "v3")]
    assert rows(e.page("q2", 4, "c2").select("stale", "pos", "version")) == [(True, 4, "v4")] and not e.page("q9", 0, "c1").count() and not e.first_page("q9").count()
    assert len({f.rsplit("/", 2)[-2] for f in e.page("q1", 0, "c1").inputFiles()}) == 1
