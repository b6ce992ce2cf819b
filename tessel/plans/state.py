"""State queries. Stand-ins: events are an append log; user 0's hour is a group, 'purchase' a tombstone."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import state as op


def _log(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", "user_id", (F.col("event_id") % 977).alias("chunk"), (F.col("event_id") % 977 % 50).alias("version"), "event_type", F.col("value"))


def tombstone_replay(spark, d):
    log = _log(spark, d)
    out = op.replay(log, "chunk", "version", "event_id", (F.col("event_type") == "purchase") & (F.col("user_id") % 10 == 0))
    return out.select("chunk", "version", "event_id")


def upsert_latest(spark, d):
    log = _log(spark, d)
    last = lambda x: x.groupBy("chunk").agg(F.max_by(F.struct("event_id", "user_id"), "event_id").alias("r")).select("chunk", "r.event_id", "r.user_id")
    return op.upsert(last(log.where("event_type = 'click'")), last(log.where("event_type <> 'click'")), ["chunk"])


def delete_version(spark, d):
    log = _log(spark, d)
    left = op.delete(log, log.where("event_type = 'purchase'").select("version").where("version < 10"), ["version"])
    return left.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


def replace_version(spark, d):
    log = _log(spark, d).select("chunk", "version", "event_id")
    out = op.replace_versions(log.where("event_id % 2 = 0"), log.where("event_id % 2 = 1 AND version % 3 = 0"), "version")
    return out.groupBy("version").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


def index_idempotent(spark, d):
    log = _log(spark, d).select("version", "event_type").distinct()
    return op.not_yet(log, _log(spark, d).where("event_id % 40 = 0"), ["version", "event_type"])


def chunk_counts(spark, d):
    return _log(spark, d).groupBy("version").agg(F.countDistinct("chunk").alias("chunks"), F.count(F.lit(1)).alias("n"))


def tokens_or_null(spark, d):
    """Sum of a column, null if any value of the group is null."""
    e = _log(spark, d).withColumn("t", F.when(F.col("event_id") % 900 != 0, F.col("event_id")))
    return e.groupBy("version").agg(F.when(F.count_if(F.col("t").isNull()) == 0, F.sum("t")).alias("tokens"))


def reassign_family(spark, d):
    """Moves one version to another family, all else stays."""
    log = _log(spark, d)
    out = log.withColumn("family", F.when(F.col("version") == 7, F.lit(99)).otherwise(F.col("version") % 5))
    return out.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


_L = "SELECT event_id, user_id, event_id % 977 AS chunk, event_id % 977 % 50 AS version, event_type, value FROM events"
QUERIES = {f.__name__: f for f in (tombstone_replay, upsert_latest, delete_version, replace_version, index_idempotent, chunk_counts, tokens_or_null, reassign_family)}
ORACLE = {
    "tombstone_replay": f"""WITH l AS ({_L}), g AS (SELECT *, event_type = 'purchase' AND user_id % 10 = 0 AS grave FROM l), m AS (SELECT version, max(event_id) AS last FROM g WHERE grave GROUP BY 1)
SELECT chunk, g.version, event_id FROM g LEFT JOIN m ON g.version = m.version WHERE NOT grave AND (last IS NULL OR last < event_id) QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY event_id DESC) = 1""",
    "upsert_latest": f"""WITH l AS ({_L}), o AS (SELECT chunk, event_id, user_id FROM l WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY event_id DESC) = 1),
n AS (SELECT chunk, event_id, user_id FROM l WHERE event_type <> 'click' QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY event_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk NOT IN (SELECT chunk FROM n)""",
    "delete_version": f"WITH l AS ({_L}) SELECT version, count(*) AS n FROM l WHERE version NOT IN (SELECT version FROM l WHERE event_type = 'purchase' AND version < 10) GROUP BY 1",
    "replace_version": f"WITH l AS ({_L}), n AS (SELECT * FROM l WHERE event_id % 2 = 1 AND version % 3 = 0) SELECT version, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM (SELECT * FROM n UNION ALL SELECT * FROM l WHERE event_id % 2 = 0 AND version NOT IN (SELECT version FROM n)) GROUP BY 1",
    "index_idempotent": f"WITH l AS ({_L}) SELECT DISTINCT version, event_type FROM l EXCEPT SELECT version, event_type FROM l WHERE event_id % 40 = 0",
    "chunk_counts": f"WITH l AS ({_L}) SELECT version, count(DISTINCT chunk) AS chunks, count(*) AS n FROM l GROUP BY 1",
    "tokens_or_null": f"WITH l AS ({_L}), t AS (SELECT version, CASE WHEN event_id % 900 <> 0 THEN event_id END AS t FROM l) SELECT version, CASE WHEN count(*) = count(t) THEN CAST(sum(t) AS BIGINT) END AS tokens FROM t GROUP BY 1",
    "reassign_family": f"WITH l AS ({_L}) SELECT CASE WHEN version = 7 THEN 99 ELSE version % 5 END AS family, count(*) AS n FROM l GROUP BY 1",
}
