"""Queries over stored tables: jobs that commit, logs, stored searches. Each builds its store from the given tables, in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators.tiles import nearest
from tessel.plans import ingest, search
from tessel.sources import ingestion
from tessel.sources.shared import new_folder, written
from tessel.sources.tables import DELETE, Executions, Log, Tables
from tessel.sources.vector_index import VectorIndex


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _two_jobs(spark, d) -> Tables:
    """Orders of two remainders arrive in two jobs, half of the first again; between them a user rejects some edges."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("document_id"))
    edges = ingest._derived(spark, d).select("source", "target", "type", "origin", "status", "score", "evidence_version", "evidence_locator")
    edges = written(edges, "edges")[0]  # both jobs read them
    users = lambda n: _t(spark, d, "nation").where(F.col("n_nationkey") < n).select(F.col("n_nationkey").alias("user_id"))
    tables = Tables(spark, new_folder(spark, "catalogue"))
    ingestion.create(tables, "long", "long", "int", buckets=4)
    declared, derived = edges.where("source % 6 = 0").withColumn("origin", F.lit("declared")), edges.where("source % 6 <> 0")
    ingestion.ingest_into(tables, o.where("version % 100 = 1"), declared, derived, users(4), "job-1", "2026-01-01T00:00:00")
    with tables.job() as job:
        job.merge("relations", job.read("relations").where("source % 4 = 0").withColumn("status", F.lit("rejected")))
    ingestion.ingest_into(tables, o.where("version % 200 = 1 OR version % 100 = 2"), declared, derived, users(5), "job-2", "2026-01-02T00:00:00")
    return tables


def stored_jobs(spark, d):
    """What two jobs in a row leave in the stored tables: rows of each kind."""
    tables = _two_jobs(spark, d)
    kinds = {"families": F.lit("all"), "versions": F.col("ingested_at"), "relations": F.concat_ws(" ", "origin", "status"), "notifications": F.col("job"), "events": F.concat_ws(" ", "job", "event"), "digests": F.col("job")}
    out = None
    for name, kind in kinds.items():
        part = tables.read(name).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "kind", "n")
        out = part if out is None else out.unionByName(part)
    return out


def job_counts(spark, d):
    """What both jobs have counted, and the first state of the versions, read as of its commit."""
    tables = _two_jobs(spark, d)
    first = tables.read("versions", 2).groupBy(F.col("ingested_at").alias("at")).agg(F.count(F.lit(1)).alias("then"))
    return tables.read("jobs").join(first, "at", "left").select("job", "families_count", "versions_count", F.coalesce("then", F.lit(0).cast("long")).alias("then"))


def log_compacted(spark, d):
    """Events in six appends, purchases of some users delete their group: what the log leaves before and after its compaction, and after more appends."""
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 977).alias("chunk"), (F.col("event_id") % 977 % 50).alias("version"), "event_type", "user_id")
    n = e.agg(F.max("event_id")).first()[0] or 0
    log = Log(Tables(spark, new_folder(spark, "log")), "log", "event_id long, chunk long, version long", "chunk", "version")
    left = {}
    for step in range(3):
        part = e.where((F.col("event_id") * 3 >= step * (n + 1)) & (F.col("event_id") * 3 < (step + 1) * (n + 1)))
        log.append(part.where("event_type <> 'purchase'").repartitionByRange(4, "event_id").sortWithinPartitions("event_id"))
        log.append(part.where("event_type = 'purchase' AND user_id % 200 = 0").select("version").distinct(), DELETE)
        if step == 1:
            left["before"] = log.replay()
            log.compact()
            left["after"] = log.replay()
    left["last"] = log.replay()
    out = None
    for name, rows in left.items():
        part = rows.select(F.lit(name).alias("at"), "chunk", "version", "event_id")
        out = part if out is None else out.unionByName(part)
    return out


def stored_pages(spark, d):
    """Searches are stored with their corpus, and once more under another one, which changes nothing; their second pages from the stored rows alone, known to be stale."""
    results = search._results(spark, d).select("request", "pos", "version", "chunk", "score")
    e = Executions(Tables(spark, new_folder(spark, "searches")), "version:long,chunk:long,score:double", "long")
    e.store(results, "corpus-1", "2026-01-01", 5)
    e.store(results.withColumn("score", F.lit(0.0)), "corpus-2", "2026-01-02", 5)
    stored = e.all("corpus-2")
    return stored.where("pos >= 5 AND pos < 5 + size").select("request", "stale", "pos", "version", "score", F.get_json_object("first_page", "$[0].version").cast("long").alias("first"))


_L = "SELECT event_id, event_id % 977 AS chunk, event_id % 977 % 50 AS version, event_type, user_id, CASE WHEN event_id * 3 < m THEN 0 WHEN event_id * 3 < 2 * m THEN 1 ELSE 2 END AS step FROM events, (SELECT max(event_id) + 1 AS m FROM events)"
_LEFT = lambda name, steps: f"""SELECT '{name}' AS at, chunk, p.version, event_id FROM (SELECT chunk, any_value(version) AS version, max(event_id) AS event_id, arg_max(step, event_id) AS step FROM l WHERE event_type <> 'purchase' AND step < {steps} GROUP BY 1) p
  LEFT JOIN (SELECT version, max(step) AS grave FROM l WHERE event_type = 'purchase' AND user_id % 200 = 0 AND step < {steps} GROUP BY 1) g ON g.version = p.version WHERE grave IS NULL OR grave < step"""  # noqa: E731
QUERIES = {f.__name__: f for f in (stored_jobs, job_counts, log_compacted, stored_pages)}
ORACLE = {
    "stored_jobs": ingest._ALL + """, arrived AS (SELECT o_orderkey AS v, o_custkey AS f FROM orders WHERE o_orderkey % 100 IN (1, 2)), users AS (SELECT n_nationkey AS u FROM nation WHERE n_nationkey < 5),
notes AS (SELECT u, v, CASE WHEN v % 100 = 1 AND u < 4 THEN 1 ELSE 2 END AS job FROM arrived, users WHERE v % 100 = 2 OR u < 4 OR v % 200 = 1)
SELECT 'families' AS name, 'all' AS kind, count(DISTINCT f) AS n FROM arrived
UNION ALL SELECT 'versions', CASE WHEN v % 200 = 1 OR v % 100 = 2 THEN '2026-01-02T00:00:00' ELSE '2026-01-01T00:00:00' END, count(*) FROM arrived GROUP BY 2
UNION ALL SELECT 'relations', CASE WHEN source % 6 = 0 THEN 'declared ' || status WHEN source % 4 = 0 THEN origin || ' rejected' ELSE origin || ' ' || status END, count(*) FROM d GROUP BY 2
UNION ALL SELECT 'notifications', 'job-' || job, count(*) FROM notes GROUP BY 2
UNION ALL SELECT 'events', 'job-' || job || ' ' || unnest(['notification_generated', 'notification_delivered']), count(*) FROM notes GROUP BY 2
UNION ALL SELECT 'events', 'job-2 notification_suppressed', count(*) AS n FROM arrived, users WHERE u < 4 AND v % 200 = 1 HAVING count(*) > 0
UNION ALL SELECT 'events', 'job-' || job || ' ' || unnest(['email_digest_generated', 'notification_delivered_email']), count(DISTINCT u) FROM notes GROUP BY job
UNION ALL SELECT 'digests', 'job-' || job, count(DISTINCT u) FROM notes GROUP BY job""",
    "job_counts": """SELECT 'job-1' AS job, count(DISTINCT o_custkey) AS families_count, count(*) AS versions_count, count(*) AS "then" FROM orders WHERE o_orderkey % 100 = 1
UNION ALL SELECT 'job-2', count(DISTINCT o_custkey), count(*), 0 FROM orders WHERE o_orderkey % 200 = 1 OR o_orderkey % 100 = 2""",
    "log_compacted": f"WITH l AS ({_L}) {_LEFT('before', 2)} UNION ALL {_LEFT('after', 2)} UNION ALL {_LEFT('last', 3)}",
    "stored_pages": f"WITH {search._H} SELECT request, true AS stale, pos, version, score, first_value(version) OVER (PARTITION BY request ORDER BY pos) AS first FROM r QUALIFY pos >= 5 AND pos < 10",
}


CELLS, PROBES = 16, 8


def _index(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    index = VectorIndex(Tables(spark, new_folder(spark, "index")), "chunks")
    index.create(rows, 64, CELLS)
    index.add(rows)
    return index, rows, rows.where("id % 50 = 0").select(F.col("id").alias("request"), F.col("v").alias("q"))


def index_search(spark, d):
    """The ten best of each request from the stored index, all cells read."""
    index, _, asked = _index(spark, d)
    return index.search(asked, 10).select("request", "id", "score", "rank")


def index_recall(spark, d):
    """Recall at ten of the index, half of the cells read for each request, against all vectors: is it 0.9 at least? And after a drop nothing is left."""
    index, rows, asked = _index(spark, d)
    want = nearest(rows, asked, 10).select("request", "id")
    got = index.search(asked, 10, PROBES).select("request", "id", F.lit(1).alias("found"))
    out = want.join(got, ["request", "id"], "left").agg(F.count_distinct("request").alias("requests"), F.count(F.lit(1)).alias("wanted"), (F.count("found") / F.count(F.lit(1)) >= 0.9).alias("enough"))
    out = written(out.withColumns({"cells": F.lit(CELLS), "read": F.lit(PROBES), "indexed": F.lit(index.count()).cast("long")}), "recall")[0]
    index.drop()
    return out.withColumn("left", F.lit(index.count()).cast("long"))


QUERIES |= {f.__name__: f for f in (index_search, index_recall)}
ORACLE |= {
    "index_search": f"WITH {search._H.split(',' + chr(10) + 'h AS')[0]} SELECT request, version AS id, score, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, version) AS INTEGER) AS rank FROM h0 QUALIFY rank <= 10",
    "index_recall": f"SELECT count(*) FILTER (WHERE vec_id % 50 = 0) AS requests, count(*) FILTER (WHERE vec_id % 50 = 0) * least(count(*), 10) AS wanted, true AS enough, {CELLS} AS cells, {PROBES} AS read, count(*) AS indexed, CAST(0 AS BIGINT) AS \"left\" FROM embeddings",
}
