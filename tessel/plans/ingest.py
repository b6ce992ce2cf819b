"""Citations, derived edges, the ingestion job and what it leaves. Stand-ins: orders are document versions, customers their families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import graph, notify, relations, state
from tessel.sources.shared import written


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


#: The suffix of an order's own notice, and of the one that it cites (none for every third).
_OWN = "CASE WHEN o_custkey % 2 = 0 THEN '-SFT' ELSE '-AB' END"
_CITED = "CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '-SFT' ELSE '-AB' END"


def _chunks(spark, d):
    """Two chunks of each order; the first cites a notice twice and another one, the second has a number that is none."""
    o = _t(spark, d, "orders")
    first = F.expr(f"'Vide o AUTO DE  INFRAÇÃO nº 0' || CAST(o_orderkey * 7 % 997 AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || {_CITED} || ', e o Auto de infracao – AI – no. ' || CAST(o_orderkey * 3 % 997 AS STRING) || '/2020; AUTO DE INFRAÇÃO nº 0' || CAST(o_orderkey * 7 % 997 AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || {_CITED}")
    both = F.array(F.struct(F.lit(0).alias("i"), first.alias("text")), F.struct(F.lit(1).alias("i"), F.lit("auto de infração 12/2020 sem número").alias("text")))
    rows = o.select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("family"), F.explode(both).alias("c"))
    return rows.select("version", "family", F.format_string("%d#chunk-%04d", "version", "c.i").alias("locator"), "c.text")


def _catalogue(spark, d):
    return _t(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("family"), F.expr(f"'AI ' || CAST(o_orderkey % 997 AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) || {_OWN}").alias("document_id"))


def citations(spark, d):
    out = relations.citations(_chunks(spark, d))
    return out.select("version", "locator", F.regexp_replace("identifier", r"(?iu)^auto de infra[çc][ãa]o", "AI").alias("identifier"), "pos")


def citation_keys(spark, d):
    k = relations.citations(_chunks(spark, d)).withColumn("k", relations.notice_key(F.col("identifier")))
    return k.groupBy("k.number", "k.year", "k.suffix").agg(F.count(F.lit(1)).alias("n"))


def _references(spark, d):
    chunks = _chunks(spark, d)
    return relations.reference_edges(relations.citations(chunks), chunks.select("version", "family").distinct(), _catalogue(spark, d))


def reference_edges(spark, d):
    return _references(spark, d).select("source", "target", "type", "origin", "status", "evidence_version", "evidence_locator")


def _near(spark, d):
    """Candidates: customers beside each other, with a score that their numbers give. Those of every fifth number are not in the catalogue."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("src"))
    rows = c.select("src", F.explode(F.array(F.col("src") + 1, F.col("src") - 1, F.col("src") + 7)).alias("dst"))
    return rows.withColumn("score", F.round(F.lit(0.7) + F.pmod(F.col("src") * F.col("dst"), F.lit(31)) / 100, 2))


def _families(spark, d):
    return _t(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("family"))


def similar_in_catalogue(spark, d):
    return relations.similarity_edges(_near(spark, d), _families(spark, d)).select("source", "target", "type", "status", "score")


def _derived(spark, d):
    return relations.derived_edges(_references(spark, d), relations.similarity_edges(_near(spark, d), _families(spark, d)))


def derived_edges(spark, d):
    return _derived(spark, d).groupBy("type", "origin", "status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("source") * 3 + F.col("target")).alias("s"))


def _job(spark, d, edges_count=False):
    """Orders of one remainder arrive; two others are there already, with some relations and notifications. ``edges_count``: the result needs
    the edges, which are written once then, as they are read several times."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_custkey").alias("family"), F.col("o_orderpriority").alias("document_id"))
    at = "2026-01-02T03:04:05"
    old = o.where("version % 10 IN (1, 2)")
    columns = "source, target, type, origin, status, score, evidence_version, evidence_locator"
    edges = _derived(spark, d).selectExpr(*columns.split(", "))
    edges = written(edges, "edges")[0] if edges_count else edges
    stored = edges.where("source % 2 = 0").withColumn("status", F.lit("rejected"))
    declared = edges.where("source % 6 = 0").withColumn("origin", F.lit("declared"))
    notified = old.where("version % 10 = 1").select(F.lit(1).alias("user_id"), "version", F.lit("job-0").alias("job"))
    tables = {"families": old.select("family").distinct(), "versions": old.withColumn("ingested_at", F.lit("2025-01-01T00:00:00")), "relations": stored, "notifications": notified}
    users = _t(spark, d, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("user_id"))
    return relations.ingest(o.where("version % 100 = 1"), tables, declared, edges.where("source % 6 <> 0"), users, "job-1", at)


def ingest_versions(spark, d):
    j = _job(spark, d)
    return j["versions"].groupBy("ingested_at").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("family").alias("families"))


def ingest_relations(spark, d):
    return _job(spark, d, True)["relations"].groupBy("origin", "status").agg(F.count(F.lit(1)).alias("n"))


def ingest_summary(spark, d):
    return _job(spark, d, True)["summary"]


def ingest_notifications(spark, d):
    return _job(spark, d)["notifications"].groupBy("user_id", "job").agg(F.count(F.lit(1)).alias("n"))


def ingest_events(spark, d):
    return _job(spark, d)["events"].groupBy("user_id", "event").agg(F.count(F.lit(1)).alias("n"))


def index_rejects(spark, d):
    """Orders without a customer of the catalogue or with a status that isn't allowed."""
    o = _t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")).alias("family"), F.col("o_orderstatus").alias("status"))
    good, bad = relations.checked(o, ("family",), status=("F", "O"))
    return bad.select("o_orderkey", F.array_join("reasons", "; ").alias("reasons")).unionByName(good.select("o_orderkey", F.lit("").alias("reasons")))


def _rows(spark, d):
    return _t(spark, d, "events").select(F.col("event_id"), (F.col("event_id") % 50).alias("version"), F.col("event_type").alias("model"))


def reindex_model(spark, d):
    r = _rows(spark, d)
    return state.reindex(r, r.where("event_id % 3 = 0").drop("model"), "click").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("s"))


def rebuild_from_log(spark, d):
    out = state.rebuild(_rows(spark, d), "version", "version", "event_id", F.col("model") == "purchase", 20)
    return out.select("version", "event_id", (F.col("batch") >= 0).alias("placed"))


def deleted_counts(spark, d):
    return state.deleted_counts(_rows(spark, d), spark.range(40, 60).select(F.col("id").alias("version")), "version")


def reset_tables(spark, d):
    left, counts = state.reset({"events": _rows(spark, d), "labels": _t(spark, d, "labels")})
    return counts.withColumn("left", F.lit(0).cast("long"))


def _notes(spark, d):
    return _t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") * 3).alias("version"), "event_type", F.col("ts").alias("created_at"))


def notifications_display(spark, d):
    v = _t(spark, d, "orders").select(F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("document_id"), F.col("o_orderstatus").alias("document_type"))
    opened = _notes(spark, d).where("event_type = 'click'").select((F.col("id") + 1).alias("id"))
    return notify.for_display(_notes(spark, d), v, opened).select("id", "version", "document_id", "document_type", "opened")


def notify_opened_by_id(spark, d):
    """Clicks open the notification before them, unless one is opened by its purchase."""
    n = _notes(spark, d)
    return notify.open_once(n.where("event_type = 'click'").select((F.col("id") - F.col("id") % 3).alias("k")), n.where("event_type = 'purchase' AND id % 2 = 0").select((F.col("id") - F.col("id") % 3).alias("k")).distinct(), "k")


def digest_list(spark, d):
    sent = _notes(spark, d).select("user_id", F.date_trunc("day", "created_at").alias("created_at"), F.concat_ws(":", F.col("user_id").cast("string"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("email_id"))
    return notify.digest_order(sent).where("pos <= 3").select("user_id", "email_id", "pos")


def digest_sending(spark, d):
    """Digests of each user and month that were not sent in even months, with their two events."""
    e = _notes(spark, d).withColumn("job", F.date_format("created_at", "yyyy-MM"))
    made = notify.digests(e, "user_id", "job", F.col("event_type"), F.col("id"))
    sent = made.where("pmod(user_id, 2) = 0").select("email_id")
    return notify.digest_events(notify.send_once(made, sent))


def reason_texts(spark, d):
    one = F.struct(F.when(F.col("event_type") == "click", "novo_documento").otherwise("correlato").alias("type"), F.col("event_type").alias("relation_type"))
    r = _t(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(one)).alias("r"))
    return r.select("user_id", notify.reason_text(F.col("r")).alias("description"))


def node_labels(spark, d):
    n = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("node")).union(_t(spark, d, "lineitem").select("l_partkey")).distinct()
    return graph.labelled(n, _t(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("label")))


def content_hash_cache(spark, d):
    f = _t(spark, d, "pages").select(F.col("url").alias("path"), F.length("html").alias("length"), F.col("page_id").alias("modificationTime"), F.col("html").cast("binary").alias("content")).dropDuplicates(["path", "length", "modificationTime"])
    cache = f.where("modificationTime % 2 = 0").select("path", "length", (F.col("modificationTime") - F.when(F.col("modificationTime") % 4 == 0, 1).otherwise(0)).alias("modificationTime"), F.sha2("content", 256).alias("sha256"))
    return state.content_hashes(f, cache).select(F.col("modificationTime").alias("page_id"), "sha256", "cached")


_CITE = f"""WITH c AS (SELECT o_orderkey AS version, o_custkey AS family, o_orderkey || '#chunk-0000' AS locator, o_orderkey * 7 % 997 AS a, year(o_orderdate) AS y, {_CITED} AS s, o_orderkey * 3 % 997 AS b FROM orders),
x AS (SELECT version, family, locator, 0 AS pos, a AS number, y AS year, nullif(substr(s, 2), '') AS suffix, 'AI nº 0' || a || '/' || y || s AS identifier FROM c
 UNION ALL SELECT version, family, locator, 1, b, 2020, NULL, 'AI – AI – no. ' || b || '/2020' FROM c
 UNION ALL SELECT version, family, locator, 2, a, y, nullif(substr(s, 2), ''), 'AI nº 0' || a || '/' || y || s FROM c)"""
_EDGES = _CITE + f""", r AS (SELECT DISTINCT version, family, locator, number, year, suffix, pos FROM x),
t AS (SELECT DISTINCT o_custkey AS target, o_orderkey % 997 AS number, year(o_orderdate) AS year, substr({_OWN}, 2) AS suffix FROM orders WHERE o_orderkey % 2 = 0),
f AS (SELECT r.family AS source, min(t.target) AS target, r.version, r.locator, r.pos FROM r JOIN t ON r.number = t.number AND r.year = t.year AND (r.suffix IS NULL OR r.suffix = t.suffix)
 GROUP BY r.family, r.version, r.locator, r.number, r.year, r.suffix, r.pos HAVING count(DISTINCT t.target) = 1 AND min(t.target) <> r.family),
e AS (SELECT source, target, min((version, locator)) AS ev FROM f GROUP BY 1, 2)"""
_PAIRS = """, n AS (SELECT c_custkey AS src, unnest([c_custkey + 1, c_custkey - 1, c_custkey + 7]) AS dst FROM customer), m AS (SELECT src, dst, round(0.7 + ((src * dst) % 31) / 100, 2) AS score FROM n),
g AS (SELECT least(src, dst) AS source, greatest(src, dst) AS target, arg_min(score, src) AS score FROM m WHERE score >= 0.8 AND score < 0.97 AND dst IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) GROUP BY 1, 2)"""
_ALL = _EDGES + _PAIRS + """, d AS (SELECT source, target, 'referencia' AS type, 'explicit' AS origin, 'confirmed' AS status FROM e UNION ALL SELECT source, target, 'similar_a', 'similarity', 'suggested' FROM g)"""
_NOTES = "WITH n AS (SELECT event_id AS id, user_id, event_id * 3 AS version, event_type, ts AS created_at FROM events)"
QUERIES = {
    f.__name__: f
    for f in (citations, citation_keys, reference_edges, similar_in_catalogue, derived_edges, ingest_versions, ingest_relations, ingest_summary, ingest_notifications, ingest_events, index_rejects, reindex_model, rebuild_from_log)
    + (deleted_counts, reset_tables, notifications_display, notify_opened_by_id, digest_list, digest_sending, reason_texts, node_labels, content_hash_cache)
}
ORACLE = {
    "citations": _CITE + " SELECT version, locator, identifier, CAST(min(pos) AS INTEGER) AS pos FROM x GROUP BY 1, 2, 3",
    "citation_keys": _CITE + ", u AS (SELECT DISTINCT version, locator, identifier, number, year, suffix FROM x) SELECT CAST(number AS INTEGER) AS number, CAST(year AS INTEGER) AS year, suffix, count(*) AS n FROM u GROUP BY 1, 2, 3",
    "reference_edges": _EDGES + " SELECT source, target, 'referencia' AS type, 'explicit' AS origin, 'confirmed' AS status, ev[1] AS evidence_version, ev[2] AS evidence_locator FROM e",
    "similar_in_catalogue": _EDGES + _PAIRS + " SELECT source, target, 'similar_a' AS type, 'suggested' AS status, score FROM g",
    "derived_edges": _ALL + " SELECT type, origin, status, count(*) AS n, CAST(sum(source * 3 + target) AS BIGINT) AS s FROM d GROUP BY 1, 2, 3",
    "ingest_versions": """WITH o AS (SELECT o_orderkey AS v, o_custkey AS f FROM orders), n AS (SELECT *, '2026-01-02T03:04:05' AS ingested_at FROM o WHERE v % 100 = 1 UNION ALL SELECT *, '2025-01-01T00:00:00' FROM o WHERE v % 10 IN (1, 2) AND v % 100 <> 1)
SELECT ingested_at, count(*) AS n, count(DISTINCT f) AS families FROM n GROUP BY 1""",
    "ingest_relations": _ALL + """ SELECT CASE WHEN source % 6 = 0 THEN 'declared' ELSE origin END AS origin, CASE WHEN source % 2 = 0 AND source % 6 <> 0 THEN 'rejected' ELSE status END AS status, count(*) AS n FROM d GROUP BY 1, 2""",
    "ingest_summary": _ALL + " SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 100 = 1) AS families_count, (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 1) AS versions_count, count(*) AS relations_count FROM d",
    "ingest_notifications": """WITH u AS (SELECT n_nationkey AS user_id FROM nation WHERE n_nationkey < 4), o AS (SELECT o_orderkey AS v FROM orders)
SELECT user_id, job, count(*) AS n FROM (SELECT CAST(1 AS BIGINT) AS user_id, 'job-0' AS job FROM o WHERE v % 10 = 1 UNION ALL SELECT user_id, 'job-1' FROM u, o WHERE v % 100 = 1 AND user_id <> 1) GROUP BY 1, 2""",
    "ingest_events": """WITH u AS (SELECT n_nationkey AS user_id FROM nation WHERE n_nationkey < 4), o AS (SELECT o_orderkey AS v FROM orders WHERE o_orderkey % 100 = 1), e AS (
 SELECT user_id, unnest(['notification_generated', 'notification_delivered']) AS event FROM u, o WHERE user_id <> 1 UNION ALL SELECT user_id, 'notification_suppressed' FROM u, o WHERE user_id = 1
 UNION ALL SELECT user_id, unnest(['email_digest_generated', 'notification_delivered_email']) FROM u WHERE user_id <> 1 AND EXISTS (SELECT 1 FROM o))
SELECT user_id, event, count(*) AS n FROM e GROUP BY 1, 2""",
    "index_rejects": "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_custkey % 7 = 0 THEN 'missing: family' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'not allowed: status ' || o_orderstatus END) AS reasons FROM orders",
    "reindex_model": "SELECT model, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM (SELECT event_type AS model, event_id FROM events WHERE event_type <> 'click' UNION ALL SELECT 'click', event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1",
    "rebuild_from_log": """WITH r AS (SELECT event_id, event_id % 50 AS version, event_type FROM events), g AS (SELECT version, max(event_id) AS g FROM r WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT version, max(event_id) AS event_id FROM r WHERE event_type <> 'purchase' GROUP BY 1)
SELECT p.version, p.event_id, true AS placed FROM p LEFT JOIN g ON p.version = g.version WHERE g.g IS NULL OR g.g < p.event_id""",
    "deleted_counts": "SELECT range AS version, (SELECT count(*) FROM events WHERE event_id % 50 = range) AS deleted FROM range(40, 60)",
    "reset_tables": "SELECT 'events' AS name, count(*) AS deleted, CAST(0 AS BIGINT) AS \"left\" FROM events UNION ALL SELECT 'labels', count(*), 0 FROM labels",
    "notifications_display": _NOTES + " SELECT id, version, o_orderpriority AS document_id, o_orderstatus AS document_type, id IN (SELECT id + 1 FROM n WHERE event_type = 'click') AS opened FROM n LEFT JOIN orders ON o_orderkey = version",
    "notify_opened_by_id": "SELECT DISTINCT event_id - event_id % 3 AS k FROM events WHERE event_type = 'click' AND event_id - event_id % 3 NOT IN (SELECT event_id - event_id % 3 FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0)",
    "digest_list": "WITH s AS (SELECT user_id, date_trunc('day', ts) AS t, user_id || ':' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS email_id FROM events) SELECT user_id, email_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY t DESC, email_id DESC) AS INTEGER) AS pos FROM s QUALIFY pos <= 3",
    "digest_sending": "SELECT DISTINCT user_id, user_id || ':' || strftime(ts, '%Y-%m') AS email_id, unnest(['email_digest_generated', 'notification_delivered_email']) AS event FROM events WHERE user_id % 2 <> 0",
    "reason_texts": """WITH r AS (SELECT DISTINCT user_id, CASE WHEN event_type = 'click' THEN 'novo_documento' ELSE 'correlato' END AS t, event_type AS e FROM events)
SELECT user_id, string_agg(CASE WHEN t = 'novo_documento' THEN 'Novo documento' ELSE 'Correlato: ' || e END, ' · ' ORDER BY t, e) AS description FROM r GROUP BY 1""",
    "node_labels": "WITH n AS (SELECT l_suppkey AS node FROM lineitem UNION SELECT l_partkey FROM lineitem) SELECT node, coalesce(s_name, CAST(node AS VARCHAR)) AS label FROM n LEFT JOIN supplier ON s_suppkey = node",
    "content_hash_cache": "SELECT page_id, sha256(html) AS sha256, page_id % 4 = 2 AS cached FROM pages",
}
