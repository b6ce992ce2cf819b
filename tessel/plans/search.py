"""Search queries. Stand-ins: vectors with a label below 8 are catalogued versions.

Requests are all vectors whose id is divisible by 50, and in ``exact_query`` all documents whose id is. Names with ``_whole`` are older names of the same.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import search as op
from tessel.operators.tiles import nearest


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _hits(spark, d):
    """Twenty nearest vectors of each request vector."""
    e = _t(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.lit(0).alias("label"))
    near = nearest(v, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("request"), F.col("embedding").alias("q")), 20)
    return near.select("request", F.col("id").alias("version"), (F.col("id") % 7).alias("chunk"), "score", F.col("rank").alias("hit_pos"))


def _catalogue(spark, d):
    return _t(spark, d, "embeddings").where("label < 8").select(F.col("vec_id").alias("version"), F.concat(F.lit("f"), F.col("label")).alias("family"), F.when(F.col("label") < 5, F.concat(F.lit("p"), F.col("label") % 3)).alias("process"))


def _results(spark, d):
    return op.resolve_hits(_hits(spark, d), _catalogue(spark, d))


def search_resolve_order(spark, d):
    return _results(spark, d).select("request", "pos", "version", "chunk", "score", "family")


def search_page(spark, d):
    return op.page(_results(spark, d), 5, 5).select("request", "pos", "version", "score")


def cursor_roundtrip(spark, d):
    o = _t(spark, d, "orders").select(F.concat(F.lit("req:"), F.col("o_orderkey")).alias("request"), (F.col("o_custkey") % 50).alias("offset"))
    c = o.withColumn("cursor", op.encode_cursor(F.col("request"), F.col("offset")))
    request, offset = op.decode_cursor(F.col("cursor"))
    return c.select("cursor", request.alias("request"), offset.alias("offset"))


def search_by_process(spark, d):
    return op.by_process(_results(spark, d)).select("request", "group", "place", "hits", "coverage", "best")


def search_nested(spark, d):
    """Processes with their families and all hits of these, as a text."""
    n = op.nested_by_process(_results(spark, d))
    hits = lambda x: F.array_join(F.transform(x["hits"], lambda h: h["version"].cast("string")), "+")
    documents = F.array_join(F.transform("documents", lambda x: F.concat(x["family"], F.lit(":"), hits(x))), ";")
    return n.select("request", "group", "rank", "adherence", "very_relevant", documents.alias("documents"), "average")


def search_frozen(spark, d):
    return op.freeze(_results(spark, d)).select("request", "total", F.array_join(F.transform("raw_hits", lambda x: x["version"].cast("string")), ",").alias("versions"))


def replay_match(spark, d):
    """Replay against a catalogue that has lost family f0."""
    frozen = op.freeze(_results(spark, d))
    now = op.resolve_hits(_hits(spark, d), _catalogue(spark, d).where("family <> 'f0'"))
    return op.replay(frozen, now)


def stale_flag(spark, d):
    """Is the corpus version that a request saw (the latest order of its year) no longer the latest?"""
    o = _t(spark, d, "orders")
    last = o.agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("now"))
    seen = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("seen"))
    return seen.crossJoin(F.broadcast(last)).select("year", (F.col("seen") != F.col("now")).alias("stale"))


def exact_query(spark, d):
    """Exact text match, no fuzzy match; unknown texts give nothing."""
    docs, wanted = _t(spark, d, "documents"), _t(spark, d, "documents").where("doc_id % 50 = 0").select(F.sha2("text", 256).alias("h"), F.col("text").alias("q")).distinct()
    found = docs.withColumn("h", F.sha2("text", 256)).join(wanted, "h").where("text = q")
    return found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


_H = """h0 AS (SELECT a.request, b.vec_id AS version, b.vec_id % 7 AS chunk, round(sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)), 6) AS score
  FROM (SELECT vec_id AS request, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 50 = 0) a
  JOIN (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) b ON a.i = b.i GROUP BY 1, 2, 3),
h AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, version) AS hit_pos FROM h0 QUALIFY hit_pos <= 20),
c AS (SELECT vec_id AS version, 'f' || label AS family, CASE WHEN label < 5 THEN 'p' || (label % 3) END AS process FROM embeddings WHERE label < 8),
r AS (SELECT h.*, family, process, CAST(row_number() OVER (PARTITION BY request ORDER BY score DESC, version, chunk, hit_pos) - 1 AS INTEGER) AS pos FROM h JOIN c USING (version))"""

QUERIES = {f.__name__: f for f in (search_resolve_order, search_page, cursor_roundtrip, search_by_process, search_nested, search_frozen, replay_match, stale_flag, exact_query)}
QUERIES |= {f"{f.__name__}_whole": f for f in (search_resolve_order, search_page, search_by_process, search_frozen, replay_match, exact_query)}
ORACLE = {
    "search_resolve_order": f"WITH {_H} SELECT request, pos, version, chunk, score, family FROM r",
    "search_page": f"WITH {_H} SELECT request, pos, version, score FROM r WHERE pos >= 5 AND pos < 10",
    "cursor_roundtrip": "SELECT replace(replace(to_base64(encode('req:' || o_orderkey || ':' || (o_custkey % 50))), '+', '-'), '/', '_') AS cursor, 'req:' || o_orderkey AS request, CAST(o_custkey % 50 AS INTEGER) AS \"offset\" FROM orders",
    "search_by_process": f"""WITH {_H}, g AS (SELECT request, coalesce(process, family) AS "group", min(pos) AS first, count(*) AS hits,
  CAST(floor(avg(floor(score * 100 + 0.5)) + 0.5) AS BIGINT) AS coverage, CAST(greatest(max(floor(score * 100 + 0.5)), 0) AS BIGINT) AS best FROM r GROUP BY 1, 2)
SELECT request, "group", CAST(row_number() OVER (PARTITION BY request ORDER BY first) AS INTEGER) AS place, hits, coverage, best FROM g""",
    "search_nested": f"""WITH {_H}, f AS (SELECT request, coalesce(process, family) AS g, family, min(pos) AS first, family || ':' || string_agg(version, '+' ORDER BY pos) AS t, arg_min(score, pos) AS score FROM r GROUP BY 1, 2, 3),
n AS (SELECT request, g, min(first) AS first, string_agg(t, ';' ORDER BY first) AS documents, arg_min(score, first) AS score FROM f GROUP BY 1, 2)
SELECT request, g AS "group", CAST(row_number() OVER (PARTITION BY request ORDER BY first) AS INTEGER) AS rank, CAST(floor(score * 100 + 0.5) AS BIGINT) AS adherence, score >= 0.85 AS very_relevant, documents,
  CAST(floor(avg(floor(score * 100 + 0.5)) OVER (PARTITION BY request) + 0.5) AS BIGINT) AS average FROM n""",
    "search_frozen": f"WITH {_H} SELECT request, count(*) AS total, string_agg(version, ',' ORDER BY pos) AS versions FROM r GROUP BY 1",
    "replay_match": f"WITH {_H} SELECT request, count(*) FILTER (WHERE family = 'f0') = 0 AS matches FROM r GROUP BY 1",
    "stale_flag": "SELECT year(o_orderdate) AS year, arg_max(o_orderkey, (o_orderdate, o_orderkey)) <> (SELECT arg_max(o_orderkey, (o_orderdate, o_orderkey)) FROM orders) AS stale FROM orders GROUP BY 1",
    "exact_query": "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 50 = 0) GROUP BY 1",
}
ORACLE |= {f"{n}_whole": ORACLE[n] for n in ("search_resolve_order", "search_page", "search_by_process", "search_frozen", "replay_match", "exact_query")}
