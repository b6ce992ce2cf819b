"""Measurements of a search. Stand-ins: vectors are chunks, labels their families and processes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tessel.operators import measure as op
from tessel.plans.evaluate import _ranked
from tessel.plans.vectors import family_pairs, family_vectors


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mapping(spark, d):
    """Two nations out of three have a canonical one, the smallest of their region."""
    n = _t(spark, d, "nation")
    least = n.groupBy("n_regionkey").agg(F.min("n_name").alias("canonical"))
    return n.where("n_nationkey % 3 <> 0").join(least, "n_regionkey").select(F.col("n_name").alias("raw"), "canonical")


def canonical_lenient(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 5 != 4, F.col("n_name")).alias("process"))
    return op.canonical(n, _mapping(spark, d), "process")


def canonical_strict(spark, d):
    n = _t(spark, d, "nation").where("n_nationkey % 3 <> 0").select("n_nationkey", F.col("n_name").alias("process"))
    return op.canonical(n, _mapping(spark, d), "process", strict=True)


def recall_sides(spark, d):
    """Processes of the first three hits of each query against its own label and the next two."""
    hits = _ranked(spark, d).select("query", "rank", F.when(F.col("label") != 9, F.col("label")).alias("process"))
    golden = _t(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.explode(F.array("label", (F.col("label") + 1) % 10, (F.col("label") + 2) % 10)).alias("process"))
    r = op.recall_side(hits, golden, 3, 2)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("query", text("processes").alias("processes"), text("in_golden").alias("in_golden"), "denominator", F.round("recall", 6).alias("recall"), "passed")


def _section(e):
    return F.when(e["vec_id"] % 4 == 0, "III – Da Fundamentação").when(e["vec_id"] % 4 == 1, "Do mérito").when(e["vec_id"] % 4 == 2, "Relatório")


def _both(spark, d):
    e = _t(spark, d, "embeddings")
    kept = op.has_grounds(_section(e)) & (F.col("label") < 6)
    return op.mean_vectors(e, "label", "embedding"), op.mean_vectors(e, "label", "embedding", kept)


def section_filter(spark, d):
    e = _t(spark, d, "embeddings")
    return e.select(_section(e).alias("section")).withColumn("grounds", op.has_grounds(F.col("section"))).groupBy("section", "grounds").agg(F.count(F.lit(1)).alias("n"))


def section_vectors(spark, d):
    part = _both(spark, d)[1]
    return part.select("family", "n", F.posexplode_outer("v").alias("i", "x")).select("family", "n", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def aggregation_comparison(spark, d):
    whole, part = _both(spark, d)
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (0, 8)], "a int, b int")
    out = op.compare_aggregations(pairs, whole, part)
    return out.select("a", "b", F.round("score_whole", 6).alias("score_whole"), F.round("score_part", 6).alias("score_part"), "lowered")


def neighbors_of_pairs(spark, d):
    fam = family_vectors(_t(spark, d, "embeddings"), "label", "embedding")
    return op.top_of_pairs(family_pairs(fam).select("a", "b", F.round("score", 6).alias("score")), 3)


def small_to_big(spark, d):
    """Lines of an order are its pages; lines with many pieces are chunks of one or two pages."""
    l = _t(spark, d, "lineitem")  # noqa: E741
    chunks = l.where("l_quantity > 40").select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("page_start"), (F.col("l_linenumber") + F.col("l_linenumber") % 2).alias("page_end"))
    return op.widened_pages(chunks, l.select(F.col("l_orderkey").alias("version"), F.col("l_linenumber").alias("page")).distinct())


def pages_appended(spark, d):
    o = _t(spark, d, "orders")
    parts = [o.where(F.col("o_orderkey") % 3 <= i).select((F.col("o_orderkey") - i).alias("pos"), "o_custkey") for i in range(3)]
    return op.appended(parts).groupBy("pos._page").agg(F.count(F.lit(1)).alias("n"), F.sum("pos.pos").alias("s"))


def measurement_json(spark, d):
    return op.measurement(_t(spark, d, "labels").where("doc_id % 50 = 0").select("quality", "doc_id", "toxic"), "quality")


def corpora_united(spark, d):
    """Two corpora with their names, one behind the other."""
    parts = [_t(spark, d, "orders").select(F.lit("a").alias("corpus_id"), F.col("o_orderkey").alias("document")), _t(spark, d, "customer").select(F.lit("b").alias("corpus_id"), F.col("c_custkey").alias("document"))]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n"), F.sum("document").alias("s"))


_MAP = "WITH m AS (SELECT n_name AS raw, (SELECT min(x.n_name) FROM nation x WHERE x.n_regionkey = n.n_regionkey) AS canonical FROM nation n WHERE n_nationkey % 3 <> 0)"
_VEC = "WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
_MEAN = """{0}m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM x {1} GROUP BY 1, 2), {0}n AS (SELECT label, sqrt(sum(x * x)) AS l FROM {0}m GROUP BY 1), {0} AS (SELECT m.label, i, x / l AS x FROM {0}m m JOIN {0}n USING (label))"""
_PART = "WHERE vec_id % 4 < 2 AND label < 6"
QUERIES = {f.__name__: f for f in (canonical_lenient, canonical_strict, recall_sides, section_filter, section_vectors, aggregation_comparison, neighbors_of_pairs, small_to_big, pages_appended, measurement_json, corpora_united)}
ORACLE = {
    "canonical_lenient": _MAP + " SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 4 THEN coalesce(canonical, n_name) END AS process FROM nation LEFT JOIN m ON raw = n_name",
    "canonical_strict": _MAP + " SELECT n_nationkey, canonical AS process FROM nation JOIN m ON raw = n_name",
    "recall_sides": """WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT q.vec_id AS query, any_value(q.label) AS g, e.vec_id, any_value(e.label) AS label, round(sum(CAST(q.x AS DOUBLE) * CAST(e.x AS DOUBLE)), 6) AS score FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.i = e.i AND q.vec_id <> e.vec_id GROUP BY q.vec_id, e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3), p AS (SELECT query, any_value(g) AS g, label, min(rank) AS rank FROM r WHERE label <> 9 GROUP BY query, label), q AS (SELECT vec_id AS query, label AS g FROM embeddings WHERE vec_id % 50 = 0),
a AS (SELECT query, string_agg(label, ',' ORDER BY rank) AS processes, string_agg(label, ',' ORDER BY label) FILTER (WHERE label IN (g, (g + 1) % 10, (g + 2) % 10)) AS in_golden, count(*) FILTER (WHERE label IN (g, (g + 1) % 10, (g + 2) % 10)) AS n FROM p GROUP BY 1)
SELECT q.query, coalesce(processes, '') AS processes, coalesce(in_golden, '') AS in_golden, CAST(3 AS BIGINT) AS denominator, round(coalesce(n, 0) / 3, 6) AS recall, coalesce(n, 0) >= 2 AS passed FROM q LEFT JOIN a USING (query)""",
    "section_filter": "SELECT CASE vec_id % 4 WHEN 0 THEN 'III – Da Fundamentação' WHEN 1 THEN 'Do mérito' WHEN 2 THEN 'Relatório' END AS section, vec_id % 4 < 2 AS grounds, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "section_vectors": _VEC + _MEAN.format("p", _PART) + ", c AS (SELECT label AS family, count(*) FILTER (WHERE vec_id % 4 < 2 AND label < 6) AS n FROM embeddings GROUP BY 1) SELECT family, n, CAST(i - 1 AS BIGINT) AS i, round(x, 6) AS x FROM c LEFT JOIN p ON p.label = family",
    "aggregation_comparison": _VEC + _MEAN.format("w", "") + ", " + _MEAN.format("p", _PART) + """, k AS (SELECT * FROM (VALUES (0, 1), (2, 3), (4, 5), (0, 8)) t(a, b)), s AS (SELECT a, b, (SELECT sum(y.x * z.x) FROM w y JOIN w z ON y.i = z.i WHERE y.label = a AND z.label = b) AS f, (SELECT sum(y.x * z.x) FROM p y JOIN p z ON y.i = z.i WHERE y.label = a AND z.label = b) AS g FROM k)
SELECT a, b, round(f, 6) AS score_whole, round(g, 6) AS score_part, g < f - 0.01 AS lowered FROM s""",
    "neighbors_of_pairs": """WITH e AS (SELECT label AS family, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT family, i, sum(CAST(x AS DOUBLE)) AS s FROM e GROUP BY 1, 2), n AS (SELECT family, sqrt(sum(s * s)) AS n FROM s GROUP BY 1),
f AS (SELECT s.family, s.i, s.s / n.n AS v FROM s JOIN n USING (family)), p AS (SELECT a.family AS src, b.family AS dst, round(sum(a.v * b.v), 6) AS score FROM f a JOIN f b ON a.i = b.i AND a.family <> b.family GROUP BY 1, 2)
SELECT src, dst, score, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rank FROM p QUALIFY rank <= 3""",
    "small_to_big": """WITH c AS (SELECT l_orderkey AS version, unnest(range(l_linenumber - 1, l_linenumber + l_linenumber % 2 + 2)) AS page FROM lineitem WHERE l_quantity > 40)
SELECT DISTINCT l_orderkey AS version, l_linenumber AS page FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (version, page) FROM c)""",
    "pages_appended": "SELECT CAST(i AS INTEGER) AS _page, count(*) AS n, CAST(sum(o_orderkey - i) AS BIGINT) AS s FROM orders, range(3) t(i) WHERE o_orderkey % 3 <= i GROUP BY 1",
    "measurement_json": """SELECT quality, '[' || string_agg('{"doc_id":' || doc_id || ',"toxic":' || toxic || '}', ',' ORDER BY doc_id) || ']' AS results, count(*) AS n FROM labels WHERE doc_id % 50 = 0 GROUP BY 1""",
    "corpora_united": "SELECT 'a' AS corpus_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders UNION ALL SELECT 'b', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer",
}
