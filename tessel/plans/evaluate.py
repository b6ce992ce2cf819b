"""Evaluation queries: recall, gates and the comparison of two rankings.

Queries are all vectors whose id is divisible by 50. Names with ``_whole`` are older names of the same.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators.tiles import nearest


def _ranked(spark, d, flip: bool = False, most: int = 5, by_label: bool = False):
    """The first ``most`` neighbours of each query vector in two rankings: by dot product, or by it rounded."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("request"), F.col("embedding").alias("q"), F.col("label").alias("golden"))
    near = nearest(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label"), q, most, 1 if flip else 6, False, by_label)
    return near.join(q.select("request", "golden"), "request").select(F.col("request").alias("query"), "golden", F.col("id").alias("vec_id"), "label", "score", "rank")


def recall_at_k(spark, d):
    """Share of each query's golden processes (its label and the next) among the first three hits; unit: chunk."""
    r = _ranked(spark, d).where("rank <= 3")
    golden = F.array(F.col("golden"), (F.col("golden") + 1) % 10)
    hit = F.size(F.array_intersect(F.array_distinct(F.collect_list("label")), F.first(golden)))
    return r.groupBy("query").agg((hit / 2.0).alias("recall"))


def recall_by_process(spark, d):
    """The same over the first three distinct processes."""
    r = _ranked(spark, d, most=3, by_label=True).groupBy("query", "golden", "label").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query").orderBy("rank")
    top = r.withColumn("place", F.row_number().over(w)).where("place <= 3")
    hits = F.count_if(F.col("label").isin(F.col("golden")) | (F.col("label") == (F.col("golden") + 1) % 10))
    return top.groupBy("query").agg((hits / 2.0).alias("recall"))


def gate_all(spark, d):
    r = recall_at_k(spark, d)
    return r.agg(F.bool_and(F.col("recall") >= 0.5).alias("all_passed"), F.count_if(F.col("recall") >= 0.5).alias("passed"), F.count(F.lit(1)).alias("n"))


def rank_compare(spark, d):
    """Two rankings side by side, cut at five."""
    a = _ranked(spark, d).where("rank <= 5").select("query", "rank", F.col("vec_id").alias("left_id"))
    b = _ranked(spark, d, True).where("rank <= 5").select("query", "rank", F.col("vec_id").alias("right_id"))
    return a.join(b, ["query", "rank"]).select("query", "rank", "left_id", "right_id", (F.col("left_id") == F.col("right_id")).alias("same"))


def rank_sets(spark, d):
    """Are the first three labels equal as sets, and what has only one of them?"""
    top = lambda flip: _ranked(spark, d, flip).where("rank <= 3").groupBy("query").agg(F.array_sort(F.collect_set("label")).alias("s"))
    a, b = top(False).withColumnRenamed("s", "a"), top(True).withColumnRenamed("s", "b")
    text = lambda c: F.array_join(c, ",")
    return a.join(b, "query").select("query", (F.col("a") == F.col("b")).alias("equal"), text(F.array_except("a", "b")).alias("only_a"), text(F.array_except("b", "a")).alias("only_b"))


def label_buckets(spark, d):
    """Documents by label pair, with shares rounded half up as a display does."""
    x = spark.read.parquet(f"{d}/labels.parquet").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    total = x.agg(F.sum("n").alias("t"))
    return x.crossJoin(F.broadcast(total)).select("quality", "toxic", "n", F.floor(F.col("n") * 100 / F.col("t") + 0.5).alias("percent"))


def cost_estimate(spark, d):
    """US$ for embedding each source's texts, at four characters a token and the published price."""
    return spark.read.parquet(f"{d}/documents.parquet").groupBy("source").agg(F.sum("n_chars").alias("chars")).select("source", F.round(F.col("chars") / 4 * 0.02 / 1e6, 8).alias("usd"))


def _r(digits: int, name: str) -> str:
    return f"""{name}0 AS (SELECT q.vec_id AS query, any_value(q.label) AS golden, e.vec_id, any_value(e.label) AS label, round(sum(CAST(q.x AS DOUBLE) * CAST(e.x AS DOUBLE)), {digits}) AS score
  FROM v q JOIN v e ON q.vec_id % 50 = 0 AND q.i = e.i AND q.vec_id <> e.vec_id GROUP BY q.vec_id, e.vec_id),
{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM {name}0)"""


_V = "WITH v AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), "
_RECALL = "SELECT query, count(DISTINCT label) FILTER (WHERE label = golden OR label = (golden + 1) % 10) / 2.0 AS recall FROM a WHERE rank <= 3 GROUP BY 1"
QUERIES = {f.__name__: f for f in (recall_at_k, recall_by_process, gate_all, rank_compare, rank_sets, label_buckets, cost_estimate)}
QUERIES |= {f"{f.__name__}_whole": f for f in (recall_at_k, recall_by_process, gate_all, rank_compare, rank_sets)}
ORACLE = {
    "recall_at_k": _V + _r(6, "a") + _RECALL.join([" ", ""]),
    "recall_by_process": _V + _r(6, "a") + """, p AS (SELECT query, golden, label, min(rank) AS rank FROM a GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY min(rank)) <= 3)
SELECT query, count(*) FILTER (WHERE label = golden OR label = (golden + 1) % 10) / 2.0 AS recall FROM p GROUP BY 1""",
    "gate_all": _V + _r(6, "a") + f" SELECT bool_and(recall >= 0.5) AS all_passed, count(*) FILTER (WHERE recall >= 0.5) AS passed, count(*) AS n FROM ({_RECALL})",
    "rank_compare": _V + _r(6, "a") + ", " + _r(1, "b") + " SELECT a.query, a.rank, a.vec_id AS left_id, b.vec_id AS right_id, a.vec_id = b.vec_id AS same FROM a JOIN b ON a.query = b.query AND a.rank = b.rank WHERE a.rank <= 5",
    "rank_sets": _V + _r(6, "a") + ", " + _r(1, "b") + """, x AS (SELECT query, list_sort(list(DISTINCT label)) AS s FROM a WHERE rank <= 3 GROUP BY 1), y AS (SELECT query, list_sort(list(DISTINCT label)) AS s FROM b WHERE rank <= 3 GROUP BY 1)
SELECT x.query, x.s = y.s AS equal, array_to_string(list_filter(x.s, lambda z: NOT list_contains(y.s, z)), ',') AS only_a, array_to_string(list_filter(y.s, lambda z: NOT list_contains(x.s, z)), ',') AS only_b FROM x JOIN y USING (query)""",
    "label_buckets": "SELECT quality, toxic, count(*) AS n, CAST(floor(count(*) * 100.0 / sum(count(*)) OVER () + 0.5) AS BIGINT) AS percent FROM labels GROUP BY 1, 2",
    "cost_estimate": "SELECT source, round(sum(n_chars) / 4 * 0.02 / 1e6, 8) AS usd FROM documents GROUP BY 1",
}
ORACLE |= {f"{n}_whole": ORACLE[n] for n in ("recall_at_k", "recall_by_process", "gate_all", "rank_compare", "rank_sets")}
