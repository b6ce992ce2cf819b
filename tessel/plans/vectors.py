"""Family vectors, their neighbours, and vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vectors import dot, unit
from tessel.operators import tiles
from tessel.operators.tiles import nearest
from tessel.sources.shared import written


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def family_vectors(chunks: DataFrame, family: str, vector: str) -> DataFrame:
    """(family, v): the element-wise sum of a family's vectors, scaled to length one."""
    parts = chunks.select(F.col(family).alias("family"), F.posexplode(vector).alias("i", "x"))
    sums = parts.groupBy("family", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    whole = sums.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("i", "s"))).alias("p"))
    return whole.select("family", unit(F.col("p.s")).alias("v"))


def neighbors(families: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest other families of each family, whatever type its key has; ties by family. k below 1 is an error."""
    vectors = families.select(F.col("family").alias("id"), "v", F.lit(0).alias("label"))
    near = nearest(vectors, None, k, digits=12, own=False)
    return near.select(F.col("request").alias("src"), F.col("id").alias("dst"), "score", "rank")


def family_neighbors(spark: SparkSession, d: str) -> DataFrame:
    out = neighbors(_fam(spark, d), 3)
    return out.select("src", "dst", F.round("score", 6).alias("score"), "rank")


def family_pairs(families: DataFrame, least: float | None = None, most: float | None = None, digits: int = 15) -> DataFrame:
    """Each unordered pair once, the smaller family first; with ``least``, only the pairs of the band from it to below ``most``."""
    return tiles.pairs(families.select(F.col("family").alias("id"), "v"), least, most, digits)


def band(score, similar: float, same: float):
    return F.when(score >= same, "fusion").when(score >= similar, "similar").otherwise("unrelated")


def top_chunks(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k chunks with the largest dot product with the one query row (q); ties by key. Top-k runs in each partition first."""
    scored = chunks.crossJoin(F.broadcast(query.limit(1))).select("key", dot(F.col("v"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k)


def _fam(spark, d):
    return family_vectors(_read(spark, d, "embeddings"), "label", "embedding")


def _named(spark, d):
    """Families with text keys: five vectors each."""
    e = _read(spark, d, "embeddings").select(F.concat(F.lit("fam-"), F.floor(F.col("vec_id") / 5)).alias("key"), "embedding")
    return written(family_vectors(e, "key", "embedding"), "families")[0]


def vector_topk(spark, d):
    e = _read(spark, d, "embeddings")
    out = top_chunks(e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), e.where("vec_id = 0").select(F.col("embedding").alias("q")), 10)
    return out.select(F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def family_centroid(spark, d):
    return _fam(spark, d).select("family", F.posexplode("v").alias("i", "x")).select("family", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def family_mean_centroid(spark, d):
    """Mean, then unit length: equal to the sum's direction. A zero vector raises."""
    e = _read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    n = m.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    safe = F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(F.raise_error(F.lit("zero vector")).cast("double"))
    return m.join(n, "label").select("label", F.col("i").cast("long").alias("i"), F.round(safe, 6).alias("x"))


def similarity_pairs(spark, d):
    return family_pairs(_fam(spark, d)).select("a", "b", F.round("score", 6).alias("score"))


def similarity_matrix(spark, d):
    """Both directions of every pair."""
    p = family_pairs(_fam(spark, d)).withColumn("score", F.round("score", 6))
    return p.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "score"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))))


def similarity_bands(spark, d):
    p = family_pairs(_fam(spark, d))
    return p.select("a", "b", band(F.round("score", 6), 0.1, 0.25).alias("band"))


def band_counts(spark, d):
    p = family_pairs(_fam(spark, d)).select(band(F.round("score", 6), 0.1, 0.25).alias("band"))
    return p.agg(*(F.count_if(F.col("band") == b).alias(b) for b in ("unrelated", "similar", "fusion")))


def similarity_edges(spark, d):
    """Edges between families of which either lists the other in its top three, within the band; each pair once."""
    n = neighbors(_fam(spark, d), 3).withColumn("score", F.round("score", 6))
    kept = n.where((F.col("score") >= 0.1) & (F.col("score") < 0.25))
    return kept.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "score").dropDuplicates(["a", "b"])


def bucket_describe(spark, d):
    """n, min, max, mean and exact median of pair scores for each bucket; an empty bucket has n = 0."""
    p = family_pairs(_fam(spark, d)).withColumn("bucket", F.when((F.col("a") + F.col("b")) % 2 == 0, "same").when(F.col("a") == 1, "type").otherwise("different"))
    names = spark.createDataFrame([("same",), ("type",), ("different",), ("none",)], "bucket string")
    return described(p, "bucket", names)


def described(pairs: DataFrame, bucket: str, names: DataFrame, digits: int = 6) -> DataFrame:
    """names: all buckets. n, low, high, mean and median of each bucket's scores, rounded to six digits (the median to ``digits``: that of an even number of scores with six digits has
    seven). The pairs are read twice and kept nowhere."""
    found = tiles.measures(pairs, bucket, "score").select(bucket, "n", *(F.round(c, 6).alias(c) for c in ("low", "high", "mean")), F.round("median", digits).alias("median"))
    return names.join(found, bucket, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def named_neighbors(spark, d):
    """The three nearest of families with text keys."""
    return neighbors(_named(spark, d), 3).select("src", "dst", F.round("score", 6).alias("score"), "rank")


def named_band(spark, d):
    """Pairs of families with text keys in a band, in order of score; only the band's pairs are made."""
    return family_pairs(_named(spark, d), 0.3, 0.97, 6).orderBy(F.desc("score"), "a", "b")


def band_describe(spark, d):
    """The same measures over the pairs of that band alone, by whether both families stand in the same hundred."""
    p = family_pairs(_named(spark, d), 0.3, 0.97, 6)
    near = (F.length("a") == F.length("b")) & (F.substring("a", 1, 6) == F.substring("b", 1, 6))
    return described(p.withColumn("bucket", F.when(near, "near").otherwise("far")), "bucket", spark.createDataFrame([("near",), ("far",)], "bucket string"), digits=7)


def largest_pair(spark, d):
    p = family_pairs(_fam(spark, d))
    return p.agg(F.round(F.max("score"), 6).alias("largest"), F.count(F.lit(1)).alias("pairs"))


def known_pairs(spark, d):
    """The scores of named pairs (each family and the next), the largest score of all, and whether the pair has it. Null where a family is unknown."""
    fam = _fam(spark, d)
    known = fam.select(F.col("family").alias("a"), (F.col("family") + 1).alias("b"))
    return pair_scores(fam, known).select("a", "b", F.round("score", 6).alias("score"), F.round("largest", 6).alias("largest"), F.coalesce(F.round("score", 9) == F.round("largest", 9), F.lit(False)).alias("is_largest"))


def pair_scores(families: DataFrame, known: DataFrame) -> DataFrame:
    """known: a, b. Each known pair with its own score, and the largest score of all pairs of families: a maximum in each cell, merged."""
    one = lambda c: families.select(F.col("family").alias(c), F.col("v").alias(f"v_{c}"))
    met = known.join(one("a"), "a", "left").join(one("b"), "b", "left").select("a", "b", dot(F.col("v_a"), F.col("v_b")).alias("score"))
    largest = family_pairs(families).agg(F.max("score").alias("largest"))
    return met.join(F.broadcast(largest), F.lit(True), "left")  # one row


_FAMILIES = """
WITH e AS (SELECT label AS family, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT family, i, sum(CAST(x AS DOUBLE)) AS s FROM e GROUP BY 1, 2),
n AS (SELECT family, sqrt(sum(s * s)) AS n FROM s GROUP BY 1),
f AS (SELECT s.family, s.i, CASE WHEN n.n = 0 THEN s.s ELSE s.s / n.n END AS v FROM s JOIN n USING (family)),
p AS (SELECT a.family AS src, b.family AS dst, sum(a.v * b.v) AS score FROM f a JOIN f b ON a.i = b.i AND a.family <> b.family GROUP BY 1, 2)
"""

_NAMED = _FAMILIES.replace("SELECT label AS family", "SELECT 'fam-' || CAST(floor(vec_id / 5) AS BIGINT) AS family")
_PAIRS = _FAMILIES + ", u AS (SELECT src AS a, dst AS b, round(score, 6) AS score, score AS exact FROM p WHERE src < dst)"
_BAND = "CASE WHEN score >= 0.25 THEN 'fusion' WHEN score >= 0.1 THEN 'similar' ELSE 'unrelated' END"
QUERIES = {f.__name__: f for f in (family_neighbors, vector_topk, family_centroid, family_mean_centroid, similarity_pairs, similarity_matrix, similarity_bands, band_counts, similarity_edges, bucket_describe, largest_pair, known_pairs, named_neighbors, named_band, band_describe)}
ORACLE = {
    "family_neighbors": _FAMILIES + """
SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p) WHERE rank <= 3""",
    "vector_topk": """WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT a.vec_id, round(sum(CAST(a.x AS DOUBLE) * CAST(q.x AS DOUBLE)), 6) AS score FROM e a JOIN e q ON q.vec_id = 0 AND a.i = q.i GROUP BY 1 ORDER BY sum(CAST(a.x AS DOUBLE) * CAST(q.x AS DOUBLE)) DESC, 1 LIMIT 10""",
    "family_centroid": _FAMILIES + "SELECT family, i - 1 AS i, round(v, 6) AS x FROM f",
    "family_mean_centroid": _FAMILIES + "SELECT family AS label, i - 1 AS i, round(v, 6) AS x FROM f",
    "similarity_pairs": _PAIRS + "SELECT a, b, score FROM u",
    "similarity_matrix": _FAMILIES + "SELECT src, dst, round(score, 6) AS score FROM p",
    "similarity_bands": _PAIRS + f"SELECT a, b, {_BAND} AS band FROM u",
    "band_counts": _PAIRS + f"SELECT count(*) FILTER (WHERE {_BAND} = 'unrelated') AS unrelated, count(*) FILTER (WHERE {_BAND} = 'similar') AS similar, count(*) FILTER (WHERE {_BAND} = 'fusion') AS fusion FROM u",
    "similarity_edges": _FAMILIES + """, r AS (SELECT src, dst, round(score, 6) AS score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM p)
SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b, score FROM r WHERE rank <= 3 AND score >= 0.1 AND score < 0.25""",
    "bucket_describe": _PAIRS + """, k AS (SELECT *, CASE WHEN (a + b) % 2 = 0 THEN 'same' WHEN a = 1 THEN 'type' ELSE 'different' END AS bucket FROM u)
SELECT n.bucket, count(a) AS n, round(min(exact), 6) AS low, round(max(exact), 6) AS high, round(avg(exact), 6) AS mean, round(median(exact), 6) AS median
FROM (VALUES ('same'), ('type'), ('different'), ('none')) n(bucket) LEFT JOIN k ON k.bucket = n.bucket GROUP BY 1""",
    "known_pairs": _PAIRS + """, m AS (SELECT max(exact) AS largest FROM u)
SELECT f.family AS a, f.family + 1 AS b, score, round(largest, 6) AS largest, coalesce(round(exact, 9) = round(largest, 9), false) AS is_largest FROM (SELECT DISTINCT family FROM f) f LEFT JOIN u ON u.a = f.family AND u.b = f.family + 1 CROSS JOIN m""",
    "named_neighbors": _NAMED + """
SELECT src, dst, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, dst) AS rank FROM p) WHERE rank <= 3""",
    "named_band": _NAMED + "SELECT src AS a, dst AS b, round(score, 6) AS score FROM p WHERE src < dst AND round(score, 6) >= 0.3 AND round(score, 6) < 0.97",
    "band_describe": _NAMED + """, u AS (SELECT round(score, 6) AS s, CASE WHEN length(src) = length(dst) AND substr(src, 1, 6) = substr(dst, 1, 6) THEN 'near' ELSE 'far' END AS bucket
  FROM p WHERE src < dst AND round(score, 6) >= 0.3 AND round(score, 6) < 0.97)
SELECT n.bucket, count(s) AS n, min(s) AS low, max(s) AS high, round(avg(s), 6) AS mean, round(median(s), 7) AS median FROM (VALUES ('near'), ('far')) n(bucket) LEFT JOIN u ON u.bucket = n.bucket GROUP BY 1""",
    "largest_pair": _PAIRS + "SELECT max(score) AS largest, count(*) AS pairs FROM u",
}
