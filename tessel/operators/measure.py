"""What the evaluation of a search measures: canonical processes, recall with its gate, vectors of sections, and neighbours from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.vectors import dot, norm

#: What the headings of sections with grounds hold.
GROUNDS = ("MOTIVA", "FUNDAMENTA", "MERITO", "MÉRITO")


def has_grounds(section: Column) -> Column:
    """Is a section's heading one of grounds? A null one is not."""
    upper = F.upper(section)
    found = F.lit(False)
    for word in GROUNDS:
        found = found | upper.contains(word)
    return F.coalesce(found, F.lit(False))


def canonical(rows: DataFrame, mapping: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """mapping: raw, canonical. The column's canonical value; an unknown one is an error (strict), or stays. Null stays null."""
    met = rows.join(mapping.select(F.col("raw").alias("_raw"), "canonical"), F.col(column) == F.col("_raw"), "left").drop("_raw")
    unknown = F.raise_error(F.concat(F.lit("unknown: "), F.col(column))).cast(rows.schema[column].dataType) if strict else F.col(column)
    return met.withColumn(column, F.when(F.col("canonical").isNotNull(), F.col("canonical")).when(F.col(column).isNotNull(), unknown)).drop("canonical")


def recall_side(hits: DataFrame, golden: DataFrame, k: int, least: int) -> DataFrame:
    """hits: query, rank, process; golden: query, process. For each query the distinct processes of its first k hits in order, those that are golden,
    recall, and whether at least ``least`` of them are."""
    places = hits.where((F.col("rank") <= k) & F.col("process").isNotNull()).groupBy("query", "process").agg(F.min("rank").alias("rank"))
    wanted = golden.distinct()
    met = places.join(wanted.withColumn("golden", F.lit(True)), ["query", "process"], "left")
    found = met.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "process"))).alias("p"), F.array_sort(F.collect_list(F.when(F.col("golden"), F.col("process")))).alias("in_golden"))
    size = wanted.groupBy("query").agg(F.count(F.lit(1)).alias("denominator"))
    out = size.join(found, "query", "left")
    processes, in_golden = F.coalesce(F.transform("p", lambda x: x["process"]), F.array().cast(f"array<{hits.schema['process'].dataType.simpleString()}>")), F.coalesce("in_golden", F.array().cast(f"array<{hits.schema['process'].dataType.simpleString()}>"))
    return out.select("query", processes.alias("processes"), in_golden.alias("in_golden"), "denominator", (F.size(in_golden) / F.col("denominator")).alias("recall"), (F.size(in_golden) >= least).alias("passed"))


def mean_vectors(chunks: DataFrame, family: str, vector: str, kept: Column | None = None) -> DataFrame:
    """family, n and v: the mean of its vectors (of those that are ``kept``), scaled to length one. A zero mean is an error; a family without such
    vectors has n 0 and no v."""
    own = F.lit(True) if kept is None else kept
    parts = chunks.where(own).select(F.col(family).alias("family"), F.posexplode(vector).alias("i", "x")).groupBy("family", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = parts.groupBy("family").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("m")).withColumn("l", norm(F.col("m")))
    zero = F.raise_error(F.concat(F.lit("zero vector: "), F.col("family").cast("string"))).cast("double")
    safe = whole.select("family", F.transform("m", lambda x: x / F.when(F.col("l") > 0, F.col("l")).otherwise(zero)).alias("v"))
    n = chunks.groupBy(F.col(family).alias("family")).agg(F.count_if(own).alias("n"))
    return n.join(safe, "family", "left")


def compare_aggregations(pairs: DataFrame, whole: DataFrame, part: DataFrame) -> DataFrame:
    """pairs: a, b; whole, part: family, v of two ways. Both scores of each pair (null where a vector is missing), and whether the part lowers it by more than 0.01."""
    side = lambda t, c, n: t.select(F.col("family").alias(c), F.col("v").alias(n))
    met = pairs.join(side(whole, "a", "wa"), "a", "left").join(side(whole, "b", "wb"), "b", "left").join(side(part, "a", "pa"), "a", "left").join(side(part, "b", "pb"), "b", "left")
    scored = met.select("a", "b", dot(F.col("wa"), F.col("wb")).alias("score_whole"), dot(F.col("pa"), F.col("pb")).alias("score_part"))
    return scored.withColumn("lowered", F.col("score_part") < F.col("score_whole") - 0.01)


def top_of_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """pairs: a, b, score, each once. The k best others of each family, from either side of a pair; ties by the other's id."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def widened_pages(chunks: DataFrame, pages: DataFrame, by: int = 1) -> DataFrame:
    """chunks: version, page_start, page_end; pages: version, page. The pages of each version's chunks and ``by`` more on either side, as far as there
    are such, each once."""
    near = chunks.select("version", F.explode(F.sequence(F.col("page_start") - by, F.col("page_end") + by)).alias("page")).distinct()
    return pages.join(near, ["version", "page"], "left_semi")


def appended(pages: list[DataFrame]) -> DataFrame:
    """Result pages behind each other, repeated rows included; ``pos`` runs on over all of them."""
    out = None
    for i, p in enumerate(pages):
        rows = p.withColumn("_page", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("pos", F.struct("_page", "pos")).drop("_page")


def measurement(rows: DataFrame, *group: str) -> DataFrame:
    """One JSON text for each group (or for all rows) with the other columns as its results, in order of their texts."""
    values = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*values)))).alias("results"), F.count(F.lit(1)).alias("n"))
