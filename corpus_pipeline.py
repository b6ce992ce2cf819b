"""A corpus pipeline of five stages; each gets what its predecessor wrote.

Toxic documents go, of each group of near copies the one with the smallest doc_id stays, documents that leak a benchmark passage go, sources are
mixed to their target weights, and the mix is written as token files. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import decontamination, mixing, ngram_jaccard, simple8b, toxicity
from tessel.llm._store import Workspace, table

ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; all labels are learned from.

    Null and empty texts have the score of texts without hits; rows that repeat are judged each; an empty table stays empty.
    """
    held = {c: f"_{j}" for j, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # no column of docs gives way to a score
    scored = toxicity.toxicity(spark, docs.withColumnsRenamed(held), table(spark, sf_dir, "labels"), Workspace(spark, "p-toxicity"), keep_text=True)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8: that with the smallest doc_id.

    Documents without words or without doc_id are in no group and stay; rows that share the smallest doc_id are one document, of which the
    first text stays.
    """
    groups = ngram_jaccard.ngram_components(spark, docs.select("doc_id", "text"), Workspace(spark, "p-copies"), k=5, num=4, den=5)
    gone = groups.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("_i")).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col("_i"), "left_anti")
    twice = groups.where(F.col("n_shingles") > 0).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_j"))
    repeated = left.join(twice, F.col("doc_id") == F.col("_j"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    once = repeated.withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return left.join(twice, F.col("doc_id") == F.col("_j"), "left_anti").unionByName(once)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay. Rows with the doc_id of a leak go with it; rows without doc_id stay. An empty table stays empty.
    """
    found = decontamination.leaks(spark, docs, table(spark, sf_dir, "benchmark"), Workspace(spark, "p-leaks"))
    return docs.join(found.select(F.col("doc_id").alias("_i")).distinct(), F.col("doc_id") == F.col("_i"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the schedule takes its words, to the nearest whole number (up to three times), in order of the schedule.

    A document's n-th copy stands where the schedule takes its first block for the n-th time, and partitions follow each other in that order, too.
    Documents without words are taken once and come first. Of rows with equal doc_id, source and number of words each is taken as often as
    the one that is taken most. A null doc_id or source is a value like others. An empty table stays empty.
    """
    taken, _ = mixing.mix(spark, docs, Workspace(spark, "p-mixing"))
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    least = F.min_by("positions", F.get("positions", F.lit(0)))
    times = taken.groupBy(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z")).agg(F.max(times).alias("_times"), least.alias("_places"), F.max("span").alias("_span")).where("_times > 0")
    rows = docs.withColumn("_size", mixing.word_count(F.col("text")))
    same = rows["doc_id"].eqNullSafe(times["_i"]) & rows["source"].eqNullSafe(times["_s"]) & (rows["_size"] == times["_z"])
    copies = rows.join(times, same).withColumn("_copy", F.explode(F.expr("sequence(0, _times - 1)")))
    at = F.coalesce(F.get("_places", F.least(F.col("_copy"), F.size("_places") - 1)), F.lit(0))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    copies = copies.withColumn("_at", at)
    copies = copies.repartitionById(parts, F.floor(F.col("_at") / F.col("_span") * parts).cast("int"))
    return copies.sortWithinPartitions("_at", "doc_id", "_copy").select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of the mix, read back from the token files, which keep the order of the mix.

    Null texts are empty, and have their end token like any other; repeated rows are written each; an empty table gives no rows.
    """
    import public_tokenizers

    return simple8b.encode_documents(spark, docs, public_tokenizers.path(simple8b.TOKENIZER), stored_order=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    ws, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
