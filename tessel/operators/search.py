"""Search results: resolved against the catalogue, totally ordered, frozen, paged, replayed and grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve_hits(hits: DataFrame, versions: DataFrame) -> DataFrame:
    """hits: request, version, chunk, score, hit_pos. Hits of unknown versions are dropped, repeated hits stay; pos is the total order."""
    found = hits.join(versions, "version")
    order = Window.partitionBy("request").orderBy(F.desc("score"), "version", "chunk", "hit_pos")
    return found.withColumn("pos", F.row_number().over(order) - 1)


def page(results: DataFrame, offset: Column | int, limit: int) -> DataFrame:
    """Rows offset to offset + limit of the frozen order."""
    return results.where((F.col("pos") >= offset) & (F.col("pos") < F.lit(offset) + limit))


def encode_cursor(request: Column, offset: Column) -> Column:
    """URL-safe base64 of request:offset."""
    return F.translate(F.base64(F.encode(F.concat_ws(":", request.cast("string"), offset.cast("string")), "UTF-8")), "+/\r\n", "-_")


def decode_cursor(cursor: Column) -> tuple[Column, Column]:
    text = F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8")
    offset = F.substring_index(text, ":", -1)
    return F.substring(text, F.lit(1), F.length(text) - F.length(offset) - 1), offset.cast("int")


def freeze(results: DataFrame) -> DataFrame:
    """One row for each request: all its hits in order, as they were."""
    row = F.struct("pos", *[c for c in results.columns if c not in ("pos", "request")])
    return results.groupBy("request").agg(F.array_sort(F.collect_list(row)).alias("raw_hits"), F.count(F.lit(1)).alias("total"))


def replay(frozen: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Does recomputing give what was frozen?"""
    new = freeze(recomputed).select("request", F.col("raw_hits").alias("now"))
    return frozen.join(new, "request", "left").select("request", F.col("raw_hits").eqNullSafe(F.col("now")).alias("matches"))


def by_process(results: DataFrame) -> DataFrame:
    """Processes in the order of their first hit, with the rounded mean and the largest adherence (score * 100, half up)."""
    adherence = F.floor(F.col("score") * 100 + 0.5)
    g = results.withColumn("adherence", adherence).groupBy("request", F.coalesce("process", "family").alias("group"))
    out = g.agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("hits"), F.floor(F.avg("adherence") + 0.5).alias("coverage"), F.greatest(F.max("adherence"), F.lit(0)).alias("best"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("first")))


def nested_by_process(results: DataFrame) -> DataFrame:
    """results: request, pos, process, family, version, chunk, score. A row for each request and process (its family where it has none), in order of the first hit: rank, lead (that
    hit), adherence (its score * 100, half up), very_relevant (0.85 or more), and documents: its families in order of their first hits, each with all its hits.
    ``average`` is the mean of a request's adherences, half up."""
    hit = F.struct("pos", "version", "chunk", "score")
    group = F.coalesce(F.col("process"), F.col("family")).alias("group")
    families = results.groupBy("request", group, "family").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    one = F.struct(F.get("hits", F.lit(0))["pos"].alias("first"), "family", "hits")
    out = families.groupBy("request", "group").agg(F.array_sort(F.collect_list(one)).alias("documents"))
    lead = F.get(F.get("documents", F.lit(0))["hits"], F.lit(0))
    out = out.withColumn("lead", lead).withColumn("adherence", F.floor(F.col("lead.score") * 100 + 0.5))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy("lead.pos")))
    return out.withColumn("very_relevant", F.col("lead.score") >= 0.85).withColumn("average", F.floor(F.avg("adherence").over(Window.partitionBy("request")) + 0.5))
