"""Edges between nodes: adjacency from both ends, merges by natural key, references and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_KEY = ("source", "source_kind", "target", "target_kind", "type")
#: Fixed value: the edge kinds that count as related documents.
RELATED = ("referencia", "revoga", "altera", "responde_a", "regula", "similar_a")


def adjacent(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: node. Each node's edges from either end and the opposite end; a self-loop once. Two equi-joins, not an OR."""
    out = edges.join(nodes, edges["source"] == nodes["node"]).select("node", F.col("target").alias("other"), *edges.columns)
    back = edges.where("source <> target").join(nodes, edges["target"] == nodes["node"]).select("node", F.col("source").alias("other"), *edges.columns)
    return out.unionByName(back)


def both_ends(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among the members (node)."""
    return edges.join(members, edges["source"] == members["node"], "left_semi").join(members, edges["target"] == members["node"], "left_semi")


def node_kind(ids: DataFrame, families: DataFrame, processes: DataFrame, edges: DataFrame) -> DataFrame:
    """ids: node. Its kind: family, else process, else what any edge says, else null."""
    f = families.select(F.col("family").alias("node"), F.lit("family").alias("k1")).distinct()
    p = processes.select(F.col("process").alias("node"), F.lit("process").alias("k2")).distinct()
    ends = edges.select(F.col("source").alias("node"), F.col("source_kind").alias("k3")).union(edges.select("target", "target_kind"))
    e = ends.groupBy("node").agg(F.min("k3").alias("k3"))
    return ids.join(f, "node", "left").join(p, "node", "left").join(e, "node", "left").select("node", F.coalesce("k1", "k2", "k3").alias("kind"))


def labelled(ids: DataFrame, names: DataFrame) -> DataFrame:
    """ids: node; names: node, label. The label of each node, its id where there is none."""
    return ids.join(names.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", F.col("node").cast("string")))


def first_wins(edges: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first edge of each key, as an aggregation."""
    return edges.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*edges.columns).alias("row"))).alias("m")).select("m.row.*")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """new over old by key; columns in ``keep`` stay as they are in rows that exist. new has one row for each key."""
    values = [c for c in old.columns if c not in keys]
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in keys], *[F.col(c).alias(f"n_{c}") for c in values], F.lit(True).alias("is_new"))
    o = old.withColumn("is_old", F.lit(True))
    both = o.join(n, [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in keys], "full_outer")
    pick = lambda c: F.when(F.col("is_old") & (F.lit(c in keep) | F.col("is_new").isNull()), F.col(c)).otherwise(F.col(f"n_{c}"))
    return both.select(*[F.coalesce(c, f"n_{c}").alias(c) for c in keys], *[pick(c).alias(c) for c in values])


def unique_targets(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references: number, year, suffix; targets: target, number, year, suffix. References that exactly one target fits, with it: numbers and years
    are equal, suffixes equal or one missing.

    Targets are reduced to the smallest and largest of each key first, so that a reference meets at most two rows, however many targets fit it."""
    ends = lambda name, c: (F.min(c).alias(f"_least_{name}"), F.max(c).alias(f"_most_{name}"))
    bare = F.when(F.col("suffix").isNull(), F.col("target"))
    every = targets.groupBy(F.col("number").alias("_n"), F.col("year").alias("_y")).agg(*ends("any", F.col("target")), *ends("bare", bare))
    own = targets.where("suffix IS NOT NULL").groupBy(F.col("number").alias("_m"), F.col("year").alias("_z"), F.col("suffix").alias("_s")).agg(*ends("own", F.col("target")))
    found = references.join(every, (F.col("number") == F.col("_n")) & (F.col("year") == F.col("_y")))
    found = found.join(own, (F.col("number") == F.col("_m")) & (F.col("year") == F.col("_z")) & (F.col("suffix") == F.col("_s")), "left")
    least = F.when(F.col("suffix").isNull(), F.col("_least_any")).otherwise(F.least("_least_bare", "_least_own"))
    most = F.when(F.col("suffix").isNull(), F.col("_most_any")).otherwise(F.greatest("_most_bare", "_most_own"))
    return found.select(*references.columns, least.alias("target"), most.alias("_top")).where("target = _top").drop("_top")


def resolve_unique(references: DataFrame, targets: DataFrame) -> DataFrame:
    """references: family, number, year, suffix; targets: target, number, year, suffix. A reference resolves if exactly one target fits, see
    ``unique_targets``, and it is another family."""
    return unique_targets(references, targets).where("target <> family").distinct()
