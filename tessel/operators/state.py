"""State kept in append-only logs and keyed tables: replay with tombstones, upserts, deletes, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replay(log: DataFrame, key: str, group: str, seq: str, is_tombstone: Column) -> DataFrame:
    """The rows that a log leaves: the last write of each key that no later tombstone of its group has removed. Two aggregations."""
    graves = log.where(is_tombstone).groupBy(group).agg(F.max(seq).alias("_grave"))
    puts = log.where(~is_tombstone)
    last = puts.groupBy(key).agg(F.max_by(F.struct(*puts.columns), seq).alias("_r")).select("_r.*")
    return last.join(graves, group, "left").where(F.col("_grave").isNull() | (F.col("_grave") < F.col(seq))).drop("_grave")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old rows with the same key; new has one row for each key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def replace_versions(old: DataFrame, new: DataFrame, version: str) -> DataFrame:
    """All old rows of versions that arrive anew go, even if fewer rows come."""
    return delete(old, new, [version]).unionByName(new)


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet: idempotent indexing."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def deleted_counts(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """How many rows each key of ``gone`` has, 0 for unknown keys: what ``delete`` takes away."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return gone.select(key).distinct().join(n, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(0).cast("long")))


def reindex(stored: DataFrame, sent: DataFrame, model: str) -> DataFrame:
    """Rows of other models stay; those of ``model`` are what is sent, and nothing else."""
    return stored.where(~F.col("model").eqNullSafe(F.lit(model))).unionByName(sent.withColumn("model", F.lit(model)))


def rebuild(log: DataFrame, key: str, group: str, seq: str, is_tombstone: Column, batch: int = 500) -> DataFrame:
    """What a log leaves, in numbered batches of about ``batch`` rows by hash; a log that leaves nothing is an error."""
    rows = replay(log, key, group, seq, is_tombstone)
    n = rows.count()
    if not n:
        raise ValueError("nothing to rebuild from")
    return rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(-(-n // batch))))


def reset(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables emptied, and how many rows each had (name, deleted)."""
    counts = [t.agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("name"), "deleted") for name, t in tables.items()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return {name: t.where(F.lit(False)) for name, t in tables.items()}, total


def content_hashes(files: DataFrame, cache: DataFrame, content: str = "content") -> DataFrame:
    """files: path, length, modificationTime, content; cache: path, length, modificationTime, sha256. Each file's hash: the cache's where all three
    agree, else of its content. Only the files without one are read."""
    key = ["path", "length", "modificationTime"]
    known = files.select(*key).join(cache.select(*key, "sha256"), key)
    fresh = files.join(cache.select(*key), key, "left_anti").select(*key, F.sha2(content, 256).alias("sha256"))
    return known.withColumn("cached", F.lit(True)).unionByName(fresh.withColumn("cached", F.lit(False)))
