"""Versions, families, processes and themes.

Version tables have family, version, day (a comparable column) and whatever else is asked for. Ties of a day go to the smallest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def face_version(versions: DataFrame, family: str = "family", version: str = "version", day: str = "day") -> DataFrame:
    """The latest version of each family: an aggregation, so partial results are combined before the shuffle."""
    best = F.max_by(F.struct(*versions.columns), F.struct(F.col(day), -F.col(version)))
    return versions.groupBy(family).agg(best.alias("f")).select("f.*")


def family_summary(versions: DataFrame) -> DataFrame:
    best = F.max_by("version", F.struct("day", -F.col("version")))
    return versions.groupBy("family").agg(best.alias("face"), F.count(F.lit(1)).alias("versions_count"), F.max("day").alias("latest"))


def timeline(versions: DataFrame) -> DataFrame:
    """Versions newest first, numbered."""
    w = Window.partitionBy("family").orderBy(F.desc("day"), "version")
    return versions.withColumn("pos", F.row_number().over(w))


def select_version(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: family, requested. The requested version if the family has it, else the face."""
    both = versions.join(wanted, "family")
    best = F.max_by("version", F.struct((F.col("version") == F.col("requested")).cast("int"), "day", -F.col("version")))
    return both.groupBy("family").agg(F.coalesce(best, F.lit(None)).alias("version"))


def process_summary(families: DataFrame, faces: DataFrame, kind: Column) -> DataFrame:
    """families: family, process. Latest date, its type, number of pieces and sorted distinct types of each process."""
    pieces = faces.join(families, "family").withColumn("kind", kind)
    latest = F.max_by(F.struct("kind", "version"), F.struct("day", -F.col("version")))
    out = pieces.groupBy("process").agg(F.max("day").alias("latest"), latest.alias("l"), F.count(F.lit(1)).alias("pieces"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return out.select("process", "latest", F.col("l.kind").alias("latest_kind"), F.col("l.version").alias("latest_version"), "pieces", "kinds")


def lookup_or(rows: DataFrame, dimension: DataFrame, on: str, value: str, fallback: str) -> DataFrame:
    """A dimension's value, the fallback where the key is missing."""
    return rows.join(dimension.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(fallback)))


def groups_with_members(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Sorted members of each key; rows without key are skipped."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))


def numbered(rows: DataFrame, by: str, then: str, pos: str = "pos") -> DataFrame:
    """Rows with their place by two columns, both descending: rows of larger values of the first are counted, those of an equal one numbered by the
    second. Only the first column's values meet in one task."""
    n = rows.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n"))
    before = n.select("_by", (F.sum("_n").over(Window.orderBy(F.desc("_by"))) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(then)))
    return rows.withColumn("_own", own).join(before, F.col(by).eqNullSafe(F.col("_by"))).withColumn(pos, (F.col("_before") + F.col("_own")).cast("int")).drop("_by", "_before", "_own")


def opinion(versions: DataFrame, families: dict[str, object]) -> DataFrame:
    """versions: family, version, day. One row: the face version of each named family, and n_<name>, how many versions it has. A family without versions is an error."""
    own = versions.where(F.col("family").isin(*families.values()))
    of = lambda k, c: F.when(F.col("family") == k, c)
    counts = {f"n_{name}": F.count_if(F.col("family") == k) for name, k in families.items()}
    faces = {name: F.max_by(of(k, F.col("version")), of(k, F.struct("day", -F.col("version")))) for name, k in families.items()}
    row = own.agg(*(f.alias(n) for n, f in (faces | counts).items()))
    lacking = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c[2:])) for c in counts]))
    whole = lambda c: F.when(F.size(lacking) == 0, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("incomplete, no versions of: "), F.array_join(lacking, ", "))).cast(row.schema[c].dataType))
    return row.select(*[whole(c).alias(c) for c in row.columns])
