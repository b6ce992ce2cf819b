"""Notifications: fan-out to users, suppression of repeats, openings, digests and their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The closed vocabulary of notification events.
EVENTS = ("notification_generated", "notification_delivered", "notification_suppressed", "notification_opened", "email_digest_generated", "notification_delivered_email")


def fan_out(preferences: DataFrame, documents: DataFrame, most: int | None = None) -> DataFrame:
    """Every user with every document of one job. Preferences are one row a user. Of either side there may be any number: Spark sends a small one to all
    tasks, and deals both in blocks if none is small. A caller may set a limit: more than ``most`` documents are an error then."""
    if most is not None and documents.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} documents in a job")
    return preferences.crossJoin(documents)


def split_new(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Notifications to generate and those suppressed, as (user, version) has one already."""
    return wanted.join(existing.select(*keys), keys, "left_anti"), wanted.join(existing.select(*keys), keys, "left_semi")


def events_of(generated: DataFrame, suppressed: DataFrame, user: str, version: str) -> DataFrame:
    """Two events for a generated notification, one for a suppressed one."""
    two = generated.select(user, version, F.explode(F.array(F.lit(EVENTS[0]), F.lit(EVENTS[1]))).alias("event"))
    return two.unionByName(suppressed.select(user, version, F.lit(EVENTS[2]).alias("event")))


def digest_id(user: Column, job: Column) -> Column:
    return F.concat_ws(":", user.cast("string"), job.cast("string"))


def digests(generated: DataFrame, user: str, job: str, line: Column, order: Column) -> DataFrame:
    """One body for each user and job with at least one notification; lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))
    out = generated.groupBy(user, job).agg(lines.alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select(user, job, digest_id(F.col(user), F.col(job)).alias("email_id"), "n", F.array_join(F.transform("x", lambda r: r["l"]), "\n").alias("body"))


def digest_events(made: DataFrame) -> DataFrame:
    """Two events for each digest: generated, and delivered by the preview mailer."""
    return made.select("user_id", "email_id", F.explode(F.array(F.lit(EVENTS[4]), F.lit(EVENTS[5]))).alias("event"))


def send_once(made: DataFrame, sent: DataFrame) -> DataFrame:
    """Digests that have not been sent, by email_id."""
    return made.join(sent.select("email_id"), "email_id", "left_anti")


def digest_order(sent: DataFrame) -> DataFrame:
    """Digests of each user, the newest first, ties by the larger email_id."""
    return sent.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("email_id"))))


def for_display(notifications: DataFrame, versions: DataFrame, opened: DataFrame) -> DataFrame:
    """notifications: id, version, ...; versions: version, document_id, document_type; opened: id. Each notification with what is known of its version,
    and whether it was opened."""
    seen = opened.select("id").distinct().withColumn("opened", F.lit(True))
    out = notifications.join(versions.select("version", "document_id", "document_type"), "version", "left").join(seen, "id", "left")
    return out.withColumn("opened", F.coalesce("opened", F.lit(False)))


def reason_text(reasons: Column) -> Column:
    """reasons: array of structs (type, relation_type)."""
    one = lambda r: F.when(r["type"] == "novo_documento", "Novo documento").otherwise(F.concat(F.lit("Correlato: "), F.coalesce(r["relation_type"], F.lit(""))))
    return F.array_join(F.transform(reasons, one), " · ")


def open_once(openings: DataFrame, opened: DataFrame, key: str) -> DataFrame:
    """Openings of notifications that are not opened yet, each once."""
    return openings.dropDuplicates([key]).join(opened.select(key), key, "left_anti")


def filtered(rows: DataFrame, limit: int | None = None, newest: str | None = None, **equal) -> DataFrame:
    """Optional equality filters, newest first, and an optional limit. Negative limits are refused."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if newest:
        rows = rows.orderBy(F.desc(newest))
    if limit is not None:
        if limit < 0:
            raise ValueError("limit must not be negative")
        rows = rows.limit(limit)
    return rows
