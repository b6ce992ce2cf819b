"""Notification queries. Stand-ins: users of events are subscribers, event types documents, purchases earlier notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import notify as op


def _e(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def _wanted(spark, d):
    users = _e(spark, d).select("user_id").distinct()
    documents = _e(spark, d).select("event_type").distinct()
    return op.fan_out(users, documents)


def _parts(spark, d):
    return op.split_new(_wanted(spark, d), _e(spark, d).where("event_id % 2 = 0").select("user_id", "event_type").distinct(), ["user_id", "event_type"])


def notify_generated(spark, d):
    return _parts(spark, d)[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first"))


def notify_suppressed(spark, d):
    return _parts(spark, d)[1].groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("first"))


def notify_events(spark, d):
    return op.events_of(*_parts(spark, d), "user_id", "event_type").groupBy("event").agg(F.count(F.lit(1)).alias("n"))


def notify_opened(spark, d):
    """A user's clicks of a day open it, unless a purchase of that day has."""
    e = _e(spark, d).withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")))
    new, seen = e.where("event_type = 'click'").select("k"), e.where("event_type = 'purchase'").select("k").distinct()
    return op.open_once(new, seen, "k")


def event_filter(spark, d):
    e = op.filtered(_e(spark, d), limit=20, newest="event_id", event_type="click")
    return e.select("event_id", "user_id", "event_type")


def feedback_filter_limit(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return op.filtered(labels, limit=15, newest="doc_id", quality=1, toxic=0).select("doc_id", "quality", "toxic")


def digest_body(spark, d):
    e = _e(spark, d).where("event_id % 2 = 0").withColumn("job", F.date_format("ts", "yyyy-MM"))
    return op.digests(e, "user_id", "job", F.concat_ws(" ", F.lit("-"), "event_type", F.col("event_id").cast("string")), F.col("event_id"))


def unread_count(spark, d):
    return _e(spark, d).groupBy("user_id").agg(F.count_if(F.col("event_type") != "click").alias("unread"), F.count(F.lit(1)).alias("n"))


def scope_latest(spark, d):
    """The last preference of each user wins; the unset ones are null."""
    e = _e(spark, d)
    last = e.where("event_type = 'click'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("scope"))
    return e.select("user_id").distinct().join(last, "user_id", "left").select("user_id", F.when(F.col("scope") >= 50, "ampla").when(F.col("scope").isNotNull(), "estrita").alias("scope"))


def event_payload(spark, d):
    k = F.from_json("props", "k int")["k"]
    return _e(spark, d).groupBy(k.alias("k"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_W = "WITH w AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events)), x AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0)"
QUERIES = {f.__name__: f for f in (notify_generated, notify_suppressed, notify_events, notify_opened, event_filter, feedback_filter_limit, digest_body, unread_count, scope_latest, event_payload)}
ORACLE = {
    "notify_generated": _W + " SELECT event_type, count(*) AS n, min(user_id) AS first FROM (SELECT * FROM w EXCEPT SELECT * FROM x) GROUP BY 1",
    "notify_suppressed": _W + " SELECT event_type, count(*) AS n, min(user_id) AS first FROM (SELECT * FROM w INTERSECT SELECT * FROM x) GROUP BY 1",
    "notify_events": _W + """, g AS (SELECT count(*) AS n FROM (SELECT * FROM w EXCEPT SELECT * FROM x)), s AS (SELECT count(*) AS n FROM (SELECT * FROM w INTERSECT SELECT * FROM x))
SELECT * FROM (SELECT 'notification_generated' AS event, n FROM g UNION ALL SELECT 'notification_delivered', n FROM g UNION ALL SELECT 'notification_suppressed', n FROM s) WHERE n > 0""",
    "notify_opened": "WITH x AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS k, event_type FROM events) SELECT DISTINCT k FROM x WHERE event_type = 'click' AND k NOT IN (SELECT k FROM x WHERE event_type = 'purchase')",
    "event_filter": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 20",
    "feedback_filter_limit": "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1 AND toxic = 0 ORDER BY doc_id DESC LIMIT 15",
    "digest_body": "SELECT user_id, strftime(ts, '%Y-%m') AS job, user_id || ':' || strftime(ts, '%Y-%m') AS email_id, count(*) AS n, string_agg('- ' || event_type || ' ' || event_id, chr(10) ORDER BY event_id) AS body FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2",
    "unread_count": "SELECT user_id, count(*) FILTER (WHERE event_type <> 'click') AS unread, count(*) AS n FROM events GROUP BY 1",
    "scope_latest": """SELECT u.user_id, CASE WHEN scope >= 50 THEN 'ampla' WHEN scope IS NOT NULL THEN 'estrita' END AS scope FROM (SELECT DISTINCT user_id FROM events) u
LEFT JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS scope FROM events WHERE event_type = 'click' GROUP BY 1) s ON u.user_id = s.user_id""",
    "event_payload": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
