"""Catalogue queries. Stand-ins: customers are families, their orders versions, nations processes, part brands themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.operators import catalog as op


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("family"), F.col("o_orderkey").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("kind"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("family"), F.col("c_nationkey").alias("process"))


def face_version(spark, d):
    return op.face_version(_versions(spark, d)).select("family", "version", "day")


def family_summary(spark, d):
    return op.family_summary(_versions(spark, d))


def version_timeline(spark, d):
    return op.timeline(_versions(spark, d)).select("family", "version", "day", "pos")


def version_select(spark, d):
    v = _versions(spark, d)
    wanted = v.groupBy("family").agg(F.max("version").alias("top")).select("family", F.when(F.col("family") % 2 == 0, F.col("top")).otherwise(-1).alias("requested"))
    return op.select_version(v, wanted)


def process_summary(spark, d):
    faces = op.face_version(_versions(spark, d))
    out = op.process_summary(_families(spark, d), faces, F.col("kind"))
    return out.select("process", "latest", "latest_kind", "latest_version", "pieces", F.array_join("kinds", "|").alias("kinds"))


def process_pieces(spark, d):
    faces = op.face_version(_versions(spark, d)).join(_families(spark, d), "family")
    w = Window.partitionBy("process").orderBy("day", "version")
    return faces.select("process", "family", "version", "day", F.row_number().over(w).alias("pos"))


def process_order(spark, d):
    """Processes by latest movement and number, both descending."""
    p = op.process_summary(_families(spark, d), op.face_version(_versions(spark, d)), F.col("kind"))
    return op.numbered(p.select("process", "latest"), "latest", "process").select("process", "latest", "pos")


def latest_corpus(spark, d):
    o = _t(spark, d, "orders")
    return o.agg(F.coalesce(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")), F.lit("none")).alias("corpus_version"))


def first_resolved_corpus(spark, d):
    """Per customer: priority of the first hit (by order key) that the catalogue (orders with status F) resolves."""
    o = _t(spark, d, "orders")
    first = F.min_by(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(F.coalesce(first, F.lit("default")).alias("corpus_version"))


def themes(spark, d):
    return op.groups_with_members(_t(spark, d, "part"), "p_brand", "p_type").select("p_brand", F.array_join("members", "|").alias("types"), F.size("members").cast("long").alias("n"))


def theme_types(spark, d):
    p = _t(spark, d, "part")
    first = p.agg(F.min("p_brand").alias("b"))
    return p.join(F.broadcast(first), p["p_brand"] == first["b"]).select("p_type").distinct()


def theme_lookup_fallback(spark, d):
    p = _t(spark, d, "part")
    known = p.where("p_size <= 10").groupBy("p_type").agg(F.min("p_brand").alias("theme"))
    rows = p.select("p_partkey", "p_type")
    return op.lookup_or(rows, known, "p_type", "theme", "pendente-classificacao").select("p_partkey", "theme")


def _urgent(spark, d):
    """Urgent versions of the last sixty days, which not all families and processes have."""
    v = _versions(spark, d)
    last = v.agg(F.date_sub(F.to_date(F.max("day")), 60).cast("string").alias("since"))
    return v.where("kind = '1-URGENT'").join(F.broadcast(last), F.col("day") >= F.col("since")).drop("since")


def processes_without_pieces(spark, d):
    """Processes none of whose families has a version."""
    f, v = _families(spark, d), _urgent(spark, d)
    with_pieces = f.join(v.select("family").distinct(), "family", "left_semi").select("process").distinct()
    return f.select("process").distinct().join(with_pieces, "process", "left_anti")


def families_without_versions(spark, d):
    return _families(spark, d).join(_urgent(spark, d).select("family"), "family", "left_anti")


def opinion_sheet(spark, d):
    """Counts and faces of three fixed families in one row."""
    return op.opinion(_versions(spark, d), {"main": 1, "second": 2, "third": 4})


_V = "SELECT o_custkey AS family, o_orderkey AS version, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS kind FROM orders"
_FACE = f"SELECT * FROM ({_V}) QUALIFY row_number() OVER (PARTITION BY family ORDER BY day DESC, version) = 1"
_P = f"SELECT c_nationkey AS process, x.* FROM ({_FACE}) x JOIN customer ON c_custkey = family"

QUERIES = {f.__name__: f for f in (face_version, family_summary, version_timeline, version_select, process_summary, process_pieces, process_order, latest_corpus, first_resolved_corpus, themes, theme_types, theme_lookup_fallback, processes_without_pieces, families_without_versions, opinion_sheet)}
ORACLE = {
    "face_version": f"SELECT family, version, day FROM ({_FACE})",
    "family_summary": f"SELECT f.family, f.version AS face, n AS versions_count, f.day AS latest FROM ({_FACE}) f JOIN (SELECT o_custkey AS family, count(*) AS n FROM orders GROUP BY 1) c ON f.family = c.family",
    "version_timeline": f"SELECT family, version, day, CAST(row_number() OVER (PARTITION BY family ORDER BY day DESC, version) AS INTEGER) AS pos FROM ({_V})",
    "version_select": f"""SELECT f.family, CASE WHEN f.family % 2 = 0 THEN m.top ELSE f.version END AS version
FROM ({_FACE}) f JOIN (SELECT o_custkey AS family, max(o_orderkey) AS top FROM orders GROUP BY 1) m ON f.family = m.family""",
    "process_summary": f"""WITH p AS ({_P})
SELECT process, max(day) AS latest, arg_max(kind, (day, -version)) AS latest_kind, arg_max(version, (day, -version)) AS latest_version,
  count(*) AS pieces, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM p GROUP BY process""",
    "process_pieces": f"SELECT process, family, version, day, CAST(row_number() OVER (PARTITION BY process ORDER BY day, version) AS INTEGER) AS pos FROM ({_P})",
    "process_order": f"SELECT process, latest, CAST(row_number() OVER (ORDER BY latest DESC, process DESC) AS INTEGER) AS pos FROM (SELECT process, max(day) AS latest FROM ({_P}) GROUP BY 1)",
    "latest_corpus": "SELECT coalesce(arg_max(o_orderpriority, (o_orderdate, o_orderkey)), 'none') AS corpus_version FROM orders",
    "first_resolved_corpus": "SELECT o_custkey, coalesce(arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 'default') AS corpus_version FROM orders GROUP BY 1",
    "themes": "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS types, count(DISTINCT p_type) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1",
    "theme_types": "SELECT DISTINCT p_type FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)",
    "theme_lookup_fallback": "SELECT p_partkey, coalesce(theme, 'pendente-classificacao') AS theme FROM part p LEFT JOIN (SELECT p_type, min(p_brand) AS theme FROM part WHERE p_size <= 10 GROUP BY 1) k ON p.p_type = k.p_type",
    "processes_without_pieces": "SELECT DISTINCT c_nationkey AS process FROM customer WHERE c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 60 FROM orders)))",
    "families_without_versions": "SELECT c_custkey AS family, c_nationkey AS process FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 60 FROM orders))",
    "opinion_sheet": f"""SELECT max(version) FILTER (WHERE family = 1) AS main, max(version) FILTER (WHERE family = 2) AS second, max(version) FILTER (WHERE family = 4) AS third,
  (SELECT count(*) FROM orders WHERE o_custkey = 1) AS n_main, (SELECT count(*) FROM orders WHERE o_custkey = 2) AS n_second, (SELECT count(*) FROM orders WHERE o_custkey = 4) AS n_third FROM ({_FACE})""",
}
