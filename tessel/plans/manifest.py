"""Manifest and string queries. Stand-ins: documents are files, part types document types, labels the extraction cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import manifest as op


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def manifest_hash(spark, d):
    return op.corpus_version(_t(spark, d, "documents").select(F.concat_ws("|", "doc_id", F.sha2("text", 256)).alias("key")))


def listed_digest(spark, d):
    """The digest of all keys, sorted and listed in one text."""
    keys = _t(spark, d, "documents").select(F.concat_ws("|", F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.sha2("text", 256)).alias("key"))
    return spark.createDataFrame([(op.listed_version(keys),)], "corpus_version string")


def content_hash(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))


def content_dups(spark, d):
    h = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return h.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_FORMATS, _TYPES = {"de": "format"}, {"src1": "type a", "src2": "type b"}


def triage(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.concat("source", F.lit(" "), F.col("doc_id") % 90 + 10).alias("kind"))
    return op.triage(rows, "kind", "lang", _FORMATS, _TYPES).select("doc_id", "descartado", "motivo_descarte")


def status_counts(spark, d):
    return triage(spark, d).groupBy(F.coalesce("motivo_descarte", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def extraction_status(spark, d):
    t = triage(spark, d)
    docs = _t(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), (F.col("n_chars") > 500).alias("has_file"))
    rows = docs.join(t, "doc_id").withColumnRenamed("lang", "formato")
    cache = _t(spark, d, "labels").join(docs, "doc_id").select("sha256", F.when(F.col("quality") == 1, "v1").otherwise("v0").alias("extractor_version"))
    return op.outcome(rows, cache, {"en": "text", "fr": "text", "de": "text"}, "v1").select("doc_id", "status", "route")


def status_totals(spark, d):
    s = extraction_status(spark, d)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def normalize_type(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("nº "), F.col("p_size"), F.lit("/2026"))).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string"))).alias("kind"))
    return p.select("p_partkey", fn.normalize_type(F.col("kind")).alias("kind"))


def br_date_iso(spark, d):
    o = _t(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", fn.iso_date(day).alias("day"))


def slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", fn.slug(F.concat(F.lit(" Ação: "), F.col("p_name"), F.lit(" / "), F.col("p_brand"))).alias("slug"))


def process_number(spark, d):
    o = _t(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat_ws("_", F.lit("48500"), "o_orderkey")).otherwise(F.concat(F.lit("48500_"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("_2026-01")))
    return o.select("o_orderkey", fn.process_number(name).alias("process"))


def chunk_ids(spark, d):
    x = _t(spark, d, "lineitem").select(fn.chunk_id(F.concat(F.lit("dv"), F.col("l_orderkey")), F.col("l_linenumber").cast("int")).alias("chunk")).distinct()
    return x.select("chunk", fn.chunk_index(F.col("chunk")).alias("number"))


def file_types(spark, d):
    return _t(spark, d, "pages").select("page_id", fn.extension(F.concat("url", F.lit(".HTML"))).alias("ext"), F.parse_url("url", F.lit("HOST")).alias("host"))


def type_titles(spark, d):
    return _t(spark, d, "orders").select(F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]+", "_")).alias("k")).distinct().select("k", fn.title_of(F.col("k")).alias("title"))


def free_text_filter(spark, d):
    """All of several words in the joined fields, whatever their case."""
    p = _t(spark, d, "part")
    where = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    for word in ("brand#1", "e"):
        p = p.where(where.contains(word))
    return p.select("p_partkey")


_TRIAGE = """SELECT doc_id, coalesce(CASE WHEN lang = 'de' THEN 'format' END, CASE source WHEN 'src1' THEN 'type a' WHEN 'src2' THEN 'type b' END) AS motivo_descarte FROM documents"""
_STATUS = f"""WITH t AS ({_TRIAGE}), c AS (SELECT DISTINCT sha256(text) AS h FROM labels JOIN documents USING (doc_id) WHERE quality = 1),
s AS (SELECT d.doc_id, CASE WHEN lang IN ('en', 'fr', 'de') THEN 'text' END AS route, CASE WHEN motivo_descarte IS NOT NULL THEN 'descartado' WHEN n_chars <= 500 THEN 'pending: no file' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'pending: no route'
  WHEN sha256(text) IN (SELECT h FROM c) THEN 'cached' ELSE 'extract' END AS status FROM documents d JOIN t ON d.doc_id = t.doc_id)"""
QUERIES = {f.__name__: f for f in (manifest_hash, listed_digest, content_hash, content_dups, triage, status_counts, extraction_status, status_totals, normalize_type, br_date_iso, slugs, process_number, chunk_ids, file_types, type_titles, free_text_filter)}
ORACLE = {
    "manifest_hash": """WITH k AS (SELECT sha256(doc_id || '|' || sha256(text)) AS h FROM documents), g AS (SELECT substr(h, 1, 3) AS g, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM k GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY g)) AS corpus_version, count(*) AS groups FROM g""",
    "listed_digest": "SELECT sha256(string_agg(k, chr(10) ORDER BY k)) AS corpus_version FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') || '|' || sha256(text) AS k FROM documents)",
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS bytes FROM documents",
    "content_dups": "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "triage": f"SELECT doc_id, motivo_descarte IS NOT NULL AS descartado, motivo_descarte FROM ({_TRIAGE})",
    "status_counts": f"SELECT coalesce(motivo_descarte, '') AS reason, count(*) AS n FROM ({_TRIAGE}) GROUP BY 1",
    "extraction_status": _STATUS + " SELECT doc_id, status, route FROM s",
    "status_totals": _STATUS + " SELECT status, count(*) AS n FROM s GROUP BY 1",
    "normalize_type": "SELECT p_partkey, p_type AS kind FROM part",
    "br_date_iso": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "slugs": "SELECT p_partkey, trim(regexp_replace(lower('acao: ' || p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part",
    "process_number": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '48500_' || o_orderkey ELSE '48500.' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/2026-01' END AS process FROM orders",
    "chunk_ids": "SELECT DISTINCT 'dv' || l_orderkey || '#chunk-' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS chunk, CAST(l_linenumber AS INTEGER) AS number FROM lineitem",
    "file_types": "SELECT page_id, 'html' AS ext, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages",
    "type_titles": "SELECT DISTINCT lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')) AS k, array_to_string(list_transform(string_split(lower(regexp_replace(o_orderpriority, '[^A-Za-z]+', '_', 'g')), '_'), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title FROM orders",
    "free_text_filter": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'e')",
}
