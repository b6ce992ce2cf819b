"""Text queries: line rules, pages, blocks, HTML, chunks and highlights.

Names with ``_whole`` are older names of the same queries.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import lines as op
from tessel.operators.chunking import chunk_documents, spread
from tessel.operators.excerpts import excerpt_places, highlighted
from tessel.operators.html import html_blocks as blocks_of_html


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def line_filter(spark, d):
    """Lines with licence words or an e-mail sign go."""
    kept = op.drop_lines(F.col("text"), (r"(?i)licen[cs]e", r"copyright"), (), ("@",))
    return _docs(spark, d).select("doc_id", F.sha2(kept, 256).alias("h"), F.size(F.split(kept, "\n")).alias("lines"))


def blank_collapse(spark, d):
    t = op.collapse_blank_runs(F.regexp_replace("text", r"\. ", ".\n\n\n"))
    return _docs(spark, d).select("doc_id", F.sha2(t, 256).alias("h"))


def first_line_stamp(spark, d):
    stamped = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n48500.123456/2026-01\n"), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, d).select("doc_id", F.sha2(op.drop_first_stamp(stamped), 256).alias("h"))


def percent_removed(spark, d):
    kept = op.drop_lines(F.col("text"), (), (), ("e",))
    n, m = F.size(F.split("text", "\n")), F.size(F.filter(F.split(kept, "\n"), lambda x: x != ""))
    x = _docs(spark, d).select("doc_id", n.alias("n"), m.alias("m"))
    return x.select("doc_id", "n", "m", F.floor(100 * (F.col("n") - F.col("m")) / F.col("n")).alias("percent"))


def html_paragraphs(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", *(F.size(F.expr(f"regexp_extract_all(html, '<{tag}[ >]', 0)")).alias(f"n_{tag}") for tag in ("p", "a", "div")))


def html_blocks(spark, d):
    p = spread(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select("page_id", blocks_of_html("html").alias("b"))
    return p.select("page_id", F.posexplode("b").alias("pos", "block"))


def page_carry_forward(spark, d):
    """Every line with the last page marker above it."""
    t = F.split(F.concat(F.lit("<!-- page:1 -->\n"), F.regexp_replace("text", r"\n", "\n<!-- page:9 -->\n")), "\n")
    x = _docs(spark, d).select("doc_id", F.posexplode(t).alias("pos", "line")).withColumn("m", fn.page_marker(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("page", F.last("m", ignorenulls=True).over(w)).where("m IS NULL")
    return x.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


def block_split(spark, d):
    """Runs of lines between blank lines, with the number of lines of each."""
    t = F.split(F.regexp_replace("text", r"\.\n", ".\n\n"), "\n")
    x = _docs(spark, d).select("doc_id", F.posexplode(t).alias("pos", "line")).withColumn("blank", (F.trim("line") == "").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("run", F.sum("blank").over(w)).where("blank = 0")
    return x.groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("lines"), F.min("pos").alias("first"))


def heading_lines(spark, d):
    x = _docs(spark, d).select("doc_id", F.explode(F.split(F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))), "\n")).alias("line"))
    return x.where(fn.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def sentence_counts(spark, d):
    return _docs(spark, d).select("doc_id", F.size(fn.sentences(F.col("text"))).alias("n"))


def chunks(spark, d):
    return chunk_documents(_docs(spark, d), "doc_id", "text").select("chunk_id", "key", "chunk_index", "section", "page_start", "page_end", "token_count", "text")


def _excerpts(spark, d):
    """Benchmark passages, parts of them that begin and end within words, and their last words."""
    b = spark.read.parquet(f"{d}/benchmark.parquet").where("text <> ''")
    cuts = F.array(F.col("text"), F.expr("substring(text, 4, 40)"), F.substring_index("text", " ", -1), F.expr("substring(text, 3, 9)"))
    return b.select("item_id", F.posexplode(cuts).alias("i", "excerpt")).select((F.col("item_id") * 4 + F.col("i")).alias("item_id"), "excerpt")


def highlight_places(spark, d):
    return excerpt_places(_docs(spark, d).select("doc_id", "text"), _excerpts(spark, d)).select("doc_id", "item_id", "place")


def highlight_segments(spark, d):
    """Documents that hold benchmark passages or parts of them, with these marked."""
    docs = _docs(spark, d).select("doc_id", "text")
    return highlighted(docs, excerpt_places(docs, _excerpts(spark, d)))


_X = "SELECT doc_id, unnest(string_split({0}, chr(10))) AS line, generate_subscripts(string_split({0}, chr(10)), 1) AS pos FROM documents"
QUERIES = {f.__name__: f for f in (line_filter, blank_collapse, first_line_stamp, percent_removed, html_paragraphs, html_blocks, page_carry_forward, block_split, heading_lines, sentence_counts, chunks, highlight_places, highlight_segments)}
QUERIES |= {f"{f.__name__}_whole": f for f in (page_carry_forward, heading_lines)}
ORACLE = {
    "line_filter": """WITH x AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: NOT (regexp_matches(l, '(?i)licen[cs]e') OR contains(l, 'copyright') OR contains(l, '@'))) AS l FROM documents)
SELECT doc_id, sha256(array_to_string(l, chr(10))) AS h, CAST(greatest(len(l), 1) AS INTEGER) AS lines FROM x""",
    "blank_collapse": "SELECT doc_id, sha256(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)), chr(10) || chr(10) || '+', chr(10) || chr(10), 'g')) AS h FROM documents",
    "first_line_stamp": "SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN chr(10) || text ELSE text END) AS h FROM documents",
    "percent_removed": """WITH x AS (SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n, CAST(len(list_filter(string_split(text, chr(10)), lambda l: NOT contains(l, 'e') AND l <> '')) AS INTEGER) AS m FROM documents)
SELECT doc_id, n, m, CAST(floor(100 * (n - m) / n) AS BIGINT) AS percent FROM x""",
    "html_paragraphs": "SELECT page_id, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS INTEGER) AS n_{t}" for t in ("p", "a", "div")) + " FROM pages",
    "page_carry_forward": "WITH x AS (" + _X.format("text") + ") SELECT doc_id, CASE WHEN pos = 1 THEN 1 ELSE 9 END AS page, count(*) AS n FROM x GROUP BY 1, 2",
    "block_split": "WITH x AS (" + _X.format("replace(text, '.' || chr(10), '.' || chr(10) || chr(10))") + """), y AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM x)
SELECT doc_id, run, count(*) AS lines, CAST(min(pos) - 1 AS INTEGER) AS first FROM y WHERE trim(line) <> '' GROUP BY 1, 2""",
    "heading_lines": "WITH x AS (" + _X.format("upper(replace(text, 'ß', 'ss'))") + """) SELECT doc_id, count(*) AS n FROM x WHERE length(trim(line)) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(line), '\\S {2,}\\S')
  AND length(regexp_replace(trim(line), '[^\\p{L}]', '', 'g')) >= 3 AND length(regexp_replace(trim(line), '[^\\p{Lu}]', '', 'g')) >= 0.8 * length(regexp_replace(trim(line), '[^\\p{L}]', '', 'g')) GROUP BY 1""",
    "highlight_places": """WITH e AS (SELECT item_id * 4 + i AS item_id, CASE i WHEN 0 THEN text WHEN 1 THEN substr(text, 4, 40) WHEN 2 THEN regexp_extract(text, '[^ ]*$') ELSE substr(text, 3, 9) END AS excerpt FROM benchmark, range(4) t(i) WHERE text <> '')
SELECT doc_id, item_id, CAST(strpos(text, excerpt) - 1 AS INTEGER) AS place FROM documents, e WHERE excerpt <> '' AND contains(text, excerpt)""",
    "highlight_segments": """WITH RECURSIVE e AS (SELECT item_id * 4 + i AS item_id, CASE i WHEN 0 THEN text WHEN 1 THEN substr(text, 4, 40) WHEN 2 THEN regexp_extract(text, '[^ ]*$') ELSE substr(text, 3, 9) END AS excerpt FROM benchmark, range(4) t(i) WHERE text <> ''),
m AS (SELECT doc_id, item_id, strpos(text, excerpt) - 1 AS a, strpos(text, excerpt) - 1 + length(excerpt) AS b FROM documents, e WHERE excerpt <> '' AND contains(text, excerpt)),
r AS (SELECT doc_id, min(a) AS a, arg_min(b, (a, item_id)) AS b, 0 AS was FROM m GROUP BY 1 UNION ALL
  SELECT r.doc_id, min(m.a), arg_min(m.b, (m.a, m.item_id)), r.b FROM r JOIN m ON m.doc_id = r.doc_id AND m.a >= r.b GROUP BY r.doc_id, r.b),
s AS (SELECT doc_id, was AS a, a AS b, false AS highlighted FROM r UNION ALL SELECT doc_id, a, b, true FROM r UNION ALL SELECT r.doc_id, max(b), any_value(length(text)), false FROM r JOIN documents d ON d.doc_id = r.doc_id GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS pos, highlighted, substr(text, a + 1, b - a) AS text FROM s JOIN documents USING (doc_id) WHERE b > a""",
    "sentence_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[.;:!?]\\s+')) + 1 AS INTEGER) AS n FROM documents",
}
ORACLE["heading_lines_whole"] = ORACLE["heading_lines"]
ORACLE["page_carry_forward_whole"] = ORACLE["page_carry_forward"]
