"""Portal pages, extraction routes and corpus scans. Stand-ins: orders become rows of saved portal pages, documents pages of PDF files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import links, portal, routes, specs
from tessel.sources import files
from tessel.sources.shared import written


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pages(spark, d):
    """A page for each customer with orders: a header as table or as text, its orders as table rows or as lines."""
    row = F.concat_ws(" ", F.lpad(F.col("o_orderkey").cast("string"), 7, "0"), F.initcap(F.replace(F.substring("o_orderpriority", 3, 20), F.lit(" "), F.lit("_"))), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("05/06/2001"), F.concat(F.lit("S"), F.col("o_orderstatus")))
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("r"))
    process = F.concat(F.lit("48500."), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("/2024-11"))
    lines = F.transform("r", lambda x: x["row"])
    table = F.concat(F.lit("| Processo: | "), process, F.lit(" |\n| Data de Geração | 01/02/2003 |\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("| "), F.replace(x, F.lit(" "), F.lit(" | ")), F.lit(" |"))), "\n"))
    text = F.concat(F.lit("Processo: "), process, F.lit("\nTipo: Recurso de \n"), F.array_join(lines, "\n"))
    return o.select(F.col("o_custkey").alias("page"), F.when(F.col("o_custkey") % 2 == 0, table).otherwise(text).alias("text"))


def page_headers(spark, d):
    return portal.page_header(_pages(spark, d))


def protocol_rows(spark, d):
    return portal.protocol_rows(_pages(spark, d)).drop("pos")


def _source(spark, d, by_process):
    pages = written(_pages(spark, d), "pages")[0]  # the header and both kinds of rows read them
    rows = portal.protocol_rows(pages).join(portal.page_header(pages).select("page", "process_number"), "page")
    n = F.col("protocol").cast("int")
    rows = rows.withColumn("href", F.when(n % 3 == 0, F.concat(F.lit("https://portal/"), "protocol"))).withColumn("related", n % 5 == 0)
    return portal.source_documents(rows, "sei", by_process)


def protocol_documents(spark, d):
    return _source(spark, d, False)


def process_documents(spark, d):
    return _source(spark, d, True)


def manifests_combined(spark, d):
    docs = written(_source(spark, d, True).select("family_id", "version_date"), "manifest")[0]  # each part reads it
    parts = [docs.where(F.pmod(F.crc32("family_id"), F.lit(3)) == i) for i in range(3)]
    return portal.combined(parts).groupBy("family_id").agg(F.count(F.lit(1)).alias("documents"), F.max("version_date").alias("latest"))


def portal_process_hits(spark, d):
    """Result pages by nation: customers' numbers in the text, some twice, and links with numbers as labels, relative to the page."""
    number = F.concat(F.lit("48500."), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("/2024-11"))
    c = _t(spark, d, "customer").withColumn("number", number)
    text = c.where("c_custkey % 4 <> 0").groupBy("c_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "number"))), lambda x: F.concat(x["number"], F.lit(" e "), x["number"])), "; ").alias("text"))
    pages = text.select(F.col("c_nationkey").alias("page"), F.concat(F.lit("https://host/a/b"), F.col("c_nationkey").cast("string"), F.lit("?q=1")).alias("url"), "text")
    label = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ver "), "number")).otherwise(F.col("number"))
    links = c.where("c_custkey % 3 <> 0").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("pos"), label.alias("label"), F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("/x/"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("p"), F.col("c_custkey").cast("string"))).alias("href"))
    return portal.process_hits(pages, links).select("page", "process", "href")


def first_process_hits(spark, d):
    hits = _pages(spark, d).select("page", F.posexplode(F.regexp_extract_all("text", F.lit(portal.PROCESS), F.lit(0))).alias("pos", "process")).select("page", "process", F.struct(F.lit(0).alias("kind"), "pos").alias("at"))
    return portal.first_hits(hits, 25).select("page", "process")


def download_counts(spark, d):
    status = F.when(F.col("event_type") == "click", "downloaded").when(F.col("event_type") == "purchase", "metadata_only").otherwise(F.col("event_type"))
    return portal.status_counts(_t(spark, d, "events").select(status.alias("status")))


def any_of_filter(spark, d):
    return routes.any_of(_t(spark, d, "orders"), "o_orderpriority", ["1-urgent", "5-Low"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def scope_filter(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("corpus_id"), F.col("o_orderpriority").alias("categoria"))
    one = routes.in_scope(o, corpus_id="F", categoria=None).agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("corpus"))
    return one.unionByName(routes.in_scope(o, corpus_id="O", categoria="2-HIGH").agg(F.count(F.lit(1)).alias("n")).withColumn("scope", F.lit("both")))


#: Lines that the route takes away, and the blocks around each text.
_STAMP = "48500.123456/2026-01\n"
_NOISE = "\nDocumento assinado digitalmente\n(Assinado digitalmente)\nNOME DE ALGUEM\nCARGO\n\n\n\nDocumento assinado eletronicamente por X\nY\n\nA autenticidade deste documento pode ser conferida\nem Z\n\nReferência: Processo nº 1\n"


def _pdf(spark, d):
    """Two pages for each document: a stamp, its text and boilerplate; a word."""
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    pages = F.array(F.struct(F.lit(1).alias("page"), F.concat(F.lit(_STAMP), "text", F.lit(_NOISE)).alias("text")), F.struct(F.lit(2).alias("page"), F.lit("fim").alias("text")))
    return docs.select(F.col("doc_id").alias("sha256"), F.explode(pages).alias("p")).select("sha256", "p.page", "p.text")


def pdf_route(spark, d):
    """What is left of stamped and signed texts."""
    r = routes.pdf_text_route(_pdf(spark, d))
    return r.select(F.col("sha256").alias("doc_id"), "status", "pages_total", F.sha2("markdown", 256).alias("h"))


def filter_lines_real(spark, d):
    from tessel.operators.lines import filter_lines

    dirty = F.concat(F.lit("(Assinado digitalmente)\nA\nB\n\n"), "text", F.lit(_NOISE), F.lit("Documento\nDocumentoassinado\nlixo\nConsulte a autenticidade disto\nfim"))
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(filter_lines(dirty), 256).alias("h"))


def markdown_store(spark, d):
    """Texts of version 2 beside those of version 1, which stay."""
    docs = _t(spark, d, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("text").alias("markdown"), "doc_id").where("sha256 IS NOT NULL").dropDuplicates(["sha256"])
    stored = docs.where("length(markdown) % 2 = 0").select("sha256", F.when(F.length("markdown") % 4 == 0, "v1").otherwise("v2").alias("extractor_version"), F.lit("old").alias("markdown"))
    return routes.store_markdown(stored, docs, "v2").select("sha256", "extractor_version", (F.col("markdown") == "old").alias("kept"))


def cache_valid(spark, d):
    """Cached results of which some have lost their Markdown."""
    e = _t(spark, d, "labels").select(F.col("doc_id").alias("sha256"), F.lit("v1").alias("extractor_version"), (F.col("quality") == 1).alias("has_markdown"))
    return routes.valid_cache(e, e.where("has_markdown AND sha256 % 3 <> 0")).select("sha256", "has_markdown")


def scan_report(spark, d):
    docs = _t(spark, d, "orders").select(F.col("o_orderkey"), (F.col("o_orderstatus") == "P").alias("descartado"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("sha256"), F.when(F.col("o_custkey") % 2 == 0, "pdf").otherwise("html").alias("formato"))
    pdf = routes.scannable(docs)
    pages = _t(spark, d, "lineitem").join(pdf, F.col("l_orderkey") == F.col("sha256")).select("sha256", (F.col("l_linenumber") % 4 == 0).alias("degraded"))
    return routes.scan_totals(pages, pdf.join(pages, "sha256", "left_anti"))


def page_sizes(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.format_string("Title: x\nPage %4d size: %d.5 x %d pts (A4)\nEnd", (F.col("o_orderkey") % 9).cast("int"), F.col("o_custkey").cast("int"), (F.col("o_orderkey") % 900).cast("int")).alias("listing"))
    return o.select("o_orderkey", routes.page_size(F.col("listing")).alias("s")).select("o_orderkey", "s.width_pt", "s.height_pt")


def paragraph_counts(spark, d):
    t = F.concat("text", F.lit("\n\n \n\nfim"))
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", routes.paragraphs(F.regexp_replace(t, r"\.\n", ".\n\n")).alias("n"))


def removed_percent(spark, d):
    n, m = F.size(F.split("text", "\n")), F.size(F.filter(F.split("text", "\n"), lambda x: ~x.contains("e") & (x != "")))
    return _t(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fn.percent_removed(n, m).alias("percent"))


def slug_variants(spark, d):
    s = F.concat(F.lit(" Ação Única nº "), F.col("p_name"), F.lit(" / ÑÜé. "))
    model = F.concat(F.lit("Titan:"), "p_brand", F.lit("_V2.0"))
    p = _t(spark, d, "part").select("p_partkey", fn.slug(s, "_", "documento").alias("portal"), fn.slug(s).alias("theme"), fn.index_name(model, "chunks-").alias("index_name"), fn.word_slug(s).alias("words"), fn.file_name(s).alias("file"), fn.slug(F.lit("–"), "_", "documento").alias("empty"))
    return p


def rounding(spark, d):
    """Ties to the even neighbour, and upward."""
    x = (F.col("l_orderkey") % 40) / 4
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.half_even(x).alias("even"), fn.half_up(x).alias("up"))


_ROWS = """o AS (SELECT o_custkey AS page, '48500.' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '/2024-11' AS process, o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS protocol,
 CASE substr(o_orderpriority, 3) WHEN 'URGENT' THEN 'Urgent' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' WHEN 'NOT SPECIFIED' THEN 'Not_specified' ELSE upper(substr(o_orderpriority, 3, 1)) || lower(replace(substr(o_orderpriority, 4), ' ', '_')) END AS document_type,
 strftime(o_orderdate, '%d/%m/%Y') AS document_date, strftime(o_orderdate, '%Y-%m-%d') AS iso, 'S' || o_orderstatus AS unit FROM orders)"""
_SOURCE = f"""WITH {_ROWS}, s AS (SELECT *, '48500-' || lpad(CAST(page AS VARCHAR), 6, '0') || '-2024-11' AS slug,
 CASE WHEN o_orderkey % 5 = 0 THEN 'metadata://sei/related-process/' || protocol WHEN o_orderkey % 3 = 0 THEN 'https://portal/' || protocol ELSE 'missing://sei/' || protocol END AS locator FROM o)
SELECT {{0}} AS family_id, {{1}} AS family_label, '{{2}}' AS family_basis, lower(document_type) AS document_type, protocol AS official_identifier, process AS process_number, 'sei' AS source_system, {{0}} || '-' || protocol AS version_id,
 iso AS version_date, 'official_protocol_date' AS version_date_source, '2001-06-05' AS inclusion_date, unit, locator FROM s"""
_BY_PROCESS = _SOURCE.format("'sei-process-' || slug", "'Processo ' || process", "official_process_number")
_CLEAN = "WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?i)^\\s*Documento\\s+assinado')) AS k FROM documents WHERE text IS NOT NULL)"
QUERIES = {
    f.__name__: f
    for f in (page_headers, protocol_rows, protocol_documents, process_documents, manifests_combined, portal_process_hits, first_process_hits, download_counts, any_of_filter, scope_filter, pdf_route, filter_lines_real)
    + (markdown_store, cache_valid, scan_report, page_sizes, paragraph_counts, removed_percent, slug_variants, rounding)
}
ORACLE = {
    "page_headers": f"WITH {_ROWS} SELECT DISTINCT page, process AS process_number, CASE WHEN page % 2 = 0 THEN '' ELSE 'Recurso de' END AS process_type, CASE WHEN page % 2 = 0 THEN '01/02/2003' END AS generated_at FROM o",
    "protocol_rows": f"WITH {_ROWS} SELECT page, protocol, document_type, document_date, '05/06/2001' AS inclusion_date, unit FROM o",
    "protocol_documents": _SOURCE.format("'sei-' || protocol", "document_type || ' ' || protocol", "official_protocol_number"),
    "process_documents": _BY_PROCESS,
    "manifests_combined": f"SELECT family_id, count(*) AS documents, max(version_date) AS latest FROM ({_BY_PROCESS}) GROUP BY 1",
    "portal_process_hits": """WITH c AS (SELECT c_nationkey AS page, c_custkey AS k, '48500.' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || '/2024-11' AS process FROM customer), t AS (SELECT DISTINCT page FROM c WHERE k % 4 <> 0)
SELECT c.page, process, CASE WHEN k % 3 = 0 OR (k % 4 <> 0 AND k % 2 = 0) THEN NULL WHEN k % 5 = 0 THEN 'https://host/x/' || k ELSE 'https://host/a/p' || k END AS href FROM c JOIN t USING (page) WHERE k % 4 <> 0 OR k % 3 <> 0""",
    "first_process_hits": f"WITH {_ROWS} SELECT page, process FROM (SELECT DISTINCT page, process FROM o) ORDER BY page LIMIT 25",
    "download_counts": "SELECT count(*) FILTER (WHERE event_type = 'click') AS downloaded, count(*) FILTER (WHERE event_type = 'purchase') AS metadata_only, count(*) FILTER (WHERE event_type NOT IN ('click', 'purchase')) AS failed FROM events",
    "any_of_filter": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '5-low') GROUP BY 1",
    "scope_filter": "SELECT count(*) AS n, 'corpus' AS scope FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT count(*), 'both' FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'",
    "filter_lines_real": _CLEAN + " SELECT doc_id, sha256(chr(10) || text || chr(10) || repeat(chr(10), 3) || 'fim') AS h FROM l",
    "pdf_route": """SELECT doc_id, 'extracted' AS status, CAST(2 AS BIGINT) AS pages_total,
 sha256(regexp_replace('<!-- page:1 -->' || chr(10) || text || repeat(chr(10), 2) || '<!-- page:2 -->' || chr(10) || 'fim' || chr(10), chr(10) || chr(10) || '+', chr(10) || chr(10), 'g')) AS h FROM documents WHERE text IS NOT NULL""",
    "markdown_store": """WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), s AS (SELECT sha256(text) AS sha256, length(text) AS n FROM t)
SELECT sha256, CASE WHEN n % 4 = 0 THEN 'v1' ELSE 'v2' END AS extractor_version, true AS kept FROM s WHERE n % 2 = 0 UNION ALL SELECT sha256, 'v2', false FROM s WHERE n % 4 <> 2""",
    "cache_valid": "SELECT doc_id AS sha256, quality = 1 AS has_markdown FROM labels WHERE quality <> 1 OR doc_id % 3 <> 0",
    "scan_report": """WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0 AND o_custkey % 2 = 0), l AS (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS g FROM p LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (WHERE n = 0) AS errors, count(*) FILTER (WHERE g > 0) AS with_degraded, CAST(sum(n) AS BIGINT) AS pages, CAST(sum(g) AS BIGINT) AS degraded FROM l""",
    "page_sizes": "SELECT o_orderkey, o_custkey + 0.5 AS width_pt, CAST(o_orderkey % 900 AS DOUBLE) AS height_pt FROM orders",
    "paragraph_counts": "SELECT doc_id, CAST(len(list_filter(string_split(replace(text || chr(10) || chr(10) || ' ' || chr(10) || chr(10) || 'fim', '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) AS INTEGER) AS n FROM documents WHERE text IS NOT NULL",
    "removed_percent": "WITH x AS (SELECT doc_id, len(string_split(text, chr(10))) AS n, len(list_filter(string_split(text, chr(10)), lambda l: NOT contains(l, 'e') AND l <> '')) AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(100.0 * (n - m) / n, 1) AS percent FROM x",
    "slug_variants": """SELECT p_partkey, 'acao_unica_no_' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') || '_nue' AS portal, 'acao-unica-no-' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-nue' AS theme,
 'chunks-titan-' || regexp_replace(lower(p_brand), '[^a-z0-9._-]', '-', 'g') || '_v2.0' AS index_name, 'ação-única-nº-' || regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g') || '---ñüé' AS words,
 'Ação-Única-nº-' || regexp_replace(p_name, '[^A-Za-z0-9._-]', '-', 'g') || '---ÑÜé' AS file, 'documento' AS empty FROM part""",
    "rounding": "SELECT l_orderkey, l_linenumber, round_even((l_orderkey % 40) / 4, 0) AS even, CAST(floor((l_orderkey % 40) / 4 + 0.5) AS BIGINT) AS up FROM lineitem",
}


def page_links(spark, d):
    """Every link of every page, in order."""
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("page"), "url", "html")
    return links.links_of(links.read_pages(pages)).select("page", "pos", "label", "href")


def saved_process_hits(spark, d):
    """Process hits of the pages themselves: two numbers are put into each page, one of them with a link of its own, and one into a link's label."""
    n = lambda k: F.format_string("48500.%06d/2024-%02d", (F.col("page_id") * 7 + k) % 1000, F.col("page_id") % 90 + 10)
    extra = F.concat(F.lit("<article><p>Processos "), n(0), F.lit(" e&nbsp;"), n(1), F.lit('</p><a href="a?n=0"><b>'), n(0), F.lit('</b></a><a href="/root">'), n(2), F.lit(" (novo)</a>"))
    pages = spark.read.parquet(f"{d}/pages.parquet").where("html IS NOT NULL").select(F.col("page_id").alias("page"), F.format_string("https://host/dir/p%d.html?x=/1", "page_id").alias("url"), F.replace("html", F.lit("<article>"), extra).alias("html"))
    read = links.read_pages(pages)
    return portal.process_hits(read, links.links_of(read)).select("page", "process", F.coalesce("href", F.lit("-")).alias("href"))


QUERIES |= {f.__name__: f for f in (page_links, saved_process_hits)}
ORACLE |= {
    "page_links": """WITH x AS (SELECT page_id AS page, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) - 1 AS pos FROM pages)
SELECT page, CAST(pos AS INTEGER) AS pos, replace(trim(regexp_extract(a, '>([^<]*)<', 1)), '&amp;', '&') AS label, replace(regexp_extract(a, '"([^"]*)"', 1), '&amp;', '&') AS href FROM x""",
    "saved_process_hits": """WITH p AS (SELECT page_id AS page, k, '48500.' || lpad(CAST((page_id * 7 + k) % 1000 AS VARCHAR), 6, '0') || '/2024-' || lpad(CAST(page_id % 90 + 10 AS VARCHAR), 2, '0') AS process FROM pages, range(3) t(k) WHERE contains(html, '<article>'))
SELECT page, process, CASE WHEN k = 0 THEN 'https://host/dir/a?n=0' ELSE '-' END AS href FROM p""",
}


def _three_pages(spark, d):
    """Each document as three pages, a third of them without their second page's text."""
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    second = F.when(F.col("key") % 3 == 0, " 12 ").otherwise(F.substring("text", 201, 200))
    return t.select("key", F.concat(F.substring("text", 1, 200), F.lit("\f"), second, F.lit("\f"), F.substring("text", 401, 200), F.lit("\f")).alias("text"))


def page_classes(spark, d):
    """Pages that need recognition, from raw listings alone: texts with form feeds, images (half of them masks) and page sizes."""
    whole = _three_pages(spark, d)
    kind, width = F.when(F.col("key") % 2 == 0, "image").otherwise("smask"), 100 * (F.col("key") % 30)
    images = whole.select("key", F.format_string("page num type width\n----\n 1 0 %s %d 3300 rgb 3 8 jpx no 12 0 300 300 1M 1%%\n 3 1 image 560 480 rgb 3 8 jpx no 12 0 335 335 1M 1%%", kind, width).alias("text"))
    sizes = whole.select("key", F.lit("Pages: 3\nPage    1 size: 612 x 792 pts\nPage    2 size: 595.5 x 842 pts (A4)\nPage    3 size: 612 x 792 pts").alias("text"))
    pages = files.form_feed_pages(whole, "key", "text", F.lit(3))
    scans = files.scanned_pages(files.page_images(images, "key", "text"), specs.page_sizes(sizes, "key", "text"), "key")
    return files.degraded_pages(pages, scans, "key").select(F.col("key").alias("doc_id"), F.col("page").cast("int").alias("page"), "degraded")


def spec_states(spark, d):
    """What becomes of proposals for all documents: a quarter of the contents has one in the cache; the others get a good answer, a bad one or a failure."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    kind = F.length("text") % 4

    def ask(rows):
        good = F.to_json(F.struct(F.array(F.length("text")).alias("drop_pages"), F.lit("why").alias("notes")))
        return rows.select("spec_key", F.when(kind == 1, good).when(kind == 2, F.lit('{"drop_pages": ["1"], "notes": "n"}')).alias("answer"), F.when(kind == 3, "no credit").alias("error"))

    cache = docs.where(kind == 0).select(specs.spec_key(F.col("text"), "v1", "model").alias("spec_key"), specs.checked_spec(F.lit('{"notes": "old"}')).getField("spec").alias("spec"))
    found, _ = specs.propose(docs, cache, ask, "v1", "model")
    return found.select(F.col("key").alias("doc_id"), "state", F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce(F.get("spec.drop_pages", F.lit(0)), F.lit(-1).cast("long")).alias("page"))


QUERIES |= {f.__name__: f for f in (page_classes, spec_states)}
ORACLE |= {
    "page_classes": """WITH p AS (SELECT doc_id, p.page, CASE p.page WHEN 1 THEN substr(coalesce(text, ''), 1, 200) WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN ' 12 ' ELSE substr(coalesce(text, ''), 201, 200) END ELSE substr(coalesce(text, ''), 401, 200) END AS t FROM documents, (VALUES (1), (2), (3)) p(page))
SELECT doc_id, page, length(regexp_replace(t, '\\s', '', 'g')) < 20 OR (page = 1 AND doc_id % 2 = 0 AND 24 * (doc_id % 30) >= 0.6 * 612) AS degraded FROM p""",
    "spec_states": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents) SELECT doc_id, CASE n % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'proposed' ELSE 'fallback' END AS state,
  CASE n % 4 WHEN 2 THEN 'drop_pages is no list of whole numbers: ["1"]' WHEN 3 THEN 'no credit' ELSE '-' END AS reason, CASE WHEN n % 4 = 1 THEN n ELSE -1 END AS page FROM d""",
}
