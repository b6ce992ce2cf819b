"""Extraction routes composed of the line rules, the table of extracted texts, its cache, and what a scan of the corpus counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import half_even, solid_length, strip
from tessel.operators.lines import bind, collapse_blank_runs, drop_first_stamp, filter_lines

#: Fixed value: documents with fewer characters a page have no text layer.
LEAST_CHARACTERS = 20


def _filled(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""))


def pdf_text_route(pages: DataFrame, key: str = "sha256", page: str = "page", text: str = "text", least: int = LEAST_CHARACTERS, **rules) -> DataFrame:
    """One row for each document: status, pages_total, pages_kept, markdown, percent_removed and message.

    Every page loses a protocol number at its head and the boilerplate lines, pages are joined behind their markers, and of blank lines in
    a row one stays. A document whose pages have too few characters on average is pending, and has no Markdown."""
    clean = filter_lines(drop_first_stamp(F.col(text)), **rules)
    one = F.struct(F.col(page).alias("page"), clean.alias("text"))
    raw = F.size(F.split(text, "\n"))
    docs = pages.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("p"), F.count(F.lit(1)).alias("pages_total"), F.sum(solid_length(F.col(text))).alias("solid"), F.sum(raw).alias("raw"))
    marked = F.transform("p", lambda p: F.concat(F.lit("<!-- page:"), p["page"].cast("string"), F.lit(" -->\n"), F.when(p["text"] != "", F.concat(p["text"], F.lit("\n"))).otherwise("")))
    body = bind(collapse_blank_runs(F.array_join(marked, "\n")), lambda t: t)
    docs = docs.withColumn("has_text", F.col("solid") >= F.lit(least) * F.col("pages_total")).withColumn("body", F.when(F.col("has_text"), body))
    share = 100.0 * (1 - _filled(F.col("body")) / F.col("raw"))
    low = F.concat(F.lit("no text layer: "), F.format_string("%.1f", F.col("solid") / F.col("pages_total")), F.lit(" characters a page"))
    return docs.select(
        key,
        F.when(F.col("has_text"), "extracted").otherwise("pending").alias("status"),
        "pages_total",
        F.when(F.col("has_text"), F.col("pages_total")).alias("pages_kept"),
        F.concat(F.regexp_replace("body", r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"),
        F.when(F.col("has_text"), half_even(share, 1)).alias("percent_removed"),
        F.when(~F.col("has_text"), low).alias("message"),
    )


def store_markdown(stored: DataFrame, extracted: DataFrame, version: str) -> DataFrame:
    """Texts by content and extractor version; a pair that is there already keeps its text."""
    new = extracted.where(F.col("markdown").isNotNull()).select("sha256", F.lit(version).alias("extractor_version"), "markdown")
    return stored.unionByName(new.join(stored.select("sha256", "extractor_version"), ["sha256", "extractor_version"], "left_anti"))


def valid_cache(cache: DataFrame, stored: DataFrame) -> DataFrame:
    """Cache rows that may be used: extracted ones only while their Markdown is stored."""
    key = ["sha256", "extractor_version"]
    there = cache.join(stored.select(*key), key, "left_semi")
    return there.unionByName(cache.where(~F.col("has_markdown")).join(stored.select(*key), key, "left_anti"))


def in_scope(documents: DataFrame, **wanted: str | None) -> DataFrame:
    """Documents whose columns have the wanted values; None wants any."""
    for column, value in wanted.items():
        if value is not None:
            documents = documents.where(F.col(column) == value)
    return documents


def any_of(documents: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Documents with one of some values, whatever their case; no values let all pass."""
    return documents.where(F.lower(column).isin([v.lower() for v in values])) if values else documents


def scannable(documents: DataFrame) -> DataFrame:
    """PDF files that are kept and at hand."""
    return documents.where(~F.col("descartado") & F.col("sha256").isNotNull() & (F.col("formato") == "pdf"))


def scan_totals(pages: DataFrame, failed: DataFrame) -> DataFrame:
    """pages: sha256, degraded; failed: sha256. Documents, those with an error, those with a degraded page, pages, and degraded pages."""
    by_doc = pages.groupBy("sha256").agg(F.count(F.lit(1)).alias("pages"), F.count_if("degraded").alias("degraded"), F.lit(0).alias("error"))
    rows = by_doc.unionByName(failed.select("sha256", F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("degraded"), F.lit(1).alias("error")))
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("error"), F.lit(0)).alias("errors"), F.count_if(F.col("degraded") > 0).alias("with_degraded"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("degraded"), F.lit(0)).alias("degraded"))


def page_size(listing: Column) -> Column:
    """width and height in points from a page's line ``Page N size: W x H pts``; without one an error."""
    line = r"(?m)^\s*Page.*size:.*?([\d.]+)\s*x\s*([\d.]+)\s*pts"
    missing = F.raise_error(F.lit("no page size")).cast("double")
    part = lambda n: F.when(listing.rlike(line), F.regexp_extract(listing, line, n).cast("double")).otherwise(missing)
    return F.struct(part(1).alias("width_pt"), part(2).alias("height_pt"))


def paragraphs(text: Column) -> Column:
    """Number of paragraphs (between empty lines) that are not blank."""
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: strip(p) != ""))
