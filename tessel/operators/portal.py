"""Saved pages of a document portal: their header, protocol rows and process numbers, as source documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import iso_date, slug, strip

#: The patterns of a row of text, of a process number, and of the header's lines.
ROW = r"([0-9]{5,})\s+(.+?)\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+([A-Z0-9_-]+)"
PROCESS = r"[0-9]{5}\.[0-9]{6}/[0-9]{4}-[0-9]{2}"
HEADER = {"process_number": ("processo", rf"(?i)Processo:\s*({PROCESS})"), "process_type": ("tipo", r"(?i)Tipo:\s*(.+)"), "generated_at": ("datadegeracao", r"(?i)Data de Gera[cç][aã]o:\s*([0-9]{2}/[0-9]{2}/[0-9]{4})")}


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|"), strip)


def page_header(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, process_number, process_type and generated_at: the first table row with that label, else the first such line of the text; the type is
    empty if there is none."""
    lines = pages.select(page, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.col("line").contains("|")).withColumn("c", _cells(F.col("line"))).where(F.size("c") >= 2)
    label = F.replace(slug(F.get("c", F.lit(0)), "_"), F.lit("_"), F.lit(""))
    value = F.when(F.get("c", F.lit(1)) != "", F.get("c", F.lit(1)))
    first = [F.min_by(value, F.when(F.col("label") == name, F.col("pos"))).alias(f"t_{c}") for c, (name, _) in HEADER.items()]
    tables = lines.withColumn("label", label).groupBy(page).agg(*first)
    out = pages.select(page, text).join(tables, page, "left")
    for c, (_, pattern) in HEADER.items():
        found = strip(F.regexp_extract(text, pattern, 1))
        out = out.withColumn(c, F.coalesce(f"t_{c}", F.when(found != "", found)))
    return out.select(page, "process_number", F.coalesce("process_type", F.lit("")).alias("process_type"), "generated_at")


def protocol_rows(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """page, pos, protocol, document_type, document_date, inclusion_date and unit: rows of a page's table, else what its text has of that form."""
    names = ["protocol", "document_type", "document_date", "inclusion_date", "unit"]
    cells = pages.select(page, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line")).where(F.col("line").contains("|")).withColumn("c", _cells(F.col("line")))
    table = cells.where((F.size("c") >= 5) & F.get("c", F.lit(0)).rlike(r"^[0-9]{5,}$")).select(page, "pos", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))
    rest = pages.join(table.select(page).distinct(), page, "left_anti")
    found = rest.select(page, F.posexplode(F.regexp_extract_all(text, F.lit(ROW), F.lit(0))).alias("pos", "m"))
    return table.unionByName(found.select(page, "pos", *(strip(F.regexp_extract("m", ROW, i + 1)).alias(n) for i, n in enumerate(names))))


def source_documents(rows: DataFrame, source_system: str, by_process: bool = True) -> DataFrame:
    """rows: process_number, protocol, document_type, document_date, inclusion_date, unit, href and (if there are such) related.

    The documents of a process are versions of one family, or each protocol is a family. A row without link is missing; one of a related
    process is known by its metadata only."""
    process = F.coalesce("process_number", F.lit("processo-desconhecido"))
    system = F.lit(source_system)
    family = F.concat(system, F.lit("-process-"), slug(process, "-")) if by_process else F.concat(system, F.lit("-"), F.col("protocol"))
    named = F.concat(F.lit("Processo "), process) if by_process else F.concat_ws(" ", "document_type", "protocol")
    related = F.col("related") if "related" in rows.columns else F.lit(False)
    locator = F.when(related, F.concat(F.lit("metadata://"), system, F.lit("/related-process/"), F.col("protocol"))).otherwise(F.coalesce(F.when(F.col("href") != "", F.col("href")), F.concat(F.lit("missing://"), system, F.lit("/"), F.col("protocol"))))
    return rows.select(
        family.alias("family_id"),
        named.alias("family_label"),
        F.lit("official_process_number" if by_process else "official_protocol_number").alias("family_basis"),
        slug(F.col("document_type"), "_", "documento").alias("document_type"),
        F.col("protocol").alias("official_identifier"),
        process.alias("process_number"),
        system.alias("source_system"),
        F.concat(family, F.lit("-"), F.col("protocol")).alias("version_id"),
        iso_date(F.col("document_date")).alias("version_date"),
        F.lit("official_protocol_date").alias("version_date_source"),
        iso_date(F.col("inclusion_date")).alias("inclusion_date"),
        "unit",
        locator.alias("locator"),
    )


def combined(manifests: list[DataFrame]) -> DataFrame:
    """All documents of several manifests."""
    return reduce(lambda a, b: a.unionByName(b), manifests)


def resolved(base: Column, href: Column) -> Column:
    """A link of a page at ``base``: absolute as it is, from the root, or beside the page."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    beside = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    return F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).otherwise(F.concat(beside, href))


def process_hits(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages: page, url, text; links: page, pos, label, href. Each process number of a page once: numbers of the text in order, then those of link
    labels; href: of the link with the number as label (for a number of a label, of that link), resolved."""
    named = links.groupBy("page", "label").agg(F.max_by("href", "pos").alias("href"))
    of_text = pages.select("page", "url", F.posexplode(F.regexp_extract_all("text", F.lit(PROCESS), F.lit(0))).alias("pos", "process"))
    of_text = of_text.join(named.withColumnRenamed("label", "process"), ["page", "process"], "left").select("page", "url", "process", "href", F.lit(0).alias("kind"), "pos")
    of_label = links.join(pages.select("page", "url"), "page").select("page", "url", "href", "pos", F.explode(F.regexp_extract_all("label", F.lit(PROCESS), F.lit(0))).alias("process")).select("page", "url", "process", "href", F.lit(1).alias("kind"), "pos")
    first = of_text.unionByName(of_label).groupBy("page", "process").agg(F.min(F.struct("kind", "pos", F.struct("url", "href").alias("l"))).alias("m"))
    return first.select("page", "process", resolved(F.col("m.l.url"), F.col("m.l.href")).alias("href"), F.struct("m.kind", "m.pos").alias("at"))


def first_hits(hits: DataFrame, n: int) -> DataFrame:
    """The first n hits in order of the result pages."""
    return hits.orderBy("page", "at").limit(n)


def status_counts(results: DataFrame) -> DataFrame:
    """results: status. Downloaded, known by metadata only, and failed (all others)."""
    return results.agg(F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.count_if(F.col("status") == "metadata_only").alias("metadata_only"), F.count_if(~F.coalesce(F.col("status").isin("downloaded", "metadata_only"), F.lit(False))).alias("failed"))
