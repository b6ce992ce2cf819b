"""Extraction by a document's own rules, which a model proposes: the rules around the ports for proposals and for page recognition.

A proposal is asked for once for each content, prompt version and model; what is valid is kept. An answer is JSON and checked before it is used: an object with
``notes`` that are not blank, whole numbers in ``drop_pages``, and texts in ``drop_line_literals``, ``drop_line_contains`` and ``strip_trailing_rubric_tokens`` (lists that are missing
are empty). A failed call and an answer that isn't like that give the empty spec with the reason, so the document gets the general rules alone, and are asked for again next time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import half_even, solid_length, strip
from tessel.operators.lines import bind, collapse_blank_runs, drop_first_stamp, filter_lines
from tessel.operators.routes import LEAST_CHARACTERS

#: A spec's lists and their types, and the marker before a page's raw text.
LISTS = {"drop_pages": "bigint", "drop_line_literals": "string", "drop_line_contains": "string", "strip_trailing_rubric_tokens": "string"}
MARKER = "<!-- pdftotext:page "
SPEC = "struct<" + ",".join(f"{n}:array<{t}>" for n, t in LISTS.items()) + ",notes:string>"

Ask = Callable[[DataFrame], DataFrame]


def spec_key(text: Column, prompt: str, model: str) -> Column:
    return F.sha2(F.concat(text, F.lit(f"|{prompt}|{model}")), 256)


def checked_spec(answer: Column) -> Column:
    """Struct of the spec, empty where the answer isn't valid, and the reason why it isn't (null if it is)."""
    v = F.try_parse_json(answer)
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("MISSING"))
    field = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    fits = lambda n, t: kind(field(n)).isin("MISSING", f"ARRAY<{t.upper()}>", "ARRAY<VOID>") & ~F.coalesce(F.to_json(field(n)).rlike(r"[\[,]null[\],]"), F.lit(False))
    wrong = F.when(v.isNull(), "no JSON").when(~kind(v).startswith("OBJECT"), "no object")
    for n, t in LISTS.items():
        wrong = wrong.when(~fits(n, t), F.concat(F.lit(f"{n} is no list of {'whole numbers' if t == 'bigint' else 'texts'}: "), F.coalesce(F.to_json(field(n)), F.lit(""))))
    notes = F.try_variant_get(v, "$.notes", "string")
    reason = wrong.when((kind(field("notes")) != "STRING") | (F.trim(F.coalesce(notes, F.lit(""))) == ""), "no notes").otherwise(None)
    empty = lambda t: F.array().cast(f"array<{t}>")
    own = F.struct(*[F.when(reason.isNull(), F.coalesce(F.try_variant_get(v, f"$.{n}", f"array<{t}>"), empty(t))).otherwise(empty(t)).alias(n) for n, t in LISTS.items()], F.when(reason.isNull(), notes).otherwise("").alias("notes"))
    return F.struct(own.cast(SPEC).alias("spec"), reason.alias("reason"))


def propose(documents: DataFrame, cache: DataFrame, ask: Ask, prompt: str, model: str) -> tuple[DataFrame, DataFrame]:
    """documents: key, text; cache: spec_key, spec. ``ask`` gets spec_key and text of each content that the cache doesn't have, once, and gives spec_key, answer and error.

    key, spec, state (cached, proposed or fallback) and reason of each document; and the rows that the cache gets. A content that ``ask`` gives nothing for
    has failed."""
    keyed = documents.select("key", "text", spec_key(F.col("text"), prompt, model).alias("spec_key"))
    known = cache.select("spec_key", "spec").dropDuplicates(["spec_key"])
    open_ = keyed.join(known.select("spec_key"), "spec_key", "left_anti").dropDuplicates(["spec_key"]).select("spec_key", "text")
    said = ask(open_).select("spec_key", "answer", "error").dropDuplicates(["spec_key"])
    judged = open_.select("spec_key").join(said, "spec_key", "left").withColumn("checked", checked_spec(F.when(F.col("error").isNull(), F.col("answer"))))
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("answer").isNull(), "no answer").otherwise(F.col("checked.reason"))
    fresh = judged.select("spec_key", F.col("checked.spec").alias("spec"), why.alias("reason")).withColumn("state", F.when(F.col("reason").isNull(), "proposed").otherwise("fallback"))
    every = known.select("spec_key", "spec", F.lit(None).cast("string").alias("reason"), F.lit("cached").alias("state")).unionByName(fresh)
    return keyed.select("key", "spec_key").join(every, "spec_key").select("key", "spec", "state", "reason"), fresh.where("state = 'proposed'").select("spec_key", "spec")


def raw_texts(pages: DataFrame) -> DataFrame:
    """pages: key, page, text. key and text: all pages behind their markers; what a proposal is asked about."""
    one = F.struct("page", F.concat(F.lit(MARKER), F.col("page").cast("string"), F.lit(" -->\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return pages.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["text"]), "\n").alias("text"))


def needs_recognition(pages: DataFrame, least: int = LEAST_CHARACTERS) -> DataFrame:
    """key, pages_total, pending: has a document too few characters a page for the text route?"""
    return pages.groupBy("key").agg(F.count(F.lit(1)).alias("pages_total"), (F.sum(solid_length(F.coalesce("text", F.lit("")))) < F.lit(least) * F.count(F.lit(1))).alias("pending"))


def spec_route(pages: DataFrame, specs: DataFrame) -> DataFrame:
    """pages: key, page, text; specs: of ``propose``. key, status, pages_total, pages_kept, markdown, percent_removed, state, reason.

    Pages that the spec drops go whole; of the others the protocol number at the head, the boilerplate lines, and the spec's own lines and rubrics. The share
    removed is of the raw lines, with those of dropped pages."""
    raw = F.size(F.split("text", "\n"))
    own = F.struct(F.col("spec.drop_line_literals").alias("literals"), F.col("spec.drop_line_contains").alias("contains"), F.col("spec.strip_trailing_rubric_tokens").alias("rubrics"))
    met = pages.select("key", "page", F.coalesce("text", F.lit("")).alias("text")).join(specs, "key")
    dropped = F.array_contains("spec.drop_pages", F.col("page").cast("long"))
    clean = met.select("key", "page", "state", "reason", raw.alias("raw"), dropped.alias("dropped"), F.when(~dropped, filter_lines(drop_first_stamp(F.col("text")), own=own)).alias("text"))
    marked = F.concat(F.lit("<!-- page:"), F.col("page").cast("string"), F.lit(" -->\n"), F.when(F.col("text") != "", F.concat("text", F.lit("\n"))).otherwise(""))
    one = F.when(~F.col("dropped"), F.struct("page", marked.alias("text")))
    docs = clean.groupBy("key").agg(F.array_sort(F.collect_list(one)).alias("p"), F.count(F.lit(1)).alias("pages_total"), F.count_if(~F.col("dropped")).alias("pages_kept"), F.sum("raw").alias("raw"), F.first("state").alias("state"), F.first("reason").alias("reason"))
    body = bind(collapse_blank_runs(F.array_join(F.transform("p", lambda p: p["text"]), "\n")), lambda t: t)
    docs = docs.withColumn("body", body)
    filled = F.size(F.filter(F.split("body", "\n"), lambda x: strip(x) != ""))
    share = F.when(F.col("raw") > 0, 100.0 * (1 - filled / F.col("raw"))).otherwise(0.0)
    return docs.select("key", F.lit("extracted").alias("status"), "pages_total", "pages_kept", F.concat(F.regexp_replace("body", r"(?U)\s+$", ""), F.lit("\n")).alias("markdown"), half_even(share, 1).alias("percent_removed"), "state", "reason")


def page_sizes(listing: DataFrame, key: str, text: str) -> DataFrame:
    """page, width_pt and height_pt from a listing with a line ``Page N size: W x H pts`` for each page; other lines are none."""
    pattern = r"^Page\s+(\d+)\s+size:\s+([0-9.]+) x ([0-9.]+)"
    lines = listing.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(pattern))
    part = lambda n: F.regexp_extract("line", pattern, n)
    return lines.select(key, part(1).cast("int").alias("page"), part(2).cast("double").alias("width_pt"), part(3).cast("double").alias("height_pt"))


def recognised(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """pages: key, page, text, degraded; answers: key, page, recognised, error. Degraded pages with the recognised text in their place; where the recognition failed or gave
    nothing they keep their own text, and ``note`` says why. Answers for other pages are ignored."""
    told = answers.select("key", "page", "recognised", "error").dropDuplicates(["key", "page"])
    met = pages.join(told, ["key", "page"], "left")
    good = F.col("degraded") & F.col("error").isNull() & F.col("recognised").isNotNull()
    note = F.when(F.col("degraded") & ~good, F.concat(F.lit("p."), F.col("page").cast("string"), F.lit(": "), F.coalesce("error", F.lit("no answer"))))
    return met.select("key", "page", F.when(good, F.col("recognised")).otherwise(F.col("text")).alias("text"), "degraded", note.alias("note"))


def recognition_notes(pages: DataFrame) -> DataFrame:
    """pages: of ``recognised``. key, degraded (numbers of such pages in order) and notes (in order of the pages) of each document."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & F.col("degraded"), F.struct("page", c)))), lambda x: x[c])
    return pages.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("degraded"), F.col("page")))).alias("degraded"), in_order("note").alias("notes"))
