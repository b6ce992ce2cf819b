"""Boilerplate lines and blocks of extracted text, pages and blank runs.

All rules are Column expressions over the array of a text's lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.text import strip

#: Patterns of lines that running headers, footers and signatures leave.
LINE_PATTERNS = (
    r"^.*\(\d{6,8}\)\s+SEI\s+\d{4,5}\.\d{6}/\d{4}-\d{2}\s*/\s*pg\.\s*\d+\s*$",
    r"(?i)^\s*P[aá]g\.\s*\d+\s+d[ae]\s+Exposi[cç][aã]o de Motivos.*$",
    r"(?i)^\s*Documento\s+assinado\s+digitalmente\.?\s*$",
    r"^\s*Consulte a autenticidade deste documento em http://sicnet2\.aneel\.gov\.br/sicnetweb/v\.aspx,?\s*informando o c[oó]digo de verifica[cç][aã]o\s+[0-9A-Fa-f]+\.?\s*$",
    r"(?i)^\s*Documento assinado digitalmente por .+$",
)
#: Patterns of a bare protocol number, and of the lines that blocks begin with or hold.
PROTOCOL_STAMP = r"^\s*\d{4,5}\.\d{6}/\d{4}-\d{2}(-\d+)?\s*(\(ANEXO:\s*\d+\))?\s*$"
SIGNATURE = r"(?i)^\s*\((Assinad[oa]\s+(digitalmente|digital)|Assinatura\s+digital)\)\s*$"
SIGNED_BY = r"(?i)^\s*Documento assinado eletronicamente por\b"
AUTHENTIC = r"(?i)^\s*A autenticidade deste documento pode ser conferida\b"
REFERENCE = r"(?i)^\s*Refer[eê]ncia:\s*Processo n[ºo]\b"


_SIGNED_NAMES = 3
#: The two lines that a garbled stamp begins with, and what its last line holds.
STAMP_FIRST, STAMP_SECOND, STAMP_LAST = "Documento", "documentoassinado", "consulte a autenticidade"
_BREAK = r"[\s\x0B\x1C-\x1F]+"
_DROP, _STAMP, _SIGNATURE, _SIGNED_BY = 1, 2, 3, 4


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once for a row however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _like(s: Column, pattern: str) -> Column:
    return s.rlike("(?Ud)" + pattern)


def _first(places: Column, least: Column, other: Column) -> Column:
    """The smallest of some numbers that is at least ``least``, else ``other``."""
    return F.coalesce(F.array_min(F.filter(places, lambda p: p >= least)), other)


def filter_lines(text: Column, patterns: tuple[str, ...] = LINE_PATTERNS, literals: tuple[str, ...] = (), contains: tuple[str, ...] = (), rubrics: tuple[str, ...] = (), own: Column | None = None) -> Column:
    """The text without boilerplate; null stays null. ``own``: a struct of the arrays literals, contains and rubrics, further rules of the row itself.

    Every line is classified once. Lines that match a pattern, are a literal or contain a given string go, and of a line with a
    rubric behind a gap the rubric goes. Three kinds of lines begin a block: a garbled stamp reaches to its last line (else to the
    end), a signature over at most three filled lines, and an electronic signature over its paragraph, the paragraph on
    authenticity and the line of reference behind it, where these follow. Blocks are taken from the top on, those that begin inside
    another left out, and their lines go.
    """
    rubric = r"^(.*\S)\s{6,}(?:" + "|".join(r"\Q" + r + r"\E" for r in rubrics) + r")\s*$" if rubrics else None

    def classified(x: Column, i: Column, lines: Column) -> Column:
        s = strip(x)
        gone = s.isin(*literals) if literals else F.lit(False)
        for p in patterns:
            gone = gone | _like(s, p)
        for c in contains:
            gone = gone | s.contains(c)
        marked, kept = (_like(x, rubric), F.regexp_extract(x, "(?Ud)" + rubric, 1)) if rubric else (F.lit(False), x)
        if own is not None:
            gone = gone | F.array_contains(own["literals"], s) | F.exists(own["contains"], s.contains)
            tail = F.concat(F.lit(r"(?Ud)^(.*\S)\s{6,}(?:"), F.array_join(F.transform(own["rubrics"], lambda r: F.concat(F.lit(r"\Q"), r, F.lit(r"\E"))), "|"), F.lit(r")\s*$"))
            listed = (F.size(own["rubrics"]) > 0) & F.regexp_like(x, tail)
            kept = F.when(marked, kept).when(listed, F.call_function("regexp_extract", x, tail, F.lit(1))).otherwise(x)
            marked = marked | listed
        stamp = (s == STAMP_FIRST) & (F.lower(strip(F.get(lines, i + 1))) == STAMP_SECOND)
        kind = F.when(gone, _DROP).when(marked, 0).when(F.coalesce(stamp, F.lit(False)), _STAMP).when(_like(s, SIGNATURE), _SIGNATURE).when(_like(s, SIGNED_BY), _SIGNED_BY).otherwise(0)
        kept = F.when(marked, kept).otherwise(x) if rubric or own is not None else x
        return F.struct(i.alias("i"), kept.alias("text"), kind.alias("kind"), (s == "").alias("blank"), _like(s, AUTHENTIC).alias("authentic"), _like(s, REFERENCE).alias("reference"), F.lower(s).contains(STAMP_LAST).alias("last"))

    def places(rows: Column, which: str) -> Column:
        return F.transform(F.filter(rows, lambda r: ~r["blank"] if which == "filled" else r[which]), lambda r: r["i"])

    def end_of(start: Column, at: Column, n: Column) -> Column:
        i = start["i"]
        stamp = _first(at["last"], i + 1, n - 1) + 1
        signature = F.least(_first(at["blank"], i + 1, n), i + 1 + _SIGNED_NAMES)
        next_filled = lambda j: _first(at["filled"], j, n)
        next_blank = lambda j: _first(at["blank"], j, n)
        second = lambda j: F.when(F.array_contains(at["authentic"], j), next_filled(next_blank(j))).otherwise(j)
        third = lambda j: F.when(F.array_contains(at["reference"], j), j + 1).otherwise(j)
        signed_by = bind(bind(next_filled(next_blank(i)), second), third)
        return F.when(start["kind"] == _STAMP, stamp).when(start["kind"] == _SIGNATURE, signature).otherwise(signed_by)

    def without(rows: Column) -> Column:
        n = F.size(rows)
        at = F.struct(*(places(rows, x).alias(x) for x in ("blank", "filled", "authentic", "reference", "last")))
        starts = F.filter(rows, lambda r: r["kind"] > _DROP)
        spans = bind(at, lambda a: F.transform(starts, lambda r: F.struct(r["i"].alias("a"), end_of(r, a, n).cast("int").alias("b"))))
        none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<a:int,b:int>>").alias("taken"))
        taken = F.aggregate(spans, none, lambda t, x: F.when(x["a"] >= t["upto"], F.struct(x["b"].alias("upto"), F.array_append(t["taken"], x).alias("taken"))).otherwise(t), lambda t: t["taken"])
        stays = lambda gone: F.filter(rows, lambda r: (r["kind"] != _DROP) & ~F.exists(gone, lambda x: (x["a"] <= r["i"]) & (r["i"] < x["b"])))
        return F.array_join(F.transform(bind(taken, stays), lambda r: r["text"]), "\n")

    return bind(bind(F.split(text, "\n"), lambda lines: F.transform(lines, lambda x, i: classified(x, i, lines))), without)


def drop_lines(text: Column, patterns: tuple[str, ...] = LINE_PATTERNS, literals: tuple[str, ...] = (), contains: tuple[str, ...] = ()) -> Column:
    """The rules for single lines alone."""

    def stays(x: Column) -> Column:
        s = strip(x)
        bad = F.lit(False)
        for p in patterns:
            bad = bad | _like(s, p)
        for c in contains:
            bad = bad | s.contains(c)
        return ~(bad | s.isin(*literals)) if literals else ~bad

    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def collapse_blank_runs(text: Column) -> Column:
    """Of blank lines in a row one stays."""
    return bind(F.split(text, "\n"), lambda lines: F.array_join(F.filter(lines, lambda x, i: ~((strip(x) == "") & (i > 0) & (strip(F.get(lines, i - 1)) == ""))), "\n"))


def drop_first_stamp(text: Column, pattern: str = PROTOCOL_STAMP) -> Column:
    """A bare protocol number as the first line that is not blank goes."""

    def without(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: strip(x) != ""), True) - 1
        return bind(first, lambda f: F.array_join(F.filter(lines, lambda x, i: ~((i == f) & _like(x, pattern))), "\n"))

    return bind(F.split(text, "\n"), without)


def marked_pages(text: Column) -> Column:
    """Array of (page, text) cut at ``<!-- pdftotext:page N -->``; what stands before the first marker is dropped."""
    parts = F.split(text, r"(?m)^<!-- pdftotext:page (?=\d+ -->$)")
    number, rest = lambda p: F.regexp_extract(p, r"^(\d+) -->", 1).cast("int"), lambda p: F.regexp_replace(p, r"^\d+ -->\n?", "")
    return F.transform(F.filter(parts, lambda p, i: i > 0), lambda p: F.struct(number(p).alias("page"), rest(p).alias("text")))
