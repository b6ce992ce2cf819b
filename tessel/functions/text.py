"""String functions of the document model as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a trailing number of a document type, repeated as often as it occurs.
_TYPE_NUMBER = r"(?iu)(\s+(?:n[º°o]\.?\s*)?[\d./-]+(?:\s*-\s*[a-zçãõáéíóúâêô]+)?)+$"
_FORMS = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0x80, 0x3000))} | {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0xFB00, 0xFF70))}
_MARKED, _PLAIN = ("".join(x) for x in zip(*((c, p) for c, p in _FORMS.items() if len(p) == 1)))
_LONGER = [(c, p) for c, p in _FORMS.items() if len(p) > 1 and (c < "\u0250" or "\ufb00" <= c < "\ufb07")]
#: The characters that count as white space at the ends of a string.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(s, F.lit(_SPACE))


def normalize_type(name: Column) -> Column:
    return F.regexp_replace(strip(name), _TYPE_NUMBER, "")


def collapse_space(s: Column) -> Column:
    """Every run of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " "))


def solid_length(s: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]", ""))


def process_number(directory: Column) -> Column:
    """``48500_012345_2026-01`` as ``48500.012345/2026-01``; anything that has not three parts stays."""
    p = F.split(directory, "_")
    return F.when(F.size(p) == 3, F.concat(p[0], F.lit("."), p[1], F.lit("/"), p[2])).otherwise(directory)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def iso_date(day: Column) -> Column:
    """dd/mm/yyyy as yyyy-mm-dd; anything else stays."""
    return F.when(day.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.regexp_replace(day, r"^(\d{2})/(\d{2})/(\d{4})$", "$3-$2-$1")).otherwise(day)


def plain_ascii(s: Column) -> Column:
    """Letters without their marks, compatibility forms spelled out, and nothing beyond ASCII."""
    return F.regexp_replace(F.translate(reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _LONGER, s), _MARKED, _PLAIN), r"[^\x00-\x7F]", "")


def slug(s: Column, mark: str = "-", empty: str = "") -> Column:
    """Lower-case ASCII letters and digits with ``mark`` between them; ``empty`` if nothing is left."""
    out = F.btrim(F.regexp_replace(F.lower(plain_ascii(s)), "[^a-z0-9]+", mark), F.lit(mark))
    return F.when(out == "", empty).otherwise(out) if empty else out


def index_name(model: Column, prefix: str) -> Column:
    """A prefix and the model's name in lower case, with hyphens for all but letters, digits, dots, hyphens and underscores."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.lower(model), "[^a-z0-9._-]", "-"))


def word_slug(s: Column) -> Column:
    """Letters and digits of any script stay, each other character is a hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(strip(s)), r"[^\p{L}\p{N}]", "-"), F.lit("-"))


def file_name(s: Column) -> Column:
    """A name for a file: letters, digits, dots, hyphens and underscores stay, each other character is a hyphen; ``item`` if nothing is left."""
    out = F.btrim(F.regexp_replace(strip(s), r"[^\p{L}\p{N}._-]", "-"), F.lit(".-"))
    return F.when(out == "", "item").otherwise(out)


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds ties to the even neighbour, on the decimal text of a number."""
    return F.bround(x, digits)


def macro_theme(s: Column) -> Column:
    """What stands before a colon, else before a hyphen."""
    return F.trim(F.when(s.contains(":"), F.substring_index(s, ":", 1)).otherwise(F.substring_index(s, "-", 1)))


def title_of(kind: Column) -> Column:
    """snake_case as Title Case."""
    return F.array_join(F.transform(F.split(kind, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def escape_cell(s: Column) -> Column:
    return F.replace(s, F.lit("|"), F.lit("\\|"))


def chunk_id(version: Column, index: Column) -> Column:
    return F.format_string("%s#chunk-%04d", version, index)


def chunk_index(chunk: Column) -> Column:
    """The number in a chunk id; an id without one is an error."""
    n = F.regexp_extract(chunk, r"#chunk-(\d+)$", 1)
    return F.when(n != "", n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("no chunk id: "), chunk)).cast("int"))


def page_marker(line: Column) -> Column:
    n = F.regexp_extract(F.trim(line), r"^<!--\s*page:(\d+)\s*-->\s*$", 1)
    return F.when(n != "", n.cast("int"))


def is_heading(line: Column) -> Column:
    """At most 120 characters, no column gap, three letters or more, four fifths of them upper case."""
    s = strip(line)
    letters, upper = F.length(F.regexp_replace(s, r"[^\p{L}]", "")), F.length(F.regexp_replace(s, r"[^\p{Lu}]", ""))
    return (F.length(s) > 0) & (F.length(s) <= 120) & ~s.rlike(r"\S {2,}\S") & (letters >= 3) & (upper >= 0.8 * letters)


def is_table(lines: Column) -> Column:
    """Two lines or more, three fifths of them with a column gap."""
    gaps = F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"\S {2,}\S")))
    return (F.size(lines) >= 2) & (gaps >= 0.6 * F.size(lines))


def sentences(s: Column) -> Column:
    return F.split(s, r"(?<=[.;:!?])\s+")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def percent_removed(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round(F.greatest(100.0 * (before - after) / before, F.lit(0.0)), 1)).otherwise(0.0)


def data_mode(embedder: Column) -> Column:
    return F.when(embedder.isin("bedrock", "cached"), "real").otherwise("demo")
