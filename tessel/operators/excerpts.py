"""Where excerpts stand in texts, and texts cut into highlighted and other segments.

All excerpts are looked for at once: an automaton (Aho-Corasick) over their first ``KEY`` characters runs once over each text, and what begins at a hit is compared
with the excerpts of that beginning. Excerpts that fit ``AT_ONCE`` bytes, a checked size, are sent to the tasks that read the texts; more of them are cut into tiles
that meet tiles of texts by a shuffle, so that an automaton never holds more than some of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators import tiles

KEY, AT_ONCE = 32, 8 << 20
_SPAN = "array<struct<start:int,size:int>>"


class Searcher:
    """First places of excerpts in texts."""

    def __init__(self, excerpts: list[tuple[int, str]]):
        """excerpts: number and text, not empty."""
        self._keys = ahocorasick.Automaton()
        by_key: dict[str, dict[int, dict[str, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for n, e in excerpts:
            by_key[e[:KEY]][len(e)][e].append(n)
        for key, sizes in by_key.items():
            self._keys.add_word(key, (len(key), {size: dict(x) for size, x in sizes.items()}))
        if by_key:
            self._keys.make_automaton()

    def first(self, text: str) -> dict[int, int]:
        """Number of each excerpt that the text holds: its first place."""
        out: dict[int, int] = {}
        if not len(self._keys):
            return out
        for end, (length, sizes) in self._keys.iter(text):
            start = end + 1 - length
            for size, known in sizes.items():
                for n in known.get(text[start : start + size], ()):
                    out.setdefault(n, start)
        return out


def excerpt_places(texts: DataFrame, excerpts: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """texts: doc_id, text; excerpts: item_id, excerpt. doc_id, item_id, excerpt and place (in characters, from 0) of the first occurrence of each excerpt in each
    text that holds it. Rows with a null id, null and empty excerpts and null texts have none; repeated rows count once."""
    known = tiles.pack(excerpts.where("excerpt <> ''").select("item_id", "excerpt").distinct(), "item_id", "excerpt")
    rows = texts.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text")
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((texts, "doc_id"), (excerpts, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, excerpt string, place int"
    if known.size <= at_once:
        sent = texts.sparkSession.sparkContext.broadcast([bytes(r[0]) for r in known.frame.select("payload").collect()])  # at_once bytes at most

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [pa.ipc.open_stream(p).read_all() for p in sent.value]
            yield from _found(held, (pa.Table.from_batches([b]) for b in batches)) if held else ()

        found = rows.mapInArrow(scan, schema)
    else:
        found = tiles.compare(known, tiles.pack(rows, "doc_id", "text"), _found, schema)
    return found.distinct()


def _found(lefts: list[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    left = pa.concat_tables(lefts)
    items, wanted = tiles.column(left, "item_id"), tiles.column(left, "excerpt")
    search = Searcher(list(enumerate(wanted.to_pylist())))
    for t in rights:
        docs, at = tiles.column(t, "doc_id"), [(i, n, p) for i, text in enumerate(t.column("text").to_pylist()) for n, p in search.first(text).items()]
        i, n, p = (pa.array(x, pa.int32()) for x in (zip(*at) if at else ([], [], [])))
        yield pa.record_batch([docs.take(i), items.take(n), wanted.take(n), p], names=["doc_id", "item_id", "excerpt", "place"])


def segments(text: Column, spans: Column) -> Column:
    """spans: array of (start, size) in order. The text in segments (highlighted, text); of overlapping spans the earlier one stays. Null for a null text; nothing
    of an empty one."""

    def keep(acc: Column, s: Column) -> Column:
        fits = s["start"] >= acc["at"]
        gap = F.struct(acc["at"].alias("start"), (s["start"] - acc["at"]).alias("size"), F.lit(False).alias("marked"))
        both = F.concat(acc["out"], F.array(gap, F.struct(s["start"].alias("start"), s["size"].alias("size"), F.lit(True).alias("marked"))))
        return F.when(fits, F.struct((s["start"] + s["size"]).alias("at"), both.alias("out"))).otherwise(acc)

    none = F.array().cast("array<struct<start:int,size:int,marked:boolean>>")
    cut = lambda x: F.struct(x["marked"].alias("highlighted"), F.substring(text, x["start"] + 1, x["size"]).alias("text"))
    tail = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (F.length(text) - acc["at"]).alias("size"), F.lit(False).alias("marked"))))
    parts = F.aggregate(F.coalesce(spans, F.array().cast(_SPAN)), F.struct(F.lit(0).alias("at"), none.alias("out")), keep, tail)
    return F.when(text.isNotNull(), F.transform(F.filter(parts, lambda x: x["size"] > 0), cut))


def highlight(text: Column | str, excerpts: Column | str) -> Column:
    """A text with its own few excerpts: the first place of each; of those that begin alike, the first of the array."""
    text, excerpts = (F.col(c) if isinstance(c, str) else c for c in (text, excerpts))
    at = F.transform(excerpts, lambda e, k: F.struct((F.instr(text, e) - 1).cast("int").alias("start"), k.alias("k"), F.length(e).cast("int").alias("size")))
    met = F.array_sort(F.filter(at, lambda x: (x["start"] >= 0) & (x["size"] > 0)))
    return segments(text, F.transform(met, lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"))))


def highlighted(texts: DataFrame, places: DataFrame) -> DataFrame:
    """places: as of ``excerpt_places``. doc_id, pos, highlighted and text of the segments of each text that holds an excerpt. Of overlapping places the earlier one
    stays, of those that begin alike that of the smaller item_id."""
    size = F.length("excerpt").cast("int")
    spans = F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id", size.alias("size")))), lambda x: F.struct(x["place"].alias("start"), x["size"].alias("size")))
    met = texts.select("doc_id", "text").join(places.groupBy("doc_id").agg(spans.alias("spans")), "doc_id")
    return met.select("doc_id", F.posexplode(segments(F.col("text"), F.col("spans"))).alias("pos", "s")).select("doc_id", "pos", "s.highlighted", "s.text")
