"""Mixing of sources to target weights by a low-discrepancy schedule of equal-token blocks. DataFrame functions only.

Each source's documents are put in a shuffled order (by a hash of the key) and their words cut into blocks of equal size. A source
has as many slots as its target needs blocks. All slots together are numbered, and the van der Corput sequence (bit reversal)
deals these numbers over the schedule: position v(r) of the schedule holds number r, and the cumulative slot counts tell whose
number it is. So each source is spread evenly and gets its slots exactly. Slots are ranked within a source in order of the
schedule; the k-th slot takes the source's block k modulo its number of blocks. A document's place in the mix is that of the first slot that
takes words of it.

Sources are ordered by code point, null last; weights repeat in that order. Targets share all words by weight; a target above
``MOST`` times its source's words stops there and the excess is shared again. A null text has 0 words and is never taken. Equal
rows are documents of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table

WEIGHTS, MOST, BLOCK, LEAST_BLOCKS, SEED = (1, 2, 3), 3, 512, 1024, "7"
_CHUNK, _PART = 1 << 16, 512


def word_count(text: Column) -> Column:
    blank = F.coalesce(text, F.lit(""))
    for c in "\n\t\x0b\x0c\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(blank, " "), "")).cast("long")


def bit_reverse(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of x in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask).cast("long")
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.shiftrightunsigned(x, 64 - bits)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """sizes: source, source_size. Adds sid, weight, target, n_blocks, n_slots and first_slot. One row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table_ = F.array(*[F.lit(float(w)) for w in weights])
    w = F.element_at(table_, ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", w).withColumn("most", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    up_to, whole = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - (F.sum("most").over(up_to) - F.col("most"))
    rows = rows.withColumn("level", left / (F.sum("weight").over(whole) - F.sum("weight").over(up_to) + F.col("weight")))
    level = F.first(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level")), ignorenulls=True).over(whole)
    rows = rows.withColumn("target", F.least(F.coalesce(level * F.col("weight"), F.col("most")), F.col("most")))
    n = F.greatest(F.ceil(F.col("source_size") / block), F.least("source_size", F.lit(least_blocks))).cast("long")
    rows = rows.withColumn("n_blocks", n)
    slots = F.when(n > 0, F.least(F.floor(F.col("target") * n / F.col("source_size") + 0.5), n * most)).otherwise(0).cast("long")
    rows = rows.withColumn("n_slots", slots)
    return rows.withColumn("first_slot", F.sum("n_slots").over(by_name) - F.col("n_slots")).drop("most", "level")


def schedule(sources: DataFrame, bits: int) -> DataFrame:
    """position (in the schedule), sid, rank (0, 1, ... within the source), block and epoch of every slot."""
    parts = sources.where("n_slots > 0").select("sid", "n_blocks", "first_slot", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / _CHUNK))).alias("part"))
    start = F.col("part") * _CHUNK
    ids = parts.repartition("sid", "part").select("sid", "n_blocks", F.explode(F.sequence(F.col("first_slot") + start, F.col("first_slot") + F.least(start + _CHUNK, F.col("n_slots")) - 1)).alias("number"))
    slots = ids.select("sid", "n_blocks", bit_reverse(F.col("number"), bits).alias("position")).withColumn("chunk", F.shiftright("position", max(0, bits - max(0, bits - 16))))
    sizes = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("sid").alias("s"), F.col("chunk").alias("c"), (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("position"))
    ranked = slots.withColumn("nth", nth).join(before.hint("merge"), (F.col("sid") == F.col("s")) & (F.col("chunk") == F.col("c"))).withColumn("rank", F.col("before") + F.col("nth") - 1)
    return ranked.select("position", "sid", "rank", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"))


def _block_of(word: Column) -> Column:
    n = F.greatest("n_blocks", F.lit(1))
    small, longer = F.floor(F.col("source_size") / n), F.col("source_size") % n
    cut = longer * (small + 1)
    return F.when(word < cut, F.floor(word / (small + 1))).otherwise(longer + F.floor((word - cut) / F.greatest(small, F.lit(1)))).cast("long")


def _start_of(block: Column) -> Column:
    n = F.greatest("n_blocks", F.lit(1))
    return block * F.floor(F.col("source_size") / n) + F.least(block, F.col("source_size") % n)


def _words_before(rows: DataFrame, head: int) -> DataFrame:
    """Words of a source before each part, summed up in two steps: over the parts' first ``head`` digits, then within them."""
    sums = rows.groupBy("sid", F.substring("part", 1, head).alias("head"), "part").agg(F.sum("size").alias("words"))
    heads = sums.groupBy("sid", "head").agg(F.sum("words").alias("words"))
    heads = heads.select(F.col("sid").alias("hs"), F.col("head").alias("hh"), (F.sum("words").over(Window.partitionBy("sid").orderBy("head")) - F.col("words")).alias("base"))
    within = F.sum("words").over(Window.partitionBy("sid", "head").orderBy("part")) - F.col("words")
    parts = sums.withColumn("within", within).join(heads, (F.col("sid") == F.col("hs")) & (F.col("head") == F.col("hh")))
    return parts.select(F.col("sid").alias("s1"), F.col("part").alias("p1"), (F.col("base") + F.col("within")).alias("before"))


def mix(spark: SparkSession, docs: DataFrame, ws: Workspace, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, least_blocks: int = LEAST_BLOCKS, seed: str = SEED, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents (key, source, h, size, source_size, target, taken, positions) and the schedule.

    h with the key tells equal rows' order. positions: where in the schedule the first block that has words of the document and is taken
    comes (at most ``most`` places, ascending; null if no word is taken). 2 ** bits of the schedule's span is a column of it, too.
    """
    h = F.md5(F.concat_ws(":", F.coalesce(docs[key].cast("string"), F.lit("null")), F.lit(seed)))
    rows = ws.save(docs.select(docs[key].alias("k"), docs["source"], h.alias("h"), word_count(docs["text"]).alias("size")), "sizes")
    sources = ws.save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, block, least_blocks), "sources")
    total = sources.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    bits = max(1, int(total).bit_length())
    plan = schedule(sources, bits)
    digits = max(2, math.ceil(math.log(rows.count() / _PART + 1, 16)))
    s = sources.select(F.col("source").alias("s"), "sid", "source_size", "target", "n_blocks")
    rows = rows.join(s, rows["source"].eqNullSafe(s["s"])).drop("s").withColumn("part", F.substring("h", 1, digits))
    before = _words_before(rows, digits // 2)
    order = Window.partitionBy("sid", "part").orderBy("h", "k", "size")
    placed = rows.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(order))
    placed = placed.join(before.hint("merge"), (F.col("sid") == F.col("s1")) & (F.col("part") == F.col("p1"))).withColumn("at", F.col("before") + F.col("upto") - F.col("size"))
    last = F.col("at") + F.greatest(F.col("size") - 1, F.lit(0))
    pieces = placed.withColumn("block", F.explode(F.sequence(_block_of(F.col("at")), _block_of(last))))
    words = F.least(F.col("at") + F.col("size"), _start_of(F.col("block") + 1)) - F.greatest(F.col("at"), _start_of(F.col("block")))
    pieces = pieces.withColumn("words", F.greatest(words, F.lit(0)))
    visits = plan.groupBy(F.col("sid").alias("vs"), F.col("block").alias("vb")).agg(F.count(F.lit(1)).alias("visits"), F.array_sort(F.collect_list("position")).alias("positions"))
    met = pieces.join(visits.hint("merge"), (F.col("sid") == F.col("vs")) & (F.col("block") == F.col("vb")), "left")
    kept = [F.first(c).alias(c) for c in ("k", "source", "h", "size", "source_size", "target")]
    first = F.min(F.when((F.col("visits") > 0) & (F.col("words") > 0), F.struct("block", "positions")))
    out = met.groupBy("sid", "part", "nth").agg(*kept, F.sum(F.col("words") * F.coalesce("visits", F.lit(0))).cast("long").alias("taken"), first.alias("first"))
    return out.select(F.col("k").alias(key), "source", "h", "size", "source_size", "target", "taken", F.col("first.positions").alias("positions"), F.lit(1 << bits).cast("long").alias("span")), plan


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mix(spark, table(spark, sf_dir, "documents"), Workspace(spark, "mixing"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.get("positions", F.lit(0)).alias("first_position"))


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE = {
    "op3_mix_sources": f"""
WITH d AS (SELECT doc_id, source, md5(concat(coalesce(CAST(doc_id AS VARCHAR), 'null'), ':{SEED}')) AS h,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS sid FROM s0),
s2 AS (SELECT *, CAST((sid - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size * {MOST} AS DOUBLE) AS most FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - (sum(most) OVER o - most)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM s2 WINDOW o AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT arg_min(level, most / weight) AS level FROM s3 WHERE level <= most / weight),
s4 AS (SELECT s3.source, sid, source_size, least(coalesce((SELECT level FROM l) * weight, most), most) AS target,
  CAST(greatest(ceil(source_size / {BLOCK}.0), least(source_size, {LEAST_BLOCKS})) AS BIGINT) AS n FROM s3),
s5 AS (SELECT *, CASE WHEN n > 0 THEN CAST(least(floor(target * n / source_size + 0.5), n * {MOST}) AS BIGINT) ELSE 0 END AS slots FROM s4),
p AS (SELECT d.*, s5.* EXCLUDE (source), CAST(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS pos
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
b AS (SELECT length(bin(greatest(sum(slots), 1))) AS bits FROM s5),
slot AS (SELECT sid, n, CAST(sum(slots) OVER (ORDER BY sid) - slots AS BIGINT) AS first, slots FROM s5),
num AS (SELECT sid, n, first + unnest(range(slots)) AS number FROM slot),
pos AS (SELECT sid, n, CAST(list_sum(list_transform(range(bits), lambda i: ((number >> i) & 1) << (bits - 1 - i))) AS BIGINT) AS position FROM num, b),
r AS (SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY position) - 1) % n AS block, position FROM pos),
visit AS (SELECT sid, block, count(*) AS visits, min(position) AS first_position FROM r GROUP BY 1, 2),
g AS (SELECT row_number() OVER () AS row, *, source_size // n AS q, source_size % n AS m FROM p WHERE size > 0),
e AS (SELECT *, m * (q + 1) AS cut FROM g),
f AS (SELECT *, unnest(range(CASE WHEN pos < cut THEN pos // (q + 1) ELSE m + (pos - cut) // greatest(q, 1) END,
  1 + CASE WHEN pos + size - 1 < cut THEN (pos + size - 1) // (q + 1) ELSE m + (pos + size - 1 - cut) // greatest(q, 1) END)) AS block FROM e),
w AS (SELECT f.*, least(pos + size, (f.block + 1) * q + least(f.block + 1, m)) - greatest(pos, f.block * q + least(f.block, m)) AS words, visits, first_position
  FROM f LEFT JOIN visit ON f.sid = visit.sid AND f.block = visit.block)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(sum(words * coalesce(visits, 0)) AS BIGINT) AS taken, arg_min(first_position, block) FILTER (WHERE visits > 0) AS first_position
  FROM w GROUP BY row, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, round(target, 6), 0, NULL FROM p WHERE size = 0""",
}
