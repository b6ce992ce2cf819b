"""Exact join of documents by the Jaccard similarity of their word n-gram sets, with signature trees.

1. Copies: documents with equal sets form a class; the smallest key stands for it.
2. Groups: two sets that are similar enough share a shingle among the first |x| - ceil(t |x|) + 1 of each, in any fixed order
   (prefix filter). Shingles are ordered by how often their hash bucket occurs in the whole corpus, rarest first. Documents that
   share a prefix shingle form a group; groups with equal members are one.
3. Trees: a group is cut into blocks, and over each block a signature tree is built. A leaf is a document with its bitmap of
   shingles, an inner node the OR of the bitmaps, the range of sizes and the largest number of shingles that share a bit. A tree is
   traversed against itself; a pair of nodes is dropped if the largest possible overlap, the common bits of both bitmaps plus the
   shared ones, is too small for any two sizes of their ranges.
4. First rounds: a few groups of each document, among those that hold several components; of the pairs that the traversal leaves, those that
   look most similar are taken as a spanning forest of the components, and these are compared exactly. This joins groups of copies by about as many
   comparisons as they have members.
5. Last round: every group that still holds documents of two components is traversed in full, pairs within a component left out
   (also for whole nodes), and all pairs that are left and not yet compared are compared exactly. Large groups are cut into blocks by
   component, and pairs of blocks of one component are left out. So no link between different components is missed.

A null or empty text has an empty set and is linked with nothing. A text of fewer words has its whole sequence as its one shingle.
Rows with the same key are one node: each of their texts may link it. A row without key is linked with nothing and its component
is null. Keys are cast to long; others are an error. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import _text
from tessel.llm._store import Workspace, table

BUCKETS, CHUNK, FAN_IN, SALTS = 1 << 20, 4096, 256, 8
BITS, FANOUT, FIRST, ROUNDS, BLOCK_ONE, BLOCK_TWO = 2048, 8, 3, 3, 256, 512
_WORDS = BITS // 64
FILTER_BITS, _FILTER_PART = 1 << 25, 1 << 14


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = _text.words_of(texts)
    hashes, off = _text.shingle_hashes(words, first, k)
    return [np.unique(hashes[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def bucket_ranks(docs: DataFrame, k: int) -> np.ndarray:
    """For each of BUCKETS hash buckets how many (document, shingle) pairs it has, on a logarithmic scale of one byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, any_ = np.zeros(BUCKETS, np.int64), False
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for s in sets_of(batch.column(0).slice(i, 512), k):
                    np.add.at(n, _bucket(s), 1)
                    any_ |= len(s) > 0
        if any_:
            parts = n.reshape(-1, CHUNK)
            yield pa.record_batch({"chunk": pa.array(np.arange(len(parts)), pa.int64()), "salt": pa.array([TaskContext.get().partitionId() // FAN_IN] * len(parts), pa.int64()), "n": pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for b in rows.column("n"):
            total += np.frombuffer(b.as_buffer(), "<i8")
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "salt": pa.array([0], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    schema = "chunk long, salt long, n binary"
    parts = docs.select("text").mapInArrow(count, schema)
    some = parts.groupBy("chunk", "salt").applyInArrow(add, schema)
    rows = some.groupBy("chunk").applyInArrow(add, schema).collect()
    n = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in rows:
        n[r["chunk"]] = np.frombuffer(bytes(r["n"]), "<i8")
    return np.minimum(np.floor(4 * np.log2(n.reshape(-1) + 1)), 255).astype(np.uint8)


def signatures(docs: DataFrame, k: int, num: int, den: int, ranks: np.ndarray) -> DataFrame:
    """doc_id, n, key (digest of the set), prefix and bits of each document with a non-empty set; n = 0 rows have no prefix."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                sets = sets_of(part.column(1), k)
                prefixes, bits, keys = [], [], []
                for s in sets:
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    rank = ranks[_bucket(s)]
                    if p < len(s):
                        cut = np.partition(rank, p - 1)[p - 1]
                        low = s[rank < cut]
                        s_p = np.concatenate([low, s[rank == cut][: p - len(low)]])
                    else:
                        s_p = s
                    prefixes.append(s_p.view(np.int64))
                    own = np.zeros(BITS, bool)
                    own[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
                    bits.append(np.packbits(own, bitorder="little").tobytes() if len(s) else None)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                off = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "key": pa.array(keys, pa.binary()),
                        "prefix": pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64())),
                        "bits": pa.array(bits, pa.binary()),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n long, key binary, prefix array<long>, bits binary")


class Tree:
    """A signature tree over documents in the given order; level 0 holds the documents."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, comp: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, n, n, slack, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, sl, c0, c1 = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at), np.minimum.reduceat(c0, at), np.maximum.reduceat(c1, at)))

    def _possible(self, level: int, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
        bits, lo, hi, slack, c0, c1 = self.levels[level]
        most = np.bitwise_count(bits[p] & bits[q]).sum(axis=1).astype(np.int64) + np.minimum(slack[p], slack[q])
        most = np.minimum(most, np.minimum(hi[p], hi[q]))
        one = (c0[p] == c1[p]) & (c0[q] == c1[q]) & (c0[p] == c0[q])
        return (most * (num + den) >= num * (lo[p] + lo[q])) & ~one

    def pairs(self, num: int, den: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents of different components whose bitmaps and sizes allow the similarity."""
        top = len(self.levels) - 1
        p = q = np.zeros(1, np.int64)
        for level in range(top, 0, -1):
            p, q = self._kept(level, p, q, num, den, step)
            below = len(self.levels[level - 1][1])
            i, j = np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij")
            p, q = (p[:, None] * FANOUT + i.reshape(-1)).reshape(-1), (q[:, None] * FANOUT + j.reshape(-1)).reshape(-1)
            ok = (p < below) & (q < below) & ((p < q) if level == 1 else (p <= q))
            p, q = p[ok], q[ok]
        if top == 0:
            return p[:0], q[:0]
        p, q = self._kept(0, p, q, num, den, step)
        n, apart = self.levels[0][1], self.apart(p, q, step)
        ok = (n[p] + n[q] - apart) * (num + den) >= 2 * num * (n[p] + n[q])
        return p[ok], q[ok]

    def apart(self, p: np.ndarray, q: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Bits in which documents differ: at most as many as shingles that only one of them has."""
        bits = self.levels[0][0]
        return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(bits[p[a : a + step]] ^ bits[q[a : a + step]]).sum(axis=1).astype(np.int64) for a in range(0, len(p), step))])

    def _kept(self, level, p, q, num, den, step):
        ok = [self._possible(level, p[a : a + step], q[a : a + step], num, den) for a in range(0, len(p), step)]
        ok = np.concatenate(ok) if ok else np.zeros(0, bool)
        return p[ok], q[ok]


def _forest(p: np.ndarray, q: np.ndarray) -> list[int]:
    """Numbers of pairs, in their order, that join what the earlier ones don't."""
    distinct, at = np.unique(np.concatenate([p, q]), return_inverse=True)
    p, q = at[: len(p)], at[len(p) :]
    up, kept, left = list(range(len(distinct))), [], len(distinct) - 1

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (a, b) in enumerate(zip(p.tolist(), q.tolist())):
        a, b = top(a), top(b)
        if a != b:
            up[b] = a
            kept.append(k)
            left -= 1
            if not left:
                break
    return kept


def candidates(rows: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """rows: g (a bounded block), rep, n, bits, comp. Pairs a < b that a traversal of each block's tree leaves."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table_: pa.Table) -> pa.RecordBatch:
            g, rep = table_.column("g").to_numpy(), table_.column("rep").to_numpy()
            n, comp = table_.column("n").to_numpy(), table_.column("comp").to_numpy()
            bits = np.frombuffer(b"".join(table_.column("bits").to_pylist()), np.uint64).reshape(len(g), _WORDS)
            cuts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            ends = np.append(cuts[1:], len(g))
            two = cuts[ends - cuts == 2]
            out_a, out_b = [], []
            if len(two):
                x, y = two, two + 1
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1).astype(np.int64)
                ok = (comp[x] != comp[y]) & ((n[x] + n[y] - apart) * (num + den) >= 2 * num * (n[x] + n[y]))
                out_a.append(rep[x[ok]])
                out_b.append(rep[y[ok]])
            for s, e in zip(cuts.tolist(), ends.tolist()):
                if e - s > 2:
                    tree = Tree(n[s:e], bits[s:e], comp[s:e])
                    p, q = tree.pairs(num, den)
                    if forest and len(p):
                        best = np.argsort(tree.apart(p, q) / (n[s:e][p] + n[s:e][q]), kind="stable")
                        p, q = p[best], q[best]
                        k = _forest(comp[s:e][p], comp[s:e][q])
                        p, q = p[k], q[k]
                    out_a.append(rep[s:e][p])
                    out_b.append(rep[s:e][q])
            a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
            ok = a != b
            return pa.record_batch({"a": pa.array(np.minimum(a, b)[ok], pa.int64()), "b": pa.array(np.maximum(a, b)[ok], pa.int64())})

        for batch in batches:
            if batch.num_rows == 0:
                continue
            g = batch.column(0)
            last = g[batch.num_rows - 1].as_py()
            if held and held[0].column(0)[0].as_py() == last:
                held.append(batch)
                continue
            open_ = int(np.searchsorted(g.to_numpy(), last))  # rows are sorted by g
            whole = pa.Table.from_batches([*held, batch.slice(0, open_)])
            held = [batch.slice(open_)]
            if whole.num_rows:
                yield solve(whole)
        if held:
            yield solve(pa.Table.from_batches(held))

    cols = rows.select("g", "rep", "n", "bits", "comp")
    return cols.repartition("g").sortWithinPartitions("g", "n", "rep").mapInArrow(walk, "a long, b long").distinct()


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over longs; every task that has ids sends the parts that it has set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in _filter_places(batch.column(0).to_numpy()):
                bits[at] = True
        parts = np.packbits(bits, bitorder="little").reshape(-1, _FILTER_PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.record_batch({"chunk": pa.array(some), "n": pa.array([parts[k].tobytes() for k in some], pa.binary())})

    def join(rows: pa.Table) -> pa.Table:
        total = np.zeros(_FILTER_PART, np.uint8)
        for b in rows.column("n"):
            total |= np.frombuffer(b.as_buffer(), np.uint8)
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    found = np.zeros((FILTER_BITS // 8 // _FILTER_PART, _FILTER_PART), np.uint8)
    for r in ids.mapInArrow(mark, "chunk long, n binary").groupBy("chunk").applyInArrow(join, "chunk long, n binary").collect():
        found[r["chunk"]] = np.frombuffer(bytes(r["n"]), np.uint8)
    return found.reshape(-1)


def _filter_places(ids: np.ndarray) -> list[np.ndarray]:
    h = _text.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = _text.mix(h) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in range(4)]


def verify(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose sets are similar enough.

    Only sets of documents in a pair are sent: a filter of fixed size over their keys lets the others go where they are read (and at most some
    that aren't in a pair pass). Hashes are sent with 48 bits, of which two of a pair's sets meet by chance once in 10**8 pairs.
    """
    ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
    wanted = pairs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ok = np.ones(len(keys), bool)
            for at in _filter_places(keys):
                ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            batch = batch.take(pa.array(np.flatnonzero(ok)))
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                short = [np.ascontiguousarray((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() for s in sets_of(part.column(1), k)]
                yield pa.record_batch({"doc_id": part.column(0), "s": pa.array(short, pa.binary())})

    def unpack(b: pa.Scalar) -> np.ndarray:
        out = np.zeros((len(b.as_buffer()) // 6, 8), np.uint8)
        out[:, :6] = np.frombuffer(b.as_buffer(), np.uint8).reshape(-1, 6)
        return out.reshape(-1).view("<u8")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpack(x), unpack(y)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(common * den >= num * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    sets = texts.mapInArrow(keep, "doc_id long, s binary").where(F.octet_length("s") > 0)
    x, y = sets.select(F.col("doc_id").alias("i"), F.col("s").alias("sa")), sets.select(F.col("doc_id").alias("j"), F.col("s").alias("sb"))
    return pairs.join(x, F.col("a") == F.col("i")).join(y, F.col("b") == F.col("j")).select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()


def components(links: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """v, c: the smallest node that each linked node reaches. Labels spread along links and jump to their label's label."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    n = both.count()
    labels = ws.save(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")), f"{name}-0", most_rows=n)
    k = 0
    while True:
        k += 1
        near = both.join(labels.withColumnRenamed("v", "w"), F.col("u") == F.col("w")).groupBy("v").agg(F.min("c").alias("m"))
        step = labels.join(near.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        far = labels.select(F.col("v").alias("w"), F.col("c").alias("cc"))
        new = ws.save(step.join(far, F.col("c") == F.col("w"), "left").select("v", "old", F.least("c", "cc").alias("c")), f"{name}-{k}", most_rows=n)
        changed = new.where(F.col("c") != F.col("old")).limit(1).count()
        ws.drop(f"{name}-{k - 1}")
        labels = new.select("v", "c")
        if not changed:
            return labels


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows: gid, rep, comp, cnt of groups with several components. Adds g: groups beyond ``size`` become pairs of blocks."""
    small = rows.where(F.col("cnt") <= size).select(F.col("gid").alias("g"), "rep", "comp")
    nth = F.row_number().over(Window.partitionBy("gid").orderBy("comp", "rep"))
    large = rows.where(F.col("cnt") > size).withColumn("blk", F.floor((nth - 1) / size))
    nodes = large.groupBy("gid", "blk").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    x, y = (nodes.select(F.col("gid").alias(f"g{s}"), F.col("blk").alias(f"b{s}"), F.col("c0").alias(f"lo{s}"), F.col("c1").alias(f"hi{s}")) for s in "xy")
    one = (F.col("lox") == F.col("hix")) & (F.col("loy") == F.col("hiy")) & (F.col("lox") == F.col("loy"))
    pairs = x.join(y, (F.col("gx") == F.col("gy")) & (F.col("bx") <= F.col("by")) & ~one).select("gx", "bx", "by", F.xxhash64("gx", "bx", "by").alias("g"))
    left = pairs.select("gx", F.col("bx").alias("b"), "g")
    sides = left.union(pairs.where("bx < by").select("gx", F.col("by").alias("b"), "g"))
    return small.union(large.join(sides, (F.col("gid") == F.col("gx")) & (F.col("blk") == F.col("b"))).select("g", "rep", "comp"))


def ngram_components(spark: SparkSession, docs: DataFrame, ws: Workspace, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text)."""
    ranks = bucket_ranks(docs, k)
    full = ws.save(signatures(docs, k, num, den, ranks), "signatures")
    sig = ws.save(full.select("doc_id", "n", "key"), "keys")
    known = full.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    m = known.groupBy("key").agg(F.min(F.struct("doc_id", "n", "prefix", "bits")).alias("m"))
    reps = ws.save(m.select("key", F.col("m.doc_id").alias("rep"), "m.n", "m.prefix", "m.bits"), "classes")
    ws.drop("signatures")
    spread = reps.select("rep", F.explode("prefix").alias("token"))
    token = Window.partitionBy("token")
    spread = spread.select("rep", F.count(F.lit(1)).over(token).alias("cnt"), F.expr("bit_xor(xxhash64(rep)) OVER (PARTITION BY token)").alias("members"))
    groups = ws.save(spread.where("cnt > 1").select(F.xxhash64("members", "cnt").alias("gid"), "rep", "cnt").distinct(), "groups")
    n = groups.count()
    trees = reps.select(F.col("rep").alias("r"), "n", "bits")

    tried = links = None
    comps = spark.createDataFrame([], "v long, c long")
    for turn in range(ROUNDS + 1):
        label = groups.join(comps, F.col("rep") == F.col("v"), "left").select("gid", "rep", "cnt", F.coalesce("c", "rep").alias("comp"))
        if links is not None:  # before that each document is a component, and all groups have several
            mixed = label.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
            mixed = mixed.select(F.col("gid").alias("mg"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("ms"))  # a group's rows meet it in several tasks
            label = label.join(mixed, (F.col("gid") == F.col("mg")) & (F.pmod(F.xxhash64("rep"), F.lit(SALTS)) == F.col("ms")), "left_semi")
        rest = ws.save(label, f"mixed-{turn}", most_rows=n)
        if turn < ROUNDS:
            mix = F.xxhash64("gid", F.lit(turn))
            few = rest.withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy(mix))).where(F.col("nth") <= FIRST)
            blocks = few.select(F.xxhash64("gid", F.pmod(F.xxhash64("rep", mix), F.ceil(F.col("cnt") / BLOCK_ONE))).alias("g"), "rep", "comp")
        else:
            blocks = _blocks(rest, BLOCK_TWO)
        found = candidates(blocks.join(trees, F.col("rep") == F.col("r")), num, den, forest=turn < ROUNDS)
        if tried is not None:
            found = found.join(tried.select(F.col("a").alias("ta"), F.col("b").alias("tb")), (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
        pairs = ws.save(found, f"pairs-{turn}", most_rows=n if turn < ROUNDS else None)  # a forest has fewer pairs than its groups have rows
        ws.drop(f"mixed-{turn}")
        if pairs.isEmpty():
            if turn < ROUNDS:
                continue
            break
        new = ws.save(verify(pairs, docs, k, num, den), f"links-{turn}", most_rows=pairs.count())
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        if not new.isEmpty():
            comps = components(links, ws, f"comps-{turn}")
    ws.drop("groups", *(f"{x}-{turn}" for x in ("pairs", "links") for turn in range(ROUNDS + 1)))

    classes = reps.select(F.col("key").alias("k"), "rep").join(comps, F.col("rep") == F.col("v"), "left").select("k", F.coalesce("c", "rep").alias("component"))
    out = sig.select("doc_id", "n", "key").join(classes, F.col("key") == F.col("k"), "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark, table(spark, sf_dir, "documents"), Workspace(spark, "jaccard"))


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLE: dict[str, str] = {}
