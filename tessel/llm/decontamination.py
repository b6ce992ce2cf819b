"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents; words in more than ``STOP_SHARE`` of them weigh nothing, but for the
   rarest of a benchmark item that has fewer than ``LEAST_OWN`` others.
2. Benchmark items of more than ``WHOLE`` words are cut into overlapping passages of ``PASSAGE`` words; shorter ones are a passage each.
3. Passages (``PASSAGE`` words, every ``PASSAGE`` words) of all documents are TF-IDF rows over the benchmark's words, scaled by the
   length of the whole passage vector. Their leading directions come from a distributed randomised SVD in one pass: tasks add up
   the Gram matrix times a random matrix, the driver finishes it (Nystroem's method). A truncated SVD of what the benchmark passages have beside
   these directions gives ``RANK_SHARE`` times as many more as there are passages, and a passage of which less than ``KEPT`` lies in all of them
   gets one of its own: leading directions alone would lose a passage that leaked once.
4. Overlapping windows of all documents are folded into this space and compared with the benchmark passages there. The products are
   divided by the share of the passage that the space keeps, so that they are estimates of the cosine of the full vectors and exact for a
   copy. Words that no benchmark passage has weigh ``OUTSIDE`` in a window's squared length, as a leak often stands among rarer words. Windows
   that by their benchmark words can't reach the least cosine are left out first, by a bound that is never too low.
5. Beside longer surroundings a short item's cosine falls as the corpus, and with it the weight of rare words, grows. So items of at most
   ``SHORT`` words have, besides, windows of about their own length that begin at each of their words, and a direction each (their own row): a
   window is a candidate if it holds ``CONTAIN`` of the item's weight, whatever stands around.
6. Around each candidate the longest common subsequence of words is computed, with the whole item. A text is a leak if it has ``SURE`` of
   the benchmark item in order, or ``LIKELY`` of it and ``ANSWER`` of the words of its last sentence.

Benchmark items are taken in blocks of about ``ITEMS`` passages with a space each, and ``GROUP`` blocks share the two passes over the documents. Empty
and null texts of either table match nothing. An item of one or two words only matches texts that hold it whole. Item ids are whole numbers; text ids are an error. Rows that repeat are compared
each, and each (document, item) is returned once; ``cosine`` is the largest cosine, or share of a short item's weight, of its windows. An empty table of either kind gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import _text
from tessel.llm._store import Workspace, table

BUCKETS, STOP_SHARE, LEAST_OWN, PASSAGE, STRIDE = 1 << 18, 0.03, 8, 32, 16
RANK, RANK_SHARE, KEPT, ITEMS, GROUP, SEED, COSINE, OUTSIDE = 32, 0.5, 0.4, 256, 12, 3, 0.4, 0.25
SURE, LIKELY, ANSWER = 0.7, 0.6, 0.6
WHOLE = 2 * PASSAGE
SHORT, CONTAIN = 24, 0.45
LENGTHS = (2, 3, 4, 6, 8, 12, 16, SHORT)  # windows for short items: 1.25 times the next of these
MARKS = ".,;:!?\"'()[]"
_CHUNK, _FAN, _SLICE = 8192, 256, 256


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words, which marks part as white space does, and the words before each text."""
    data, off = _text.raw_bytes(pc.utf8_lower(texts))
    starts, ends, first = _text.word_spans(data, off, MARKS)
    return _text.word_hashes(data, starts, ends, marks=MARKS), first


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _sum_chunks(parts: DataFrame) -> np.ndarray:
    """parts: chunk, salt, v (doubles as bytes), one set for each task. Their sum, added up in two shuffles by chunk."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), "<f4").astype(np.float64) for b in rows.column("v"))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "salt": pa.array([0], pa.int64()), "v": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema = "chunk long, salt long, v binary"
    rows = parts.groupBy("chunk", "salt").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema).collect()
    return np.concatenate([np.frombuffer(bytes(r["v"]), "<f4") for r in sorted(rows, key=lambda r: r["chunk"])]) if rows else np.zeros(0, np.float32)


def _chunks(flat: np.ndarray) -> pa.RecordBatch:
    rows = [flat[i : i + _CHUNK].astype("<f4").tobytes() for i in range(0, len(flat), _CHUNK)]
    return pa.record_batch({"chunk": pa.array(range(len(rows)), pa.int64()), "salt": pa.array([TaskContext.get().partitionId() // _FAN] * len(rows), pa.int64()), "v": pa.array(rows, pa.binary())})


def inverse_frequencies(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each of BUCKETS word buckets, and which of them are too common."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS + 1)
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                part = batch.column(0).slice(i, _SLICE)
                w, first = words_of(part)
                place = _bucket(w).astype(np.int32)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = np.sort(place[a:b])
                    n[own[np.append(True, own[1:] != own[:-1])] if b > a else own] += 1
                n[-1] += len(part)
        yield _chunks(n)

    n = _sum_chunks(docs.select("text").mapInArrow(count, "chunk long, salt long, v binary"))
    if not len(n):
        return np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, bool)
    df, total = n[:-1], max(float(n[-1]), 1.0)
    return np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1e-3), df > max(STOP_SHARE * total, 3)


def _windows(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, begin and end of the passages of all texts; the last one of a text may be short."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - PASSAGE) // stride) + 1), 0)
    owner = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * stride
    return owner, begin, np.minimum(begin + PASSAGE, first[1:][owner])


class Block:
    """A block of benchmark passages: words, weighted vectors and the latent space."""

    def __init__(self, items: list[tuple[int, str]], inverse: np.ndarray, common: np.ndarray):
        hashes, first = words_of(pa.array([t for _, t in items], pa.string()))
        self.ids = [i for i, _ in items]
        self.words = [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        silent = common.copy()
        for w in self.words:
            own = np.unique(_bucket(w))
            if (~common[own]).sum() < LEAST_OWN:
                silent[own[np.argsort(-inverse[own], kind="stable")][:LEAST_OWN]] = False
        self.weight = weight = np.where(silent, 0, inverse).astype(np.float32)
        self.answers = [words_of(pa.array([_last_sentence(t)]))[0] for _, t in items]
        self.vocabulary = np.unique(hashes[weight[_bucket(hashes)] > 0])
        parts = [(i, a) for i, w in enumerate(self.words) for a in _starts(len(w))]
        self.owner, self.begin = [i for i, _ in parts], [a for _, a in parts]
        rows = np.zeros((len(parts), len(self.vocabulary)), np.float32)
        for r, (i, a) in zip(rows, parts):
            w = self.words[i] if len(self.words[i]) <= WHOLE else self.words[i][a : a + PASSAGE]
            w = w[weight[_bucket(w)] > 0]
            np.add.at(r, np.searchsorted(self.vocabulary, w), weight[_bucket(w)])
        self.rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
        self._set_short()

    def _set_short(self) -> None:
        """Words of the items of at most SHORT words; by length their items and, for each word, its share of the weight of each of them."""
        sizes = np.array([len(w) for w in self.words])
        few = [i for i in np.flatnonzero((sizes > 0) & (sizes <= SHORT)).tolist() if self.weight[_bucket(self.words[i])].any()]
        self.short_words = np.unique(np.concatenate([self.words[i] for i in few])) if few else np.zeros(0, np.uint64)
        self.short_words = self.short_words[self.weight[_bucket(self.short_words)] > 0]
        self.short = []
        for low, length in zip((0, *LENGTHS), LENGTHS):
            group = [i for i in few if low < sizes[i] <= length]
            if not group:
                continue
            share = np.zeros((len(self.short_words), len(group)), np.float32)
            for column, i in enumerate(group):
                own, times = np.unique(self.words[i][self.weight[_bucket(self.words[i])] > 0], return_counts=True)
                value = times * self.weight[_bucket(own)]
                share[np.searchsorted(self.short_words, own), column] = value / (times * value).sum()
            self.short.append((math.ceil(1.25 * length), group, share))

    def find(self, w: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
        """Numbers of words in the vocabulary (or in other sorted words), its size for all others."""
        words = self.vocabulary if words is None else words
        if not len(words):
            return np.zeros(len(w), np.int64)
        at = np.minimum(np.searchsorted(words, w), len(words) - 1)
        return np.where(words[at] == w, at, len(words))

    def finish(self, y: np.ndarray, omega: np.ndarray) -> None:
        """From the Gram matrix times omega: leading directions, and those that the passages add. Sets space, queries and least."""
        directions = np.zeros((len(self.vocabulary), 0))
        size = np.linalg.norm(y)
        if size > 0:
            nu = 1e-6 * size
            shifted = y + nu * omega
            middle = omega.T @ shifted
            lower = np.linalg.cholesky((middle + middle.T) / 2 + 1e-9 * size * np.eye(len(middle)))
            u, s, _ = np.linalg.svd(np.linalg.solve(lower, shifted.T).T, full_matrices=False)
            strength = np.maximum(s**2 - nu, 0)
            directions = u[:, strength > 1e-6 * strength.max()]
        rest = self.rows.T - directions @ (directions.T @ self.rows.T)
        u, s, _ = np.linalg.svd(rest, full_matrices=False)
        rank = min(max(RANK, math.ceil(RANK_SHARE * len(self.rows))), int((s > 1e-5).sum()))
        own = u[:, :rank]
        held = ((self.rows @ directions) ** 2).sum(axis=1) + ((self.rows @ own) ** 2).sum(axis=1)
        lost = rest[:, held < KEPT]
        lost = lost - own @ (own.T @ lost)
        extra, r = np.linalg.qr(lost)
        extra = extra[:, np.abs(np.diag(r)) > 1e-5] if extra.size else extra
        space = np.concatenate([directions, own, extra], axis=1).astype(np.float32)
        self.space = np.where(np.abs(space) < 1e-6, np.float32(0), space)  # products of tiny numbers would be slow
        queries = self.rows @ self.space
        share = (queries**2).sum(axis=1)
        self.queries = np.where(share[:, None] > 1e-6, queries / np.maximum(share, 1e-6)[:, None], 0).astype(np.float32)
        self.least = float(share[share > 1e-6].min()) if (share > 1e-6).any() else 1.0
        self.rows = None


def _starts(n: int) -> list[int]:
    """Where the passages of an item of n words begin; the last one ends with the item."""
    return [0] if n <= WHOLE else [*range(0, n - PASSAGE, STRIDE), n - PASSAGE]


def _last_sentence(text: str) -> str:
    parts = [p for p in text.replace("?", ".").replace("!", ".").split(".") if p.strip()]
    return parts[-1] if parts else ""


def _known(blocks: list[Block]) -> np.ndarray:
    """The buckets that hold words of the blocks' vocabularies."""
    out = np.zeros(BUCKETS, bool)
    for block in blocks:
        out[_bucket(block.vocabulary)] = True
    return out


def leading_directions(docs: DataFrame, blocks: list[Block]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block the Gram matrix of all passages times a random orthonormal matrix, and that matrix."""
    omegas = [np.linalg.qr(np.random.default_rng(SEED).normal(size=(len(b.vocabulary), min(RANK, len(b.vocabulary)))))[0] for b in blocks]
    held = docs.sparkSession.sparkContext.broadcast(([b.weight for b in blocks], [b.vocabulary for b in blocks], [o.astype(np.float32) for o in omegas]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, vocabularies, omegas = held.value
        some = np.zeros(BUCKETS, bool)
        for v in vocabularies:
            some[_bucket(v)] = True
        padded = [np.vstack([o, np.zeros((1, o.shape[1]), np.float32)]) for o in omegas]
        sums = [np.zeros((len(o), o.shape[1])) for o in padded]
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                w, first = words_of(batch.column(0).slice(i, _SLICE))
                owner, begin, end = _windows(first, PASSAGE)
                place = _bucket(w)
                near = np.flatnonzero(some[place])
                for weight, v, table_, y in zip(weights, vocabularies, padded, sums):
                    if not len(v) or not len(near):
                        continue
                    at = np.minimum(np.searchsorted(v, w[near]), len(v) - 1)
                    ok = v[at] == w[near]
                    at, own = at[ok], near[ok]
                    if not len(own):
                        continue
                    upto = np.concatenate([[0], np.cumsum(weight[place].astype(np.float64) ** 2)])
                    size = np.sqrt(np.maximum(upto[end] - upto[begin], 1e-12))
                    passage = np.searchsorted(begin, own, side="right") - 1
                    value = (weight[place[own]] / size[passage]).astype(np.float32)
                    cut = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                    u = np.add.reduceat(table_[at] * value[:, None], cut, axis=0)
                    back = np.cumsum(np.append(True, passage[1:] != passage[:-1])) - 1
                    order = np.argsort(at, kind="stable")
                    ranked = at[order]
                    begin_of = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
                    y[ranked[begin_of]] += np.add.reduceat(u[back[order]] * value[order, None], begin_of, axis=0)
        yield _chunks(np.concatenate([y[:-1].reshape(-1) for y in sums]))

    flat = _sum_chunks(docs.select("text").mapInArrow(run, "chunk long, salt long, v binary")).astype(np.float64)
    held.unpersist()
    out = []
    for o in omegas:
        out.append((flat[: o.size].reshape(o.shape) if len(flat) else np.zeros(o.shape), o))
        flat = flat[o.size :]
    return out


def common_subsequence(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, a word of the text a step, the item's words as the bits of a number."""
    place: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        place[w] = place.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        hit = row & place.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def _best_part(item: np.ndarray, words: np.ndarray, at: int, reach: int = PASSAGE) -> tuple[float, int, int]:
    """The largest share of the item in order within a stretch of 1.25 times its length, near a place; and the stretch."""
    n = len(item)
    size, step = math.ceil(1.25 * n), max(1, n // 8)
    best = (0.0, 0, 0)
    places = range(max(0, at - size), min(len(words), at + reach), step)
    for a in places if n <= WHOLE else (*places, min(at, len(words))):
        share = common_subsequence(item, words[a : a + size]) / n
        if share > best[0]:
            best = (share, a, min(a + size, len(words)))
    return best


def _candidates(block: Block, w: np.ndarray, place: np.ndarray, near: np.ndarray, begin: np.ndarray, end: np.ndarray, cosine: float) -> Iterator[tuple[int, int, float]]:
    """Windows, passages and estimated cosines of at least ``cosine``. place: the words' buckets; near: where words that may be the block's stand."""
    at = block.find(w[near])
    ok = at < len(block.vocabulary)
    at, own = at[ok], near[ok]
    if not len(own):
        return
    x = block.weight[place].astype(np.float64)
    all_, value = np.concatenate([[0], np.cumsum(x**2)]), x[own]
    a, b = np.searchsorted(own, begin), np.searchsorted(own, end)
    upto = np.concatenate([[0], np.cumsum(value**2)])
    key = at * (len(w) + 2 * PASSAGE) + own  # how often a word may stand in one window: its places less than a window away
    order = np.argsort(key, kind="stable")
    often = np.empty(len(own), np.int64)
    often[order] = np.searchsorted(key[order], key[order] + PASSAGE, side="left") - np.searchsorted(key[order], key[order] - PASSAGE, side="right")
    most = np.concatenate([[0], np.cumsum(often * value**2)])
    inside = upto[b] - upto[a]
    size = OUTSIDE * (all_[end] - all_[begin]) + (1 - OUTSIDE) * inside
    keep = np.flatnonzero((b > a) & (most[b] - most[a] >= 0.999 * cosine**2 * block.least * size))
    for i in range(0, len(keep), 1024):
        k = keep[i : i + 1024]
        n = b[k] - a[k]
        cut = np.cumsum(n) - n
        p = np.arange(n.sum()) + np.repeat(a[k] - cut, n)
        z = np.add.reduceat(block.space[at[p]] * value[p].astype(np.float32)[:, None], cut, axis=0)
        score = (z @ block.queries.T) / np.sqrt(size[k])[:, None]
        for r, q in zip(*(y.tolist() for y in np.nonzero(score >= cosine))):
            yield int(k[r]), q, min(float(score[r, q]), 1.0)


def _short_candidates(block: Block, w: np.ndarray, near: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """Places, short items and the share (at least CONTAIN) of an item's weight in the window that begins there."""
    at = block.find(w[near], block.short_words)
    ok = at < len(block.short_words)
    at, own = at[ok], near[ok]
    if not len(own):
        return
    ends = first[np.searchsorted(first, own, side="right")]
    for length, group, share in block.short:
        most = share.max(axis=1)
        begin = np.flatnonzero(most[at] > 0)
        end = np.searchsorted(own, np.minimum(own[begin] + length, ends[begin]))
        upto = np.concatenate([[0], np.cumsum(most[at], dtype=np.float64)])
        keep = upto[end] - upto[begin] >= 0.999 * CONTAIN  # no item has more of its weight there
        begin, end = begin[keep], end[keep]
        for i in range(0, len(begin), 1024):
            a, n = begin[i : i + 1024], end[i : i + 1024] - begin[i : i + 1024]
            cut = np.cumsum(n) - n
            p = np.arange(n.sum()) + np.repeat(a - cut, n)
            score = np.add.reduceat(share[at[p]], cut, axis=0)
            for r, q in zip(*(y.tolist() for y in np.nonzero(score >= CONTAIN))):
                yield int(own[a[r]]), group[q], min(float(score[r, q]), 1.0)


def search(docs: DataFrame, blocks: list[Block], cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of each leak."""
    held = docs.sparkSession.sparkContext.broadcast(blocks)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def test(block: Block, found: Iterator[tuple]) -> dict[tuple, tuple]:
        """found: row, item, cosine, place, the text's words and how far behind the place to look. The best of each (row, item) that is a leak."""
        rows: dict[tuple, tuple] = {}
        tried = set()
        for d, q, score, place, words, reach in found:
            item = block.words[q]
            if not len(item) or rows.get((d, q), (0, 0.0))[1] >= 1.0 or (reach, d, q, place) in tried:
                continue
            tried.add((reach, d, q, place))
            share, a, b = _best_part(item, words, place, reach)
            answer = float(np.isin(block.answers[q], words[a:b]).mean()) if len(block.answers[q]) else 1.0
            if (share >= SURE or (share >= LIKELY and answer >= ANSWER)) and share > rows.get((d, q), (0, 0.0))[1]:
                rows[d, q] = (score, share, answer)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = held.value
        some = _known(blocks)
        for batch in batches:
            for i in range(0, batch.num_rows, _SLICE):
                part = batch.slice(i, _SLICE)
                w, first = words_of(part.column(1))
                owner, begin, end = _windows(first, STRIDE)
                place = _bucket(w)
                near = np.flatnonzero(some[place])
                for block in blocks:

                    def hits():
                        for k, p, score in _candidates(block, w, place, near, begin, end, cosine):
                            d, q = int(owner[k]), block.owner[p]
                            at, n = int(begin[k] - first[d]), len(block.words[q])
                            if n > WHOLE:  # where the item would begin; hits of other passages that say about the same are tried once
                                grid = max(1, n // 8)
                                at = max(0, round((at - block.begin[p]) / grid) * grid)
                            yield d, q, score, at, w[first[d] : first[d + 1]], PASSAGE
                        for p, q, score in _short_candidates(block, w, near, first):
                            d, n = int(np.searchsorted(first, p, side="right") - 1), len(block.words[q])
                            grid = max(1, n // 2)  # hits of neighbouring words are tried once
                            yield d, q, score, (p - int(first[d])) // grid * grid, w[first[d] : first[d + 1]], n

                    rows = test(block, hits())
                    if rows:
                        ids = part.column(0).take(pa.array([d for d, _ in rows], pa.int64()))
                        cols = [pa.array([block.ids[q] for _, q in rows], pa.int64()), *(pa.array([v[j] for v in rows.values()], pa.float64()) for j in range(3))]
                        yield pa.record_batch([ids, *cols], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    hits = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, item_id long, cosine double, lcs_share double, answer_share double")
    return hits.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")))


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, ws: Workspace, items: int = ITEMS, group: int = GROUP) -> DataFrame:
    """One row for each document and benchmark item that it leaks."""
    known = benchmark.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("item_id", "text").distinct()
    size = F.size(F.split("text", r"[\x20\x09-\x0D]+"))  # about: marks part words too
    passages = F.when(size > WHOLE, F.ceil(size / STRIDE)).otherwise(1)
    n = max(1, math.ceil((known.agg(F.sum(passages)).first()[0] or 0) / (items * 0.8)))
    inverse, common = inverse_frequencies(docs)

    def block_of(k: int) -> list[tuple[int, str]]:
        return [(r["item_id"], r["text"]) for r in known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]

    out = None
    for g in range(0, n, group):
        blocks = [Block(block_of(k), inverse, common) for k in range(g, min(g + group, n))]
        for block, found in zip(blocks, leading_directions(docs, blocks)):
            block.finish(*found)
        found = ws.save(search(docs, blocks), f"leaks-{g}")
        out = found if out is None else out.unionByName(found)
    return out


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "leaks"))
    return out.withColumns({c: F.round(c, 4) for c in ("cosine", "lcs_share", "answer_share")})


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLE: dict[str, str] = {}
