"""Language-model scores by a hidden Markov model over words, beside a unigram base score.

Tokens are the words of a text (A-Z lower-cased) and one end. Training counts come from all training texts and are exact, so that scores
don't depend on how the texts lie. Words that occur often are symbols of their own (all words from some count on, the least count for which
they are at most ``HEAD``, a bounded table that every task holds); any other word is the symbol of its last two bytes
and, within that symbol, has its own add-half unigram share, unseen words together that of one word. So the model is a proper
distribution over words, and its likelihood of a text is exact: a scaled forward recursion over the symbols plus the shares.

``STATES`` hidden states are trained by Baum-Welch: in each round tasks run forward and backward over their texts (long ones cut into
runs of ``RUN`` tokens, all of them used), expected counts are added up across partitions by a shuffle, and the driver divides them.
Counts of rare words never reach the driver: words and the documents that hold them meet in a shuffle by word, in as many parts as keep a
part at about ``PART_TOKENS`` training tokens.

Null and empty texts are one end token. Rows that repeat count and are scored each; a null key is a training row. With no training
rows at all every count is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import _text
from tessel.llm._store import Workspace, table

HEAD, STATES, ROUNDS, RUN, SEED, STRENGTH, PART_TOKENS = 1 << 17, 6, 4, 512, 5, 200.0, 1 << 21
_SUFFIXES, _CHUNK, _TOKENS, _FAN = 1 << 16, 8192, 400_000, 256


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the number of the last two bytes of each word, and the words before each text."""
    data, off = _text.raw_bytes(texts)
    starts, ends, first = _text.word_spans(data, off)
    hashes = _text.word_hashes(data, starts, ends)
    if len(ends) == 0:
        return hashes, np.zeros(0, np.int64), first
    low = _text._LOWER[data].astype(np.int64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0)
    return hashes, before * 256 + low[ends - 1], first


def word_counts(train: DataFrame, most: int = 1 << 20) -> DataFrame:
    """w (a word's hash) and c, how often it stands in the texts: exact, with counts of ``most`` words at a time added up in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                w, n = np.unique(_text.words_of(batch.column(0).slice(i, 2048))[0], return_counts=True)
                both, at = np.unique(np.concatenate([held[0], w]), return_inverse=True)
                held = both, np.bincount(at, np.concatenate([held[1], n]), len(both)).astype(np.int64)
                if len(held[0]) > most:
                    yield pa.record_batch({"w": pa.array(held[0].view(np.int64)), "c": pa.array(held[1])})
                    held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.record_batch({"w": pa.array(held[0].view(np.int64)), "c": pa.array(held[1])})

    return train.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, int]:
    """Sorted hashes of all words that occur at least so often that at most ``most`` words do; and how many tokens the other words have."""
    by_count = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(most + 1).collect()
    total, least = 0, None
    for r in by_count:  # from the most frequent on, until the table is full
        if total + r["n"] > most:
            break
        total, least = total + r["n"], r["c"]
    if least is None:
        return np.zeros(0, np.uint64), int(counts.agg(F.sum("c")).first()[0] or 0)
    found = counts.where(F.col("c") >= least).select("w").toArrow().column("w").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64)), int(counts.where(F.col("c") < least).agg(F.sum("c")).first()[0] or 0)


def encode(docs: DataFrame, head: np.ndarray, parts: int) -> DataFrame:
    """Rows of documents (part null: rid, doc_id, train, symbols) and of blocks of rare words (part: of the word's hash)."""
    end = len(head)
    lookup = head if len(head) else np.zeros(1, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                cut = batch.slice(i, 2048)
                w, suffix, first = _tokens(cut.column(1))
                train = np.asarray(cut.column(2).to_pylist(), bool)
                at = np.minimum(np.searchsorted(lookup, w), len(lookup) - 1)
                rare = (lookup[at] != w) | (len(head) == 0)
                symbols = np.where(rare, end + 1 + suffix, at).astype("<u4")
                owner = np.repeat(np.arange(cut.num_rows), np.diff(first))
                whole = np.insert(symbols, first[1:], np.uint32(end)).astype("<u4")
                bounds = first + np.arange(len(first))
                n = cut.num_rows
                none = pa.nulls(n, pa.int64())
                yield pa.record_batch(
                    [none, pa.array(rid + np.arange(n)), cut.column(0), pa.array(train), pa.array([whole[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())],
                    names=["part", "rid", "doc_id", "train", "symbols"],
                )
                w, suffix, owner = w[rare], suffix[rare], owner[rare]
                part = (w % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                w, suffix, owner, part = w[order], suffix[order], owner[order], part[order]
                cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
                rows = []
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(part)).tolist()):
                    own = owner[a:b]
                    rows.append((int(part[a]), w[a:b].astype("<u8").tobytes() + (suffix[a:b]).astype("<u2").tobytes() + own.astype("<u2").tobytes() + train[own].tobytes()))
                if rows:
                    m = len(rows)
                    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([rid] * m, pa.int64()), pa.nulls(m, cut.column(0).type), pa.nulls(m, pa.bool_()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "rid", "doc_id", "train", "symbols"])
                rid += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "train").mapInArrow(run, f"part long, rid long, doc_id {kind}, train boolean, symbols binary")


def rare_words(blocks: DataFrame, parts: int) -> DataFrame:
    """kind 'doc': id is a rid, x the sum of log10(c + 0.5) over its rare words, y how many are known. kind 'suffix': id is a suffix, x
    the sum of c + 0.5 over its known words, y its tokens. kind 'words': y the known rare words.

    Words of a part meet in one task, which sends its sums for each document on in blocks; blocks of a part of the documents meet in another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, suffix, rid, train = [], [], [], []
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_buffer()
                n = data.size // 13
                w.append(np.frombuffer(data, "<u8", n))
                suffix.append(np.frombuffer(data, "<u2", n, 8 * n))
                rid.append(base + np.frombuffer(data, "<u2", n, 10 * n).astype(np.int64))
                train.append(np.frombuffer(data, np.uint8, n, 12 * n))
        if not w:
            return
        distinct, start, at = np.unique(np.concatenate(w), return_index=True, return_inverse=True)
        suffix, rid, train = np.concatenate(suffix).astype(np.int64), np.concatenate(rid), np.concatenate(train)
        c = np.bincount(at, train, len(distinct))
        docs, own = np.unique(rid, return_inverse=True)
        known, of = c > 0, suffix[start]
        to = (_text.mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        yield _blocks("doc", to, docs, np.bincount(own, np.log10(c + 0.5)[at], len(docs)), np.bincount(own, known[at], len(docs)))
        share, tokens = np.bincount(of[known], c[known] + 0.5, _SUFFIXES), np.bincount(of[known], c[known], _SUFFIXES)
        some = np.flatnonzero(tokens)
        yield _blocks("suffix", some % parts, some, share[some], tokens[some])
        yield _blocks("words", np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1), np.array([known.sum()]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for kind, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = data.as_buffer().size // 24
                held.setdefault(kind, []).append((np.frombuffer(data.as_buffer(), "<i8", n), np.frombuffer(data.as_buffer(), "<f8", n, 8 * n), np.frombuffer(data.as_buffer(), "<f8", n, 16 * n)))
        for kind, got in held.items():
            ids, x, y = (np.concatenate(p) for p in zip(*got))
            distinct, at = np.unique(ids, return_inverse=True)
            yield pa.record_batch({"kind": pa.array([kind] * len(distinct), pa.string()), "id": pa.array(distinct), "x": pa.array(np.bincount(at, x, len(distinct))), "y": pa.array(np.bincount(at, y, len(distinct)))})

    rows = blocks.select("part", "rid", F.col("symbols").alias("b")).repartitionById(parts, F.col("part").cast("int")).select("rid", "b")
    sums = rows.mapInArrow(run, "to long, kind string, b binary").repartitionById(parts, F.col("to").cast("int")).select("kind", "b")
    return sums.mapInArrow(add, "kind string, id long, x double, y double")


def _blocks(kind: str, to: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """One row for each part of the ids: the ids and both numbers of each."""
    order = np.argsort(to, kind="stable")
    to, ids, x, y = to[order], ids[order], x[order], y[order]
    cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
    rows = [ids[a:b].astype("<i8").tobytes() + x[a:b].astype("<f8").tobytes() + y[a:b].astype("<f8").tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(to)).tolist())]
    return pa.record_batch({"to": pa.array(to[cut]), "kind": pa.array([kind] * len(cut), pa.string()), "b": pa.array(rows, pa.binary())})


class Model:
    """start, moves and emit[state, symbol]; every row sums to one."""

    def __init__(self, start: np.ndarray, moves: np.ndarray, emit: np.ndarray):
        self.start, self.moves, self.emit = start, moves, emit
        self.by_symbol = np.ascontiguousarray(emit.T)

    @staticmethod
    def first(unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """Unigram shares, each state with its own random leaning, and states that tend to stay."""
        lean = np.exp(np.random.default_rng(seed).normal(0, 1, (states, len(unigram))))
        emit = unigram * lean
        moves = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(moves, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), moves, emit / emit.sum(axis=1, keepdims=True))


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Sequences of like length, at most _TOKENS tokens together (or a single longer one); longest first within each."""
    order = np.argsort(-sizes, kind="stable")
    begin = 0
    while begin < len(order):
        upto = np.cumsum(sizes[order[begin:]])
        end = begin + max(1, int(np.searchsorted(upto, _TOKENS, side="right")))
        yield order[begin:end]
        begin = end


def forward(model: Model, symbols: np.ndarray, at: np.ndarray, sizes: np.ndarray, keep: bool) -> tuple:
    """Natural logarithms of the sequences' likelihoods, longest sequence first; keep: scaled forward values and scales too."""
    seen = model.by_symbol[symbols]
    out, scale = (np.empty_like(seen), np.empty(len(symbols))) if keep else (None, None)
    log = np.zeros(len(at))
    live = len(at) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))
    a = np.broadcast_to(model.start, (len(at), len(model.start)))
    for t, m in enumerate(live.tolist()):
        p = at[:m] + t
        a = (a[:m] @ model.moves if t else a) * seen[p]
        c = a.sum(axis=1)
        a = a / c[:, None]
        log[:m] += np.log(c)
        if keep:
            out[p], scale[p] = a, c
    return log, seen, out, scale, live


def expected_counts(model: Model, symbols: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    log, seen, alpha, scale, live = forward(model, symbols, at, sizes, True)
    k = len(model.start)
    beta = np.ones((len(symbols), k))
    weight = seen / scale[:, None]
    for t in range(len(live) - 2, -1, -1):
        p = at[: live[t + 1]] + t
        beta[p] = (weight[p + 1] * beta[p + 1]) @ model.moves.T
    gamma = alpha * beta
    gamma /= gamma.sum(axis=1, keepdims=True)
    inner = np.ones(len(symbols), bool)
    inner[at + sizes - 1] = False
    prev = np.flatnonzero(inner)
    moves = (alpha[prev].T @ (weight[prev + 1] * beta[prev + 1])) * model.moves
    emit = np.stack([np.bincount(symbols, gamma[:, j], model.emit.shape[1]) for j in range(k)])
    return gamma[at].sum(axis=0), moves, emit


def _sequences(batch: pa.RecordBatch, column: int, run: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    parts = [np.frombuffer(b.as_buffer(), "<u4") for b in batch.column(column)]
    if run:
        parts = [p[i : i + run] for p in parts for i in range(0, len(p), run)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return parts, sizes


def baum_welch(train: DataFrame, model: Model, unigram: np.ndarray, strength: float = STRENGTH) -> Model:
    """One round. Each task sends its expected counts in chunks; chunks are added up by number, in two steps."""
    k, width = model.emit.shape
    spread = train.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*spread.value)
        first, moves, emit, seen = np.zeros(k), np.zeros((k, k)), np.zeros((k, width)), False
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                parts, sizes = _sequences(batch.slice(i, 2048), 0, RUN)
                for own in _batches(sizes):
                    got = [parts[j] for j in own]
                    n = sizes[own]
                    a, b, c = expected_counts(m, np.concatenate(got).astype(np.int64), np.cumsum(n) - n, n)
                    first += a
                    moves += b
                    emit += c
                    seen = True
        if seen:
            flat = np.concatenate([first, moves.reshape(-1), emit.reshape(-1)])
            chunks = [flat[i : i + _CHUNK] for i in range(0, len(flat), _CHUNK)]
            yield pa.record_batch({"chunk": pa.array(range(len(chunks)), pa.int64()), "salt": pa.array([TaskContext.get().partitionId() // _FAN] * len(chunks), pa.int64()), "v": pa.array([c.astype("<f8").tobytes() for c in chunks], pa.binary())})

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_buffer(), "<f8").astype(np.float64) for b in rows.column("v"))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "salt": pa.array([0], pa.int64()), "v": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    schema = "chunk long, salt long, v binary"
    parts = train.select("symbols").mapInArrow(run, schema).groupBy("chunk", "salt").applyInArrow(add, schema)
    rows = parts.groupBy("chunk").applyInArrow(add, schema).collect()
    spread.unpersist()
    if not rows:
        return model
    flat = np.concatenate([np.frombuffer(bytes(r["v"]), "<f8") for r in sorted(rows, key=lambda r: r["chunk"])]).astype(np.float64)
    first, moves, emit = flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k :].reshape(k, width)
    emit = emit + strength * unigram
    moves = moves + 0.5
    return Model((first + 0.5) / (first + 0.5).sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def score(spark: SparkSession, docs: DataFrame, ws: Workspace, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text, train. doc_id, train, n_tokens, n_known, train_tokens, base_score and score of each row."""
    head, rare_tokens = frequent_words(ws.save(word_counts(docs.where("train")), "words"))
    ws.drop("words")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rare_tokens // PART_TOKENS))
    coded = ws.save(encode(docs, head, parts), "encoded")
    rows, blocks = coded.where(F.col("part").isNull()).drop("part"), coded.where(F.col("part").isNotNull())
    rare = ws.save(rare_words(blocks, parts), "rare")
    end, width = len(head), len(head) + 1 + _SUFFIXES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width, np.int64)
        for batch in batches:
            parts = [np.frombuffer(b.as_buffer(), "<u4") for b in batch.column(0)]
            for i in range(0, len(parts), 1024):
                n[: end + 2] += np.bincount(np.minimum(np.concatenate(parts[i : i + 1024]), end + 1), minlength=end + 2)
        some = np.flatnonzero(n[: end + 1])
        yield pa.record_batch({"s": pa.array(some), "n": pa.array(n[some])})

    c = np.zeros(width)
    for r in rows.where("train").select("symbols").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).collect():
        c[r["s"]] = r["n"]
    share = np.full(_SUFFIXES, 0.5)
    for r in rare.where("kind = 'suffix'").collect():
        c[end + 1 + r["id"]], share[r["id"]] = r["y"], share[r["id"]] + r["x"]
    known_rare = rare.where("kind = 'words'").agg(F.sum("y")).first()[0] or 0
    total = c.sum()
    kinds = int((c[: end + 1] > 0).sum() + known_rare)
    floor = total + 0.5 * (kinds + 1)
    unigram = (c + 0.5) / (c + 0.5).sum()
    model = Model.first(unigram, states)
    train = rows.where("train")
    for _ in range(rounds if total else 0):
        model = baum_welch(train, model, unigram)
    log_c, log_share = np.log10(c + 0.5), np.log10(share)
    spread = spark.sparkContext.broadcast((model.start, model.moves, model.emit, log_c, log_share, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *m, log_c, log_share, c = spread.value
        m = Model(*m)
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                texts, sizes = _sequences(part, 3, None)
                logs, base, held, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                for own in _batches(sizes):
                    n = sizes[own]
                    s = np.concatenate([texts[j] for j in own]).astype(np.int64)
                    at = np.cumsum(n) - n
                    logs[own] = forward(m, s, at, n, False)[0] / np.log(10)
                    usual = s <= end
                    base[own] = np.add.reduceat(np.where(usual, log_c[s], 0.0), at)
                    held[own] = np.add.reduceat(np.where(usual, 0.0, -log_share[np.maximum(s - end - 1, 0)]), at)
                    known[own] = np.add.reduceat((usual & (c[s] > 0)).astype(np.int64), at)
                yield pa.record_batch(
                    [*part.columns[:3], pa.array(sizes), pa.array(logs + held), pa.array(base), pa.array(known)], names=["rid", "doc_id", "train", "n_tokens", "s", "b", "k"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.select("rid", "doc_id", "train", "symbols").mapInArrow(run, f"rid long, doc_id {kind}, train boolean, n_tokens long, s double, b double, k long")
    extra = rare.where("kind = 'doc'").select(F.col("id"), "x", "y")
    out = scored.join(extra, F.col("rid") == F.col("id"), "left").withColumns({"x": F.coalesce("x", F.lit(0.0)), "y": F.coalesce("y", F.lit(0.0))})
    base = F.col("b") + F.col("x") - F.col("n_tokens") * float(np.log10(floor))
    return out.select("doc_id", "train", "n_tokens", (F.col("k") + F.col("y")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("s") + F.col("x")).alias("score"))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    out = score(spark, docs, Workspace(spark, "hmm"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_hmm_scores": op8_hmm_scores}
ORACLE: dict[str, str] = {}
