"""Joins of vectors with vectors by tiles.

Both sides are packed into tiles, rows of some 1 MB that hold up to 2048 vectors with their ids as an Arrow stream. Left tiles in groups and
right tiles in strips meet in cells by one shuffle; a task holds the left tiles of a cell and reads its right tiles one by one, so that memory
doesn't grow with either side. No vector goes through the driver, except for the pivots of ``pairs`` (a documented number of them).

Ids can be of any type that Arrow sorts (numbers, texts, dates, times), in Spark's order. Rows with a null id take no part. Repeated ids are rows of
their own. A score is the dot product in double, rounded half away from zero to ``digits``; it is null where a vector is null, holds a null, or
lengths differ. Equal scores are ordered by id; NaN comes first, null last, as in Spark. Empty sides give an empty result. Columns
other than those named are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.sources.shared import written

#: Of a tile: vectors and bytes at most. Left tiles of a cell (on average), and requests compared at once.
TILE_ROWS, TILE_BYTES, HELD, _AT_ONCE = 2048, 1 << 20, 8, 128
#: Orders of pairs without a score, and of those that are left out.
_NONE, _OUT = -np.finfo(np.float64).max, -np.inf
_TILE = "tile long, cluster int, n int, radius double, norm double, payload binary"


def dense(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows filled up with zeros, and their lengths; -1 for null vectors, vectors with a null and those longer than width."""
    n = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    if (n == width).all() and not flat.null_count:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), width), n
    out = np.zeros((len(n), width))
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or len(v) > width or None in v:
            n[i] = -1
        else:
            out[i, : len(v)] = v
    return out, n


def width_of(vectors: pa.Array) -> int:
    return pc.max(pc.list_value_length(vectors)).as_py() or 0


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


@dataclass
class Tiles:
    """Packed tiles, and how many bytes they take."""

    frame: DataFrame
    size: int

    @property
    def blocks(self) -> int:
        return max(1, -(-self.size // (HELD * TILE_BYTES)))


def pack(rows: DataFrame, id: str, vector: str, pivots: np.ndarray | None = None, tile_rows: int = TILE_ROWS, cluster: str | None = None) -> Tiles:
    """Tiles of the rows, written. ``cluster``: a column of whole numbers that is alike in all rows of a tile. With pivots (a matrix) a tile holds vectors of one cluster (the nearest pivot's), with the largest distance to it and the
    largest norm; cluster -1 holds vectors longer than the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        sizes: dict[int, list[int]] = {}
        made = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)

        def tile(cluster: int) -> pa.RecordBatch:
            t = pa.Table.from_batches([b for b, _, _ in held[cluster]]).sort_by(id).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as w:
                w.write_table(t)
            radius, norm = (max((float(x.max(initial=0.0)) for x in y), default=0.0) for y in zip(*((r, m) for _, r, m in held[cluster])))
            held[cluster], sizes[cluster] = [], [0, 0]
            return pa.record_batch([pa.array([next(made)], pa.int64()), pa.array([cluster], pa.int32()), pa.array([t.num_rows], pa.int32()), pa.array([radius]), pa.array([norm]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["tile", "cluster", "n", "radius", "norm", "payload"])

        for batch in batches:
            per = max(1, min(tile_rows, int(TILE_BYTES * batch.num_rows / max(1, batch.nbytes))))
            for a in range(0, batch.num_rows, per):
                b = batch.slice(a, per)
                own, far, norm = _clusters(b.column(vector), pivots)
                if cluster:
                    own = b.column(cluster).to_numpy(zero_copy_only=False)
                for c in np.unique(own).tolist():
                    at = np.flatnonzero(own == c)
                    part = b if len(at) == b.num_rows else b.take(pa.array(at))
                    size = sizes.setdefault(c, [0, 0])
                    if size[0] and (size[0] + part.num_rows > tile_rows or size[1] + part.nbytes > TILE_BYTES):
                        yield tile(c)
                    held.setdefault(c, []).append((part, far[at], norm[at]))
                    sizes[c] = [sizes[c][0] + part.num_rows, sizes[c][1] + part.nbytes]
        for c in [c for c, h in held.items() if h]:
            yield tile(c)

    return Tiles(*written(rows.where(F.col(id).isNotNull()).mapInArrow(run, _TILE), "tiles", "none"))


def _clusters(vectors: pa.Array, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector its nearest pivot, the distance to it, and its norm."""
    if pivots is None:
        zero = np.zeros(len(vectors))
        return zero.astype(np.int64), zero, zero
    width = pivots.shape[1]
    v, n = dense(vectors, width)
    norm = np.linalg.norm(v, axis=1)
    square = norm[:, None] ** 2 - 2 * v @ pivots.T + (pivots**2).sum(axis=1)
    own = np.argmin(square, axis=1)
    far = np.linalg.norm(v - pivots[own], axis=1)
    longer = pc.fill_null(pc.greater(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
    own[longer | ~np.isfinite(norm)] = -1
    return own, np.where(np.isfinite(far), far, 0.0), np.where(np.isfinite(norm), norm, 0.0)


def _meet(sides: DataFrame, keys: list[str], cells: int, work: Callable, schema: str) -> DataFrame:
    """sides: the keys of a cell, side (0 left, 1 right), payload. ``work`` gets a cell's keys, its left tables and an iterator of its right tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                key = list(zip(*(b.column(k).to_pylist() for k in keys)))
                side, payload = b.column("side").to_pylist(), b.column("payload")
                for i in range(b.num_rows):
                    yield key[i], side[i], payload[i]

        def read(payload) -> pa.Table:
            return pa.ipc.open_stream(payload.as_buffer()).read_all()

        for key, cell in itertools.groupby(rows(), key=lambda r: r[0]):
            left = []
            for r in cell:
                if r[1]:
                    if left:
                        yield from work(key, left, (read(x[2]) for x in itertools.chain([r], cell)))
                    break
                left.append(read(r[2]))

    spark = sides.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # a task may have many cells, one after the other
    return sides.select(*keys, "side", "payload").repartition(max(1, min(cells, parts)), *keys).sortWithinPartitions(*keys, "side").mapInArrow(run, schema)


def compare(left: Tiles, right: Tiles, work: Callable, schema: str) -> DataFrame:
    """Left and right are packed tiles; every left tile meets every right tile. ``work(left tables, iterator of right tables)`` yields batches of the schema."""
    groups = left.blocks
    strips = min(-(-right.size // TILE_BYTES) or 1, -(-2 * left.frame.sparkSession.sparkContext.defaultParallelism // groups))
    mixed = F.xxhash64("tile")
    a = left.frame.select(F.pmod(mixed, F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("strip"), F.lit(0).alias("side"), "payload")
    b = right.frame.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.pmod(mixed, F.lit(strips)).alias("strip"), F.lit(1).alias("side"), "payload")
    return _meet(a.unionByName(b), ["group", "strip"], groups * strips, lambda _, x, y: work(x, y), schema)


def compare_within(left: Tiles, right: Tiles, work: Callable, schema: str) -> DataFrame:
    """As ``compare``, but tiles meet only those of the same cluster. Large clusters are dealt out in blocks of both sides."""
    blocks = lambda t: t.frame.groupBy("cluster").agg(F.ceil(F.sum(F.length("payload")) / (HELD * TILE_BYTES)).cast("long").alias("n"))
    known = blocks(left).withColumnRenamed("n", "groups").join(blocks(right).withColumnRenamed("n", "strips"), "cluster")  # a row for each cluster
    mixed, zero = F.xxhash64("tile"), F.lit(0).cast("long")
    a = left.frame.join(known, "cluster").select("cluster", F.pmod(mixed, F.col("groups")).alias("group"), F.explode(F.sequence(zero, F.col("strips") - 1)).alias("strip"), F.lit(0).alias("side"), "payload")
    b = right.frame.join(known, "cluster").select("cluster", F.explode(F.sequence(zero, F.col("groups") - 1)).alias("group"), F.pmod(mixed, F.col("strips")).alias("strip"), F.lit(1).alias("side"), "payload")
    return _meet(a.unionByName(b), ["cluster", "group", "strip"], left.blocks * right.blocks * 64, lambda _, x, y: work(x, y), schema)


def _first(order: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """In each row the places of the k largest, the smaller id first of equals."""
    return np.lexsort((np.broadcast_to(ids, order.shape), -order), axis=-1)[:, :k]


def _best(order: np.ndarray, k: int) -> np.ndarray:
    """In each row the places of the k largest, the first of equals; in no order."""
    n = order.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), order.shape)
    least = np.partition(order, n - k, axis=1)[:, n - k, None]
    out = np.empty((len(order), k), np.int64)
    for row, above, equal in zip(out, order > least, order == least):
        a = np.flatnonzero(above)
        row[: len(a)], row[len(a) :] = a, np.flatnonzero(equal)[: k - len(a)]
    return out


def rounded(z: np.ndarray, digits: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(z) * 10.0**digits + 0.5) / 10.0**digits, z) + 0.0


def ranks(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values, equal ones alike; nulls first."""
    return pc.rank(values, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def nearest(vectors: DataFrame, requests: DataFrame | None, k: int, digits: int = 6, own: bool = True, by_label: bool = False, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vectors: id, v, label. requests: request (of the ids' type), q; None for the vectors themselves. request, id, label, score and rank of each request's k best.

    Without ``own``, vectors with the request's id are left out. ``by_label``: the best vector of each label, and of these the k best. Every
    request is compared with every vector, tile by tile; a task keeps the k best of each of its requests, and these are merged by request. k below 1 is an error.
    """
    if k < 1:
        raise ValueError("k has to be 1 or more")
    whole = lambda t, c: t.withColumn(c, F.col(c).cast("long")) if isinstance(t.schema[c].dataType, T.IntegralType) else t
    vectors = whole(vectors, "id")
    kind, label = vectors.schema["id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    left = right = pack(vectors.select("id", "v", "label"), "id", "v", tile_rows=tile_rows)
    if requests is not None:
        requests = whole(requests, "request").select(F.col("request").alias("id"), F.col("q").alias("v"))
        if (found := requests.schema["id"].dataType.simpleString()) != kind:
            raise ValueError(f"requests are {found}, ids {kind}")
        left = pack(requests, "id", "v", tile_rows=tile_rows)
    schema = f"request {kind}, id {kind}, label {label}, score double"
    out = compare(left, right, _top(k, digits, own, by_label), schema)
    return _ranked(out, k, by_label)


def _ranked(out: DataFrame, k: int, by_label: bool = False) -> DataFrame:
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    if by_label:
        out = out.withColumn("n", F.row_number().over(Window.partitionBy("request", "label").orderBy(*order))).where("n = 1").drop("n")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(*order))).where(F.col("rank") <= k)


def _top(k: int, digits: int, own: bool, by_label: bool) -> Callable:
    def work(lefts: list[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        left = pa.concat_tables(lefts)
        asked, lists = column(left, "id"), column(left, "v")
        width = width_of(lists)
        q, q_n = dense(lists, width)
        order, at, pool = np.empty((len(q), 0)), np.empty((len(q), 0), np.int64), None  # of the best: score, row of the pool

        for t in rights:
            ids, labels = column(t, "id"), column(t, "label")
            v, v_n = dense(column(t, "v"), width)
            rank = ranks(ids) - 1
            place = pc.index_in(asked, ids.unique()).fill_null(-1).to_numpy() if not own else None  # tiles are sorted by id, so the n-th unique id has rank n
            codes = ranks(labels) if by_label else None
            cuts = [np.flatnonzero(codes == c) for c in np.unique(codes)] if by_label else []
            new = []
            for a in range(0, len(q), _AT_ONCE):
                with np.errstate(invalid="ignore", over="ignore"):
                    z = rounded(q[a : a + _AT_ONCE] @ v.T, digits)
                z[np.isnan(z)] = np.inf
                n = q_n[a : a + _AT_ONCE, None]
                z[(n != v_n) | (n < 0)] = _NONE
                if not own:
                    z[place[a : a + _AT_ONCE, None] == rank] = _OUT
                if by_label:
                    got = np.stack([c[np.argmax(z[:, c], axis=1)] for c in cuts], axis=1)
                    got = np.take_along_axis(got, _first(np.take_along_axis(z, got, axis=1), rank[got], k), axis=1)
                else:
                    got = _best(z, k)
                new.append((np.take_along_axis(z, got, axis=1), got))
            rows = pa.table({"id": ids, "label": labels})
            shift = 0 if pool is None else pool.num_rows
            pool = rows if pool is None else pa.concat_tables([pool, rows])
            order = np.concatenate([order, np.concatenate([x[0] for x in new])], axis=1)
            at = np.concatenate([at, np.concatenate([x[1] for x in new]) + shift], axis=1)
            by_id = ranks(column(pool, "id"))
            if by_label:  # the best of each label only
                label = ranks(column(pool, "label"))[at]
                to = np.lexsort((by_id[at], -order, label), axis=-1)
                order, at, label = (np.take_along_axis(x, to, axis=1) for x in (order, at, label))
                order[:, 1:][label[:, 1:] == label[:, :-1]] = _OUT
            to = _first(order, by_id[at], k)
            order, at = np.take_along_axis(order, to, axis=1), np.take_along_axis(at, to, axis=1)
            used, place_of = np.unique(at, return_inverse=True)
            at, pool = place_of.reshape(at.shape), pool.take(pa.array(used)).combine_chunks()

        kept = order > _OUT
        if not kept.any():
            return
        score = order[kept]
        nan = score == np.inf
        score[nan] = np.nan
        who = np.broadcast_to(np.arange(len(q))[:, None], kept.shape)[kept]
        found = pool.take(pa.array(at[kept]))
        yield pa.record_batch([asked.take(pa.array(who)), column(found, "id"), column(found, "label"), pa.array(score, mask=score == _NONE)], names=["request", "id", "label", "score"])

    return work


def pivots_of(vectors: DataFrame, vector: str, n: int) -> np.ndarray | None:
    """n vectors of the table, those with the smallest hashes: all that the driver sees of it. None for a table without whole vectors."""
    whole = vectors.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("v") > 0))
    got = [r["v"] for r in whole.orderBy(F.xxhash64("v")).limit(n).collect()]
    if not got:
        return None
    width = max(map(len, got))
    return np.unique(np.array([x + [0.0] * (width - len(x)) for x in got]), axis=0)


def pairs(vectors: DataFrame, least: float | None = None, most: float | None = None, digits: int = 9, n_pivots: int = 64, tile_rows: int = TILE_ROWS) -> DataFrame:
    """vectors: id, v. Each pair of different ids once, a the smaller: a, b, score. With ``least``, only pairs with least <= score < most, and
    pairs of clusters that can't reach it never meet.

    The bound: vectors are clustered by the nearest of ``n_pivots`` pivots. With distance d between two pivots, radii r and s and largest norms m and n,
    two vectors are at least d - r - s apart, so their product is at most (m*m + n*n - (d - r - s)**2) / 2, and at most m * n. Within a cell the same
    bound, with a tile's own centre, drops pairs of tiles. Without ``least`` every pair is a row, also those without a score.
    """
    pivots = None if least is None else pivots_of(vectors, "v", n_pivots)
    packed = pack(vectors.select("id", "v"), "id", "v", pivots, tile_rows)
    tiles, stats, blocks = packed.frame, [{"cluster": 0}], {0: packed.blocks}
    if pivots is not None:
        stats = tiles.groupBy("cluster").agg(F.sum(F.length("payload")).alias("size"), F.max("radius").alias("r"), F.max("norm").alias("m")).collect()  # a row for each pivot
        blocks = {s["cluster"]: -(-s["size"] // (HELD * TILE_BYTES)) for s in stats}

    def reach(s, t) -> bool:
        c, d = s["cluster"], t["cluster"]
        if pivots is None:
            return True
        if c < 0 or d < 0:
            return True
        apart = np.linalg.norm(pivots[c] - pivots[d]) - s["r"] - t["r"]
        return _can(s["m"], t["m"], apart, least, digits)

    grid = [(s["cluster"], t["cluster"], blocks[s["cluster"]], blocks[t["cluster"]]) for s in stats for t in stats if s["cluster"] <= t["cluster"] and reach(s, t)]
    spark = vectors.sparkSession
    known = spark.createDataFrame(grid, "c int, d int, n_c long, n_d long")
    mixed = F.xxhash64("tile")
    a = tiles.join(F.broadcast(known), tiles["cluster"] == known["c"]).select("c", "d", F.pmod(mixed, F.col("n_c")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_d") - 1)).alias("j"), F.lit(0).alias("side"), "payload")
    b = tiles.join(F.broadcast(known), tiles["cluster"] == known["d"]).select("c", "d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_c") - 1)).alias("i"), F.pmod(mixed, F.col("n_d")).alias("j"), F.lit(1).alias("side"), "payload")
    sides = a.unionByName(b).where("c < d OR i <= j")
    kind = vectors.schema["id"].dataType.simpleString()
    cells = sum(x[2] * x[3] for x in grid)
    return _meet(sides, ["c", "d", "i", "j"], cells, _scores(least, most, digits, pivots is not None), f"a {kind}, b {kind}, score double")


def _can(m: float, n: float, apart: float, least: float, digits: int) -> bool:
    """Can two vectors of these norms and at least so far apart have a product that rounds to ``least``?"""
    bound = min((m * m + n * n - max(0.0, apart) ** 2) / 2, m * n)
    return bound + 1e-9 * (1 + m * n) + 10.0**-digits >= least


def _scores(least: float | None, most: float | None, digits: int, prune: bool) -> Callable:
    def side(t: pa.Table, width: int | None = None):
        lists = column(t, "v")
        v, n = dense(lists, width_of(lists) if width is None else width)
        if not prune:
            return column(t, "id"), v, n, None
        centre = v.mean(axis=0)
        ball = centre, float(np.linalg.norm(v - centre, axis=1).max()), float(np.linalg.norm(v, axis=1).max())
        return column(t, "id"), v, n, ball if np.isfinite(ball[1]) else None

    def work(key: tuple, lefts: list[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        c, d, i, j = key
        one = c == d and i == j  # the block with itself: each pair would come twice
        held = [side(t) for t in lefts]
        for t in rights:
            by_width = {w: side(t, w) for w in {a.shape[1] for _, a, _, _ in held}}
            for a_ids, a, a_n, a_ball in held:
                b_ids, b, b_n, b_ball = by_width[a.shape[1]]
                if a_ball and b_ball and not _can(a_ball[2], b_ball[2], float(np.linalg.norm(a_ball[0] - b_ball[0])) - a_ball[1] - b_ball[1], least, digits):
                    continue
                order = ranks(pa.concat_arrays([a_ids, b_ids]))
                x, y = order[: len(a)], order[len(a) :]
                for s in range(0, len(a), _AT_ONCE):
                    with np.errstate(invalid="ignore", over="ignore"):
                        z = rounded(a[s : s + _AT_ONCE] @ b.T, digits)
                    none = (a_n[s : s + _AT_ONCE, None] != b_n) | (a_n[s : s + _AT_ONCE, None] < 0)
                    u = x[s : s + _AT_ONCE, None]
                    keep = u < y if one else u != y
                    if least is not None:
                        keep &= ~none & (z >= least) & (True if most is None else z < most)
                    p, r = np.nonzero(keep)
                    if not len(p):
                        continue
                    swap = x[s + p] > y[r]
                    p_ids, r_ids = a_ids.take(pa.array(s + p)), b_ids.take(pa.array(r))
                    yield pa.record_batch([pc.if_else(pa.array(swap), r_ids, p_ids), pc.if_else(pa.array(swap), p_ids, r_ids), pa.array(z[p, r], mask=none[p, r])], names=["a", "b", "score"])

    return work


def measures(rows: DataFrame, group: str, value: str, low: float = -1.0, high: float = 1.0, bins: int = 1 << 16) -> DataFrame:
    """group, n, low, high, mean, median of each group: n counts its rows, the others its values that are neither null nor NaN (null if there are none).

    The median is exact: values are counted in ``bins`` bins from low to high (those beyond in the outer ones), and only the values of the bin or two with the
    middle places are looked at again. The rows are read twice and kept nowhere.
    """
    x = F.when(~F.isnan(value), F.col(value).cast("double"))
    known = rows.select(F.col(group).alias("g"), x.alias("x")).withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / (high - low) * bins).cast("int"))))
    known = known.withColumn("bin", F.when(F.col("x").isNotNull(), F.col("bin")).otherwise(-1))
    counts = known.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.sum("x").alias("sum"))
    one, whole = Window.partitionBy("g").orderBy("bin"), Window.partitionBy("g")
    valued = F.when(F.col("bin") >= 0, F.col("n")).otherwise(0)
    placed = counts.select("*", F.sum(valued).over(one).alias("upto"), F.sum(valued).over(whole).alias("valued"))
    p, q = F.floor((F.col("valued") + 1) / 2), F.floor((F.col("valued") + 2) / 2)
    middle = (F.col("bin") >= 0) & (((p > F.col("upto") - F.col("n")) & (p <= F.col("upto"))) | ((q > F.col("upto") - F.col("n")) & (q <= F.col("upto"))))
    wanted = F.collect_list(F.when(middle, F.struct("bin", (F.col("upto") - F.col("n")).alias("before"))))  # two at most
    totals = placed.groupBy("g").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("sum") / F.max("valued")).alias("mean"), F.max("valued").alias("valued"), wanted.alias("wanted"))
    found = known.alias("k").join(totals.select("g", p.alias("p"), q.alias("q"), F.inline("wanted")).alias("w"), F.col("k.g").eqNullSafe(F.col("w.g")) & (F.col("k.bin") == F.col("w.bin")))
    values = found.groupBy(F.col("k.g").alias("g"), "before", "p", "q", "x").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("before") + F.sum("m").over(Window.partitionBy("g", "before").orderBy("x"))
    run = values.withColumn("upto", upto).groupBy("g").agg(*(F.max(F.when((F.col(c) > F.col("upto") - F.col("m")) & (F.col(c) <= F.col("upto")), F.col("x"))).alias(c) for c in ("p", "q")))
    out = totals.alias("t").join(run.alias("r"), F.col("t.g").eqNullSafe(F.col("r.g")), "left")
    return out.select(F.col("t.g").alias(group), "n", "low", "high", "mean", ((F.col("r.p") + F.col("r.q")) / 2).alias("median"))
