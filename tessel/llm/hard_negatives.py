"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that score nearly as high as the positive.

Every anchor is scored against all rows, tile by tile: a task holds tiles of anchors and reads tiles of rows (see ``operators.tiles``), sorts all scores of
an anchor by score and id, finds each positive's upper limit in them by binary search, and reads on over rows of other labels as far as the lower limit.
It keeps the first ones of each positive; the tasks' few are merged by anchor and positive. Positives come from a first pass in the same way.

- Rows with a null id, label or vector, or with a null, NaN or infinite component take no part. Of vectors of unlike lengths the shorter counts as filled up
  with zeros. A component x is floor(scale * x), x as double.
- Scores are exact whole numbers; those beyond 64 bits count as the largest or smallest long.
- Equal scores: the smaller id first. Rows with the anchor's own id are never its positives or negatives. Repeated rows are rows of their own: an
  anchor that is given twice is mined twice, and a positive that is given twice counts twice.
- An anchor without another row of its label has no positives and no result, nor has a positive below zero (its lower limit lies above it).
- Empty tables give an empty result; columns other than id, v and label are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table
from tessel.operators.tiles import column, compare, dense, pack, width_of

_AT_ONCE = 128
_MOST = np.iinfo(np.int64).max - 1
_OUT = -np.iinfo(np.int64).max


def whole_rows(rows: DataFrame) -> DataFrame:
    """id, v, label: those that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("id").cast("long").alias("id"), "v", "label").where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)


def _scaled(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """Whole numbers, in doubles; filled up with zeros."""
    return np.floor(scale * dense(lists, width)[0])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows with all rows."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


def _merged(held: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, k in each row: the first of both, by score and id."""
    score, ids = (np.concatenate(x, axis=-1) for x in zip(held, new))
    at = np.lexsort((ids, -score), axis=-1)[..., :k]
    return np.take_along_axis(score, at, axis=-1), np.take_along_axis(ids, at, axis=-1)


class _Anchors:
    """The anchors that a task holds, and what each tile of rows is compared by."""

    def __init__(self, lefts: list[pa.Table], scale: float):
        self.rows, self.scale = pa.concat_tables(lefts), scale
        self.lists = column(self.rows, "v")
        self.ids, self.n = column(self.rows, "id").to_numpy(), self.rows.num_rows

    def against(self, t: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For blocks of anchors: which, the scores of all rows of the tile, where labels agree, and the ids (ascending)."""
        lists = column(t, "v")
        width = max(width_of(self.lists), width_of(lists))
        a, b, ids = _scaled(self.lists, width, self.scale), _scaled(lists, width, self.scale), column(t, "id").to_numpy()
        labels = column(t, "label")
        known = labels.unique()
        theirs, mine = pc.index_in(labels, known).to_numpy(), pc.index_in(column(self.rows, "label"), known).fill_null(-1).to_numpy()
        for s in range(0, self.n, _AT_ONCE):
            at = slice(s, s + _AT_ONCE)
            yield at, _scores(a[at], b), mine[at, None] == theirs, ids


def _find_positives(k: int, scale: float) -> Callable:
    def work(lefts: list[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        own = _Anchors(lefts, scale)
        held = np.full((own.n, k), _OUT), np.zeros((own.n, k), np.int64)
        for t in rights:
            for at, z, same, ids in own.against(t):
                z = np.where(same & (own.ids[at, None] != ids), z, _OUT)
                first = np.argsort(-z, axis=1, kind="stable")[:, :k]
                best = _merged((held[0][at], held[1][at]), (np.take_along_axis(z, first, axis=1), ids[first]), k)
                held[0][at], held[1][at] = best
        i, j = np.nonzero(held[0] > _OUT)
        yield pa.record_batch([column(own.rows, "anchor").take(pa.array(i)), pa.array(held[1][i, j]), pa.array(held[0][i, j])], names=["anchor", "positive_id", "positive_score"])

    return work


def _find_negatives(positives: int, k: int, scale: float, low: int, high: int) -> Callable:
    def limits(score: int) -> tuple[int, int]:
        """Whole scores n with low * score <= 100 * n <= high * score."""
        return -(-low * score // 100), high * score // 100

    def work(lefts: list[pa.Table], rights: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        own = _Anchors(lefts, scale)
        scores = column(own.rows, "scores").to_pylist()
        bounds = [[limits(p) for p in x] for x in scores]
        held = np.full((own.n, positives, k), _OUT), np.zeros((own.n, positives, k), np.int64)
        for t in rights:
            for at, z, same, ids in own.against(t):
                order = np.argsort(-z, axis=1, kind="stable")  # rows come by id, so equal scores stay in its order
                z, other = np.take_along_axis(z, order, axis=1), np.take_along_axis(~same & (own.ids[at, None] != ids), order, axis=1)
                new = np.full((len(z), positives, k), _OUT), np.zeros((len(z), positives, k), np.int64)
                for i in range(len(z)):
                    places = np.flatnonzero(other[i])
                    down = -z[i]
                    for p, (least, most) in enumerate(bounds[at.start + i]):
                        begin = np.searchsorted(places, np.searchsorted(down, -most, "left"))
                        found = places[begin : begin + k]
                        found = found[z[i, found] >= least]
                        new[0][i, p, : len(found)], new[1][i, p, : len(found)] = z[i, found], ids[order[i, found]]
                held[0][at], held[1][at] = _merged((held[0][at], held[1][at]), new, k)
        i, p, j = np.nonzero(held[0] > _OUT)
        yield pa.record_batch([column(own.rows, "anchor").take(pa.array(i)), pa.array(p.astype(np.int32)), pa.array(held[1][i, p, j]), pa.array(held[0][i, p, j])], names=["anchor", "place", "negative_id", "negative_score"])

    return work


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: float = 256.0, low: int = 80, high: int = 100) -> DataFrame:
    """rows: id (a whole number), v, label. anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    ``positives`` other rows of the same label the first ``negatives`` rows of other labels with low * positive_score <= 100 * score <= high * positive_score."""
    ws = Workspace(rows.sparkSession, "hard-negatives")
    known = whole_rows(rows)
    tiles = pack(known, "id", "v")
    anchors = ws.save(known.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    first = compare(pack(anchors, "id", "v"), tiles, _find_positives(positives, scale), "anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = ws.save(first.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives), "positives")
    ordered = F.array_sort(F.collect_list(F.struct("place", "positive_score")))
    asked = anchors.join(found.groupBy("anchor").agg(F.transform(ordered, lambda x: x["positive_score"]).alias("scores")), "anchor")
    near = compare(pack(asked, "id", "v"), tiles, _find_negatives(positives, negatives, scale, low, high), "anchor long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = near.join(found, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), label.alias("label")), F.col("id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {
    "op11_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
