"""An inverted-file index of vectors: cells as buckets of a stored table.

``create`` fixes the number of dimensions and the cells' centres, which are fitted (k-means) on a bounded sample: the ``sample`` vectors with the smallest hashes
pass through the driver, and the centres are its only other data there. Every vector is indexed, in the ``COPIES`` cells whose centres have the largest products
with it: with two copies, half of the cells give a recall at ten of over 0.94 on vectors that hardly cluster, where one copy gives 0.8.
A search looks into the ``probes`` best cells of each request (others are not read), or without ``probes`` into all, which is exact. Adding vectors writes
their cells anew, and the cells that held the same ids before; all in one commit.

A vector of other dimensions, a null vector and one with a null are an error when added, as is a null id; rows with the same id in one call are an error.
An unknown index has no hits, no counts, and nothing to drop or delete.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators import tiles
from tessel.sources.tables import Tables

SAMPLE, ROUNDS, COPIES = 16_384, 12, 2


def centres_of(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """k-means over the bounded sample, from spread-out starts; the same for the same vectors."""
    rows = tiles.pivots_of(vectors, "v", sample)
    if rows is None:
        raise ValueError("no vectors to fit cells on")
    r = np.random.default_rng(0)
    out = rows[r.permutation(len(rows))[:cells]]
    for _ in range(ROUNDS):
        own = np.argmin((out**2).sum(axis=1) - 2 * rows @ out.T, axis=1)
        sums, n = np.zeros_like(out), np.bincount(own, minlength=len(out))
        np.add.at(sums, own, rows)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


class VectorIndex:
    def __init__(self, tables: Tables, name: str):
        self._t, self._name = tables, name

    @property
    def _cells(self) -> str:
        return f"{self._name}-cells"

    def exists(self) -> bool:
        return self._name in self._t.names()

    def create(self, like: DataFrame, dims: int, cells: int, sample: int = SAMPLE) -> bool:
        """like: id, v, and columns that are kept with a vector. An index that is there already stays (False) if it has these dimensions, else it is an error."""
        if self.exists():
            if self._dims() != dims:
                raise ValueError(f"{self._name} has {self._dims()} dimensions, not {dims}")
            return False
        self._check(like, dims)
        centres = centres_of(like, cells, sample)
        fields = [f for f in like.schema.fields if f.name not in ("id", "v", "cell", "nth")]
        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("nth", T.IntegerType()), like.schema["id"], T.StructField("v", T.ArrayType(T.FloatType())), *fields])
        with self._t.job() as job:
            job.create(self._name, schema, ["cell"], len(centres), direct=True)
            job.create(self._cells, "cell int, centre array<double>")
            job.append(self._cells, like.sparkSession.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, centre array<double>"))
        return True

    def add(self, rows: DataFrame) -> None:
        """Vectors over those with the same ids."""
        centres = self._centres()
        self._check(rows, centres.shape[1])
        new = self._assigned(rows, centres, COPIES)
        with self._t.job() as job:
            ids = rows.select("id")
            if ids.groupBy("id").count().where("count > 1").limit(1).count():
                raise ValueError("an id comes twice")
            old = job.read(self._name).select("cell", "id").join(ids, "id", "left_semi").select("cell")
            touched = job.touched(self._name, new.select("cell").unionByName(old))
            left = job.near(self._name, touched).join(ids, "id", "left_anti")
            job.put_near(self._name, left.unionByName(new.select(*left.columns)), touched)

    def delete(self, ids: DataFrame) -> None:
        """Vectors by id; unknown ones are no error."""
        if self.exists():
            with self._t.job() as job:
                touched = job.touched(self._name, job.read(self._name).select("cell", "id").join(ids.select("id"), "id", "left_semi"))
                job.put_near(self._name, job.near(self._name, touched).join(ids.select("id"), "id", "left_anti"), touched)

    def drop(self) -> None:
        if self.exists():
            with self._t.job() as job:
                job.drop(self._name)
                job.drop(self._cells)

    def count(self) -> int:
        return self._t.read(self._name).where("nth = 0").count() if self.exists() else 0

    def search(self, requests: DataFrame, k: int, probes: int | None = None, digits: int = 6) -> DataFrame:
        """requests: request (of the ids' type), q. request, id, score and rank of each request's k best; ties by id."""
        if not self.exists():
            kind = requests.schema["request"].dataType.simpleString()
            return requests.sparkSession.createDataFrame([], f"request {kind}, id {kind}, score double, rank int")
        self._check(requests.select(F.col("request").alias("id"), F.col("q").alias("v")), self._dims())
        if probes is None:
            vectors = self._t.read(self._name).where("nth = 0").select("id", "v", F.lit(0).alias("label"))
            return tiles.nearest(vectors, requests, k, digits).drop("label")
        asked = self._assigned(requests.select(F.col("request").alias("id"), F.col("q").alias("v")), self._centres(), probes)
        found = self.probed(requests, probes).withColumn("label", F.lit(0)).select("id", "v", "label", "cell")
        kind = found.schema["id"].dataType.simpleString()
        asked = asked.withColumn("id", F.col("id").cast(kind))
        left, right = tiles.pack(asked, "id", "v", cluster="cell"), tiles.pack(found, "id", "v", cluster="cell")
        out = tiles.compare_within(left, right, tiles._top(k, digits, True, False), f"request {kind}, id {kind}, label int, score double")
        return tiles._ranked(out.dropDuplicates(["request", "id"]), k).drop("label")

    def probed(self, requests: DataFrame, probes: int) -> DataFrame:
        """The vectors of all cells that any of the requests looks into; no other cell is read."""
        asked = self._assigned(requests.select(F.col("request").alias("id"), F.col("q").alias("v")), self._centres(), probes)
        wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # at most as many as there are cells
        t = self._t._table(self._t._state(), self._name)
        return self._t._frame(t, wanted)

    def _centres(self) -> np.ndarray:
        return np.array([r["centre"] for r in self._t.read(self._cells).orderBy("cell").collect()])

    def _dims(self) -> int:
        return self._centres().shape[1]

    def _check(self, rows: DataFrame, dims: int) -> None:
        bad = F.col("id").isNull() | F.col("v").isNull() | (F.size("v") != dims) | F.exists("v", lambda x: x.isNull())
        if n := rows.where(bad).count():
            raise ValueError(f"{n} rows without an id or {dims} dimensions")

    def _assigned(self, rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
        """The rows in each of their best cells, the nth best from 0."""
        fields = [T.StructField("cell", T.IntegerType()), T.StructField("nth", T.IntegerType()), *[f for f in rows.schema.fields if f.name not in ("cell", "nth")]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, _ = tiles.dense(b.column("v"), centres.shape[1])
                best = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(len(v)), best.shape[1])
                kept = b.take(pa.array(at))
                nth = np.broadcast_to(np.arange(best.shape[1], dtype=np.int32), best.shape).ravel()
                yield pa.record_batch([pa.array(best.ravel().astype(np.int32)), pa.array(nth), *[kept.column(f.name) for f in fields[2:]]], names=[f.name for f in fields])

        return rows.mapInArrow(run, T.StructType(fields))
