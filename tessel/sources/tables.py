"""Tables that jobs change together: Parquet folders, and a commit file that says which of them hold.

A job writes new folders; at its end one commit file appears in one step, under the next number. A job that dies before leaves the old state, and its
folders are of no table (``sweep`` removes them). Of two jobs that end at once one gets the number; the other's changes are put on top if no table that it
read or changed has changed meanwhile, else it fails with ``Conflict`` and can be run again. Appends alone always go on top.

A table with keys is spread over a fixed number of buckets by a hash of its keys: a change reads and writes only the buckets of the rows that arrive, and a
point read touches one. Rows with equal keys are one row to the writer; nulls are keys like others. A table without keys grows by folders.

The driver handles names of folders only (buckets of a table, appends since the last compaction). Needs a file system whose rename without overwriting is
one step, as that of HDFS or of a local disk.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.sources.shared import file_system

_BUCKET = "_bucket"


class Conflict(Exception):
    """Another job has changed a table of this one meanwhile."""


class Tables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._store, self._at = file_system(spark, self.path)

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._numbers(), default=0)

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self._state(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or as it was at a commit. An unknown table is an error."""
        return self._frame(self._table(self._state(version), name))

    def get(self, name: str, keys: dict, version: int | None = None) -> DataFrame:
        """The rows of one key; reads one bucket."""
        t = self._table(self._state(version), name)
        schema = T.StructType.fromJson(t["schema"])
        if not t["keys"] or sorted(keys) != sorted(t["keys"]):
            raise ValueError(f"{name} has the keys {t['keys']}")
        row = self.spark.createDataFrame([tuple(keys[k] for k in t["keys"])], T.StructType([schema[k] for k in t["keys"]]))
        bucket = row.select(_bucket(t)).first()[0]
        found = self._frame(t, [bucket])
        for k in t["keys"]:
            found = found.where(F.col(k).eqNullSafe(F.lit(keys[k]).cast(schema[k].dataType)))
        return found

    @contextmanager
    def job(self) -> Iterator[Job]:
        """Changes of several tables that hold together, or not at all."""
        job = Job(self)
        try:
            yield job
            job._commit()
        except BaseException:
            for folder in job._made:
                self._store.delete(self._hadoop(folder), True)
            raise

    def sweep(self, keep: int = 1, older_than_s: float = 86_400) -> int:
        """Deletes commits but for the last ``keep``, and folders of no commit that is left, if they are older than that (a running job's are not).
        Returns how many folders went."""
        numbers = sorted(self._numbers())
        held = {f for n in numbers[-keep:] for t in self._state(n)["tables"].values() for f in self._folders(t)}
        now, gone = self.spark._jvm.System.currentTimeMillis(), 0
        for s in self._store.listStatus(self._at) if self._store.exists(self._at) else ():
            if s.isDirectory() and (name := s.getPath().getName()).startswith("data-") and name not in held and now - s.getModificationTime() >= older_than_s * 1000:
                self._store.delete(s.getPath(), True)
                gone += 1
        for n in numbers[:-keep]:
            self._store.delete(self._hadoop(self._commit_file(n)), False)
        return gone

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _commit_file(self, n: int) -> str:
        return f"commits/{n:020d}.json"

    def _numbers(self) -> list[int]:
        folder = self._hadoop("commits")
        if not self._store.exists(folder):
            return []
        found = [re.fullmatch(r"(\d{20})\.json", s.getPath().getName()) for s in self._store.listStatus(folder)]
        return [int(m.group(1)) for m in found if m]

    def _state(self, version: int | None = None) -> dict:
        n = self.version() if version is None else version
        if not n:
            return {"tables": {}}
        stream = self._store.open(self._hadoop(self._commit_file(n)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, n: int, state: dict) -> bool:
        """Makes the state commit n, unless there is one already."""
        jvm, tmp, at = self.spark._jvm, self._hadoop(f"commits/.{uuid.uuid4().hex}"), self._hadoop(self._commit_file(n))
        out = self._store.create(tmp)
        out.write(bytearray(json.dumps(state, ensure_ascii=True).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(tmp, at, options)
            return True
        except Py4JJavaError as e:
            self._store.delete(tmp, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def _table(self, state: dict, name: str) -> dict:
        if name not in state["tables"]:
            raise KeyError(name)
        return state["tables"][name]

    def _folders(self, t: dict) -> set[str]:
        return {p.split("/")[0] for p in (t["buckets"].values() if t["keys"] else t["folders"])}

    def _frame(self, t: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(t["schema"])
        names = t["folders"] if not t["keys"] else [p for b, p in t["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in names]) if names else self.spark.createDataFrame([], schema)


def _bucket(t: dict):
    at = F.col(t["keys"][0]) if t["direct"] else F.xxhash64(*t["keys"])
    return F.pmod(at, F.lit(t["count"])).cast("int").alias(_BUCKET)


def _without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with none of these keys, null ones included."""
    other = gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct()
    return rows.join(other, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in keys], "left_anti")


class Job:
    """What one job reads and changes; see ``Tables.job``."""

    def __init__(self, tables: Tables):
        self._t, self._base = tables, tables.version()
        self._old = tables._state(self._base or None) if self._base else {"tables": {}}
        self._new: dict[str, dict] = json.loads(json.dumps(self._old["tables"]))
        self._seen: set[str] = set()
        self._grown: dict[str, list[str]] = {}
        self._made: list[str] = []
        self.number: int | None = None

    def create(self, name: str, schema: str | T.StructType, keys: list[str] | None = None, buckets: int = 16, direct: bool = False) -> None:
        """A new, empty table; one that is there already stays if it is alike, else it is an error. ``direct``: the one key is a bucket's number."""
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        wanted = {"schema": json.loads(schema.json()), "keys": keys or [], "count": buckets, "direct": direct}
        if name in self._new:
            if any(self._new[name][k] != wanted[k] for k in wanted):
                raise ValueError(f"{name} is another table already")
            return
        self._seen.add(name)
        self._new[name] = wanted | ({"buckets": {}} if keys else {"folders": []})

    def drop(self, name: str) -> None:
        """An unknown table is no error."""
        self._seen.add(name)
        self._new.pop(name, None)

    def read(self, name: str) -> DataFrame:
        self._seen.add(name)
        return self._t._frame(self._t._table({"tables": self._new}, name))

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets of these rows' keys."""
        return self._touched(self._t._table({"tables": self._new}, name), rows)

    def near(self, name: str, buckets: list[int]) -> DataFrame:
        """The table's rows in these buckets: all that a change by rows of these can concern."""
        self._seen.add(name)
        return self._t._frame(self._t._table({"tables": self._new}, name), buckets)

    def append(self, name: str, rows: DataFrame) -> None:
        """To a table without keys."""
        t = self._t._table({"tables": self._new}, name)
        if t["keys"]:
            raise ValueError(f"{name} has keys")
        folder = self._write(rows.select(*self._columns(t)))
        t["folders"].append(folder)
        self._grown.setdefault(name, []).append(folder)

    def merge(self, name: str, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Rows over those with the same keys, or what ``how(old rows of the buckets, rows)`` makes of them."""
        t = self._t._table({"tables": self._new}, name)
        touched = self._touched(t, rows)
        rows = rows if how else rows.select(*self._columns(t))
        self.put_near(name, how(self._t._frame(t, touched), rows) if how else _without(self._t._frame(t, touched), rows, t["keys"]).unionByName(rows), touched)

    def delete(self, name: str, keys: DataFrame) -> None:
        """The rows with these keys; unknown ones are no error. keys may have some of the table's keys only; then all buckets are written anew."""
        t = self._t._table({"tables": self._new}, name)
        own = [k for k in t["keys"] if k in keys.columns]
        touched = self._touched(t, keys) if own == t["keys"] else [int(b) for b in t["buckets"]]
        self.put_near(name, _without(self._t._frame(t, touched), keys, own), touched)

    def put_near(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        """The rows are all that there is from now on in these buckets."""
        self._seen.add(name)
        t = self._t._table({"tables": self._new}, name)
        folder = self._write(rows.select(*self._columns(t), _bucket(t)).repartition(_BUCKET), _BUCKET)
        for b in touched:
            t["buckets"].pop(str(b), None)
        for s in self._t._store.listStatus(self._t._hadoop(folder)):
            if (part := s.getPath().getName()).startswith(f"{_BUCKET}="):
                b = part.split("=")[1]
                if int(b) not in touched:
                    raise ValueError(f"{name}: rows of other buckets")
                t["buckets"][b] = f"{folder}/{part}"

    def put(self, name: str, rows: DataFrame) -> None:
        """The rows are the table from now on."""
        self._seen.add(name)
        t = self._t._table({"tables": self._new}, name)
        if t["keys"]:
            self.put_near(name, rows, list(range(t["count"])))
        else:
            t["folders"] = [self._write(rows.select(*self._columns(t)))]
            self._grown.pop(name, None)

    def _columns(self, t: dict) -> list:
        return [F.col(f.name).cast(f.dataType) for f in T.StructType.fromJson(t["schema"]).fields]

    def _touched(self, t: dict, rows: DataFrame) -> list[int]:
        """At most as many as the table has buckets."""
        schema = T.StructType.fromJson(t["schema"])
        return [r[0] for r in rows.select(*[F.col(k).cast(schema[k].dataType) for k in t["keys"]]).select(_bucket(t)).distinct().collect()]

    def _write(self, rows: DataFrame, *by: str) -> str:
        folder = f"data-{uuid.uuid4().hex}"
        self._made.append(folder)
        rows.write.partitionBy(*by).parquet(f"{self._t.path}/{folder}")
        return folder

    def _commit(self) -> None:
        while True:
            n = self._t.version()
            now = self._t._state(n)["tables"] if n else {}
            new = self._new
            if n != self._base:
                if any(now.get(name) != self._old["tables"].get(name) for name in self._seen):
                    raise Conflict(f"commit {n} changed a table of this job")
                new = now | {name: self._new[name] for name in self._seen if name in self._new}
                for name in self._seen - set(self._new):
                    new.pop(name, None)
                for name, folders in self._grown.items():
                    if name not in self._seen:
                        if name not in now:
                            raise Conflict(f"commit {n} dropped {name}")
                        new[name] = now[name] | {"folders": [*now[name]["folders"], *folders]}
            if self._t._publish(n + 1, {"tables": new}):
                self.number = n + 1
                return


#: A log's operations, in the column ``op``.
PUT, DELETE, DELETE_ALL = "put", "delete", "delete_all"


class Log:
    """An append-only log with sequence numbers: puts by key, deletes by group, deletes of all; see ``replay``.

    A row's number is (place of its append, number of its task, row in the task): no task numbers all rows. Appends get their place when they are
    committed, so that two at once both stand, one behind the other. A delete-all begins an epoch: appends before it aren't read any more.
    """

    def __init__(self, tables: Tables, name: str, schema: str, key: str, group: str):
        self._t, self._name, self.key, self.group = tables, name, key, group
        if name not in tables.names():
            with tables.job() as job:
                job.create(name, f"{schema}, op string, row long")

    def append(self, rows: DataFrame, op: str = PUT) -> int:
        """Rows (of a delete: groups) in their order; returns the commit's number."""
        with self._t.job() as job:
            fields = T.StructType.fromJson(job._new[self._name]["schema"]).fields[:-2]
            full = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.lit(op).alias("op"))
            job.append(self._name, full.withColumn("row", F.monotonically_increasing_id()))
        return job.number

    def delete_all(self) -> int:
        """What is in the log goes, also what other appends have added until the commit."""
        while True:
            try:
                with self._t.job() as job:
                    job.put(self._name, job.read(self._name).limit(0))
                return job.number
            except Conflict:
                continue

    def rows(self) -> DataFrame:
        """The log with ``seq``."""
        t = self._t._table(self._t._state(), self._name)
        whole = self._t._frame(t)
        if not t["folders"]:
            return whole.withColumn("seq", F.struct(F.lit(0).alias("append"), "row")).drop("row")
        places = F.create_map(*[F.lit(x) for n, f in enumerate(t["folders"]) for x in (f, n)])
        at = F.element_at(places, F.regexp_extract(F.input_file_name(), r"(data-[0-9a-f]{32})/[^/]*$", 1))
        return whole.withColumn("append", at).withColumn("seq", F.struct("append", "row")).drop("append", "row")

    def replay(self) -> DataFrame:
        """What the log leaves: the last put of each key that no later delete of its group has removed."""
        log = self.rows()
        graves = log.where(F.col("op") == DELETE).groupBy(self.group).agg(F.max("seq").alias("_grave"))
        puts = log.where(F.col("op") == PUT)
        last = puts.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in puts.columns if c != self.key]), "seq").alias("_r")).select(self.key, "_r.*")
        left = last.join(graves.withColumnRenamed(self.group, "_g"), F.col(self.group).eqNullSafe(F.col("_g")), "left")
        return left.where(F.col("_grave").isNull() | (F.col("_grave") < F.col("seq"))).drop("_grave", "_g", "op", "seq")

    def compact(self) -> bool:
        """Puts what the log leaves in its place, as one append. False if another append came meanwhile; then the log is as it was."""
        try:
            with self._t.job() as job:
                job._seen.add(self._name)
                left = self.replay().withColumn("op", F.lit(PUT)).withColumn("row", F.monotonically_increasing_id())
                job.put(self._name, left)
            return True
        except Conflict:
            return False


class Executions:
    """Searches as they were answered: raw hits in order, the first page as it was shown, and the corpus version. What is stored is never changed."""

    def __init__(self, tables: Tables, hits: str, kind: str = "string", buckets: int = 64):
        """hits: the fields of a hit, as of a struct; kind: the request's type."""
        self._t = tables
        if "executions" not in tables.names():
            with tables.job() as job:
                job.create("executions", f"request {kind}, corpus string, at timestamp, size int, raw_hits array<struct<pos:int,{hits}>>, first_page string", ["request"], buckets)

    def store(self, results: DataFrame, corpus: str, at: str, size: int) -> None:
        """results: request, pos, and the hit's fields. One row for each request; a request that is stored already stays as it was."""
        fields = [c for c in results.columns if c not in ("request", "pos")]
        hit = F.struct(F.col("pos").cast("int").alias("pos"), *fields)
        page = F.to_json(F.array_sort(F.collect_list(F.when(F.col("pos") < size, hit))))
        rows = results.groupBy("request").agg(F.array_sort(F.collect_list(hit)).alias("raw_hits"), page.alias("first_page"))
        rows = rows.withColumns({"corpus": F.lit(corpus), "at": F.lit(at).cast("timestamp"), "size": F.lit(size)})
        with self._t.job() as job:
            job.merge("executions", rows, lambda old, new: old.unionByName(new.join(old.select("request"), "request", "left_anti")))

    def first_page(self, request) -> DataFrame:
        """request and the page's JSON, from the stored row alone."""
        return self._t.get("executions", {"request": request}).select("request", "first_page")

    def page(self, request, offset: int, corpus_now: str) -> DataFrame:
        """The hits from offset on, a page of them, in the stored order; ``stale`` if the corpus is another one than then."""
        row = self._t.get("executions", {"request": request})
        hits = row.select("request", (F.col("corpus") != corpus_now).alias("stale"), "size", F.explode("raw_hits").alias("h"))
        return hits.where((F.col("h.pos") >= offset) & (F.col("h.pos") < F.lit(offset) + F.col("size"))).select("request", "stale", "h.*")

    def all(self, corpus_now: str) -> DataFrame:
        """Every hit of every stored search, with its first page."""
        rows = self._t.read("executions")
        return rows.select("request", "size", "first_page", (F.col("corpus") != corpus_now).alias("stale"), F.explode("raw_hits").alias("h")).select("request", "size", "first_page", "stale", "h.*")
