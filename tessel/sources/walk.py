"""The walk over a corpus as one incremental job: a hand-kept folder and indexed folders with their archives become one manifest.

Tasks list folders. Contents are hashed in tasks, piece by piece, and only of files that a cache doesn't know by path, size and time. Of an
archive its central directory is read first; its members are then spread over tasks, each of which seeks its members in the archive. Archives in archives are
opened in memory, one by a task.

A bad outer archive has no members, a bad inner one is an error; archives in more than five others are left out. Folders without files give no rows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.files import INDEX_COLUMNS, ZIP_DEPTH
from tessel.sources.shared import written

PIECE = 1 << 20
_KEY = ["path", "length", "modificationTime"]
_MEMBER = "path string, lineage array<string>, member string, nth int, bytes long"
MANIFEST = (
    "corpus_id string, categoria string, processo string, numero_sei string, tipo_documento string, data string, caminho string, formato string, bytes long, sha256 string, "
    "status_origem string, processo_url string, zip_caminho string, zip_membro string, zip_lineage array<string>, profundidade int"
)


def _store(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path, the path in it, and what stands before that."""
    m = re.match(r"file:(?://)?(/.*)$", path)
    if m or path.startswith("/"):
        return fs.LocalFileSystem(), m.group(1) if m else path, ""
    store, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store, inner, path.removesuffix(inner)


def opened(path: str):
    """A file to read from, with seek."""
    store, inner, _ = _store(path)
    return store.open_input_file(inner)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of all files below a folder, empty and hidden ones too. The folder itself is listed first, then the folders in it by
    tasks, and what is below these by other tasks. No file is read; a folder that isn't there has none."""
    kinds = {"path": pa.string(), "length": pa.int64(), "modificationTime": pa.timestamp("us", "UTC"), "folder": pa.bool_()}
    schema = "path string, length long, modificationTime timestamp, folder boolean"

    def below(deep: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in b.column("path").to_pylist():
                    store, inner, before = _store(at)
                    found = [x for x in store.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=deep)) if not deep or x.is_file]
                    rows = [{"path": before + x.path, "length": None if x.type == fs.FileType.Directory else x.size, "modificationTime": x.mtime, "folder": x.type == fs.FileType.Directory} for x in found]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))

        return run

    tasks = _parts(spark)
    first = written(spark.createDataFrame([(path,)], "path string").mapInArrow(below(False), schema), "listing")[0]
    second = written(first.where("folder").select("path").repartition(tasks).mapInArrow(below(False), schema), "listing")[0]
    third = second.where("folder").select("path").repartition(tasks).mapInArrow(below(True), schema)
    return first.where("NOT folder").unionByName(second.where("NOT folder")).unionByName(third).select(*_KEY)


def _parts(spark: SparkSession) -> int:
    """Tasks for rows that are small and mean much work, which adaptive planning would put together."""
    return 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _digest(stream) -> str:
    h = hashlib.sha256()
    while piece := stream.read(PIECE):
        h.update(piece)
    return h.hexdigest()


def hashed(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """files: path, length, modificationTime; cache: the same with sha256. sha256 of each file, and whether the cache had it. Files are read once, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                with opened(path) as f:
                    found.append(_digest(f))
            yield pa.record_batch([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "sha256"])

    rows = files.select(*_KEY)
    known = None
    if cache is not None:
        known = rows.join(cache.select(*_KEY, "sha256").dropDuplicates(_KEY), _KEY).withColumn("cached", F.lit(True))
        rows = rows.join(cache.select(*_KEY), _KEY, "left_anti")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sha256 string"
    fresh = rows.repartition(_parts(files.sparkSession)).mapInArrow(run, schema).withColumn("cached", F.lit(False))
    return fresh if known is None else known.unionByName(fresh)


class _Archives:
    """Archives as (path, lineage); the last one opened stays open."""

    def __init__(self) -> None:
        self._at, self._open = None, []

    def get(self, path: str, lineage: list[str]) -> zipfile.ZipFile | None:
        """None for a bad outer archive."""
        if self._at != (path, lineage):
            self.close()
            try:
                file = opened(path)
                self._open = [file]
                z = zipfile.ZipFile(file)
            except (zipfile.BadZipFile, OSError, ValueError):  # too short to seek in is a ValueError
                return None
            self._open.append(z)
            for name in lineage:
                z = zipfile.ZipFile(io.BytesIO(z.read(name)))
                self._open.append(z)
            self._at = (path, lineage)
        return self._open[-1]

    def close(self) -> None:
        for x in reversed(self._open):
            x.close()
        self._at, self._open = None, []


def _visit(each: Callable[[zipfile.ZipFile, dict], Iterator[tuple]], names: list[str]) -> Callable:
    """Calls ``each`` with the archive of each row; what it yields are rows with these columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = _Archives()
        for b in batches:
            rows = [x for r in b.to_pylist() if (z := archives.get(r["path"], r["lineage"])) is not None for x in each(z, r)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in rows], pa.schema([(n, _ARROW[n]) for n in names]))
        archives.close()

    return run


_ARROW = {"path": pa.string(), "lineage": pa.list_(pa.string()), "member": pa.string(), "nth": pa.int32(), "bytes": pa.int64(), "sha256": pa.string(), "content": pa.binary()}


def directory(archives: DataFrame) -> DataFrame:
    """archives: path, lineage (the archives that it stands in, from the outer file's own members on). Its members; no member is read."""

    def each(z: zipfile.ZipFile, r: dict) -> Iterator[tuple]:
        for n, info in enumerate(z.infolist()):
            if not info.is_dir():
                yield r["path"], r["lineage"], info.filename, n, info.file_size

    return archives.select("path", "lineage").repartition(_parts(archives.sparkSession)).mapInArrow(_visit(each, ["path", "lineage", "member", "nth", "bytes"]), _MEMBER)


def members(archives: DataFrame, depth: int = ZIP_DEPTH) -> DataFrame:
    """archives: path. All members of archives and of those in them, with their sha256. An archive in an archive is no member itself."""
    level = archives.select("path", F.array().cast("array<string>").alias("lineage"))
    is_zip, out = F.lower("member").endswith(".zip"), None

    def each(z: zipfile.ZipFile, r: dict) -> Iterator[tuple]:
        with z.open(z.infolist()[r["nth"]]) as f:
            yield r["path"], r["lineage"], r["member"], r["nth"], r["bytes"], _digest(f)

    for n in range(depth):
        found = written(directory(level), "members")[0]
        parts = _parts(archives.sparkSession)
        spread = found.where(~is_zip).repartition(parts).sortWithinPartitions("path", "nth") if n == 0 else found.where(~is_zip).repartition(parts, "path", "lineage").sortWithinPartitions("path", "lineage", "nth")
        hashes = spread.mapInArrow(_visit(each, ["path", "lineage", "member", "nth", "bytes", "sha256"]), _MEMBER + ", sha256 string")
        out = hashes if out is None else out.unionByName(hashes)
        level = found.where(is_zip).select("path", F.concat("lineage", F.array("member")).alias("lineage"))
        if level.isEmpty():
            break
    return out


def contents(wanted: DataFrame) -> DataFrame:
    """wanted: path, lineage, member. The contents of these members alone; of their archives only the directories are read. Unknown members have no row."""

    def each(z: zipfile.ZipFile, r: dict) -> Iterator[tuple]:
        if r["member"] in z.namelist():
            yield r["path"], r["lineage"], r["member"], z.read(r["member"])

    rows = wanted.select("path", "lineage", "member").distinct().repartition(_parts(wanted.sparkSession), "path", "lineage").sortWithinPartitions("path", "lineage")
    return rows.mapInArrow(_visit(each, ["path", "lineage", "member", "content"]), "path string, lineage array<string>, member string, content binary")


def _format(name: Column) -> Column:
    last = F.substring_index(name, "/", -1)
    return F.when(last.contains("."), F.lower(F.substring_index(last, ".", -1)))


def process_of_folder(name: Column) -> Column:
    """48500.004024-2017-80 and 48500.004024_2017-80 as 48500.004024/2017-80; other names with hyphens for underscores."""
    plain = F.replace(name, F.lit("_"), F.lit("-"))
    parts = F.split(plain, "-")
    return F.when(F.size(parts) == 3, F.concat(F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.lit("-"), F.get(parts, F.lit(2)))).otherwise(plain)


def curated(files: DataFrame, corpus_id: str, prefixes: dict[str, str], other: str) -> DataFrame:
    """Hashed files of a hand-kept folder (folder of a process / file), but for Markdown; the type comes from how the name begins, the first prefix that fits."""
    name, folder = F.substring_index("path", "/", -1), F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    kind = F.coalesce(*[F.when(F.lower(name).startswith(p), F.lit(t)) for p, t in prefixes.items()], F.lit(other))
    rows = files.where(~F.lower(name).endswith(".md"))
    return rows.select(F.lit(corpus_id).alias("corpus_id"), process_of_folder(folder).alias("processo"), kind.alias("tipo_documento"), F.col("path").alias("caminho"), _format(name).alias("formato"), F.col("length").alias("bytes"), "sha256", F.lit("ok").alias("status_origem"))


def process_addresses(files: DataFrame) -> DataFrame:
    """processo and url of all _processo.json files of a listing; malformed ones are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for path in b.column("path").to_pylist():
                with opened(path) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.record_batch([pa.array(texts, pa.string())], names=["text"])

    rows = files.where(F.substring_index("path", "/", -1) == "_processo.json").select("path").repartition(_parts(files.sparkSession))
    read = rows.mapInArrow(run, "text string").select(F.from_json("text", "processo string, url string").alias("j")).select("j.*")
    return read.where("processo <> '' AND url <> ''").groupBy("processo").agg(F.max("url").alias("processo_url"))


def index_rows(files: DataFrame) -> DataFrame:
    """The rows of all index CSVs (_indice_*.csv) of a listing, with their file (at). Names with an underscore are hidden from Spark's own readers; a task
    reads one file row by row."""
    fields = [*INDEX_COLUMNS, "at"]
    schema = pa.schema([(c, pa.string()) for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                with opened(path) as f:
                    lines = csv.DictReader(io.TextIOWrapper(f, "utf-8-sig", newline=""), delimiter=";", quotechar='"')
                    while rows := list(itertools.islice(lines, 10_000)):
                        yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in INDEX_COLUMNS} | {"at": path} for r in rows], schema)

    named = files.where(F.substring_index("path", "/", -1).rlike(r"^_indice_.*\.csv$")).select("path").repartition(_parts(files.sparkSession))
    return named.mapInArrow(run, ", ".join(f"`{c}` string" for c in fields))


def corpus_walk(spark: SparkSession, root: str, curated_folder: str, indexed_folder: str, corpora: tuple[str, str], prefixes: dict[str, str], other: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The manifest of both corpora below ``root``, and the hashes of all files for the next walk's cache.

    The indexed folder holds folders of categories, with their index CSVs and folders of processes. Each index row is a document: ``restrito`` or its own status
    without a file name, ``ausente_no_disco`` if the file isn't there, the members of its archive in place of the archive, else the file with its status.
    """
    root = re.sub(r"^file:/+", "/", root.rstrip("/"))
    own, indexed = (written(listing(spark, f"{root}/{f}"), "listing")[0] for f in (curated_folder, indexed_folder))
    archive, markdown = F.lower("path").endswith(".zip"), F.lower("path").endswith(".md")
    hidden = F.substring_index("path", "/", -1).startswith("_")
    hashes = written(hashed(own.where(~markdown).unionByName(indexed.where(~archive & ~hidden)), cache), "hashes")[0]

    index = index_rows(indexed)
    folder = F.regexp_replace("at", "/[^/]*$", "")
    index = index.withColumn("folder", F.concat(folder, F.lit("/"), F.replace("processo", F.lit("/"), F.lit("_")))).withColumn("categoria", F.substring_index(folder, "/", -1))
    index = written(index.drop("at").withColumn("arquivo", F.trim(F.coalesce("arquivo", F.lit("")))), "index")[0]
    urls = process_addresses(indexed)
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    status = F.trim(F.coalesce("status", F.lit("")))
    rows = index.withColumn("wanted", F.when(F.col("arquivo") != "", F.concat("folder", F.lit("/"), "arquivo"))).join(urls, "processo", "left")
    rows = rows.select(F.lit(corpora[1]).alias("corpus_id"), "categoria", "processo", empty("sei").alias("numero_sei"), "tipo_documento", empty("data").alias("data"), "processo_url", "wanted", status.alias("status"), _format(F.col("wanted")).alias("formato"))

    disk = indexed.select("path", F.col("path").alias("wanted")).join(hashes.select("path", F.col("length").alias("bytes"), "sha256"), "path", "left")
    met = rows.join(disk, "wanted", "left")
    plain = met.where("wanted IS NULL OR path IS NULL OR formato IS NULL OR formato <> 'zip'")
    state = F.when(F.col("wanted").isNull(), F.when(F.col("status") != "", F.col("status")).otherwise("restrito")).when(F.col("path").isNull(), "ausente_no_disco").otherwise(F.col("status"))
    plain = plain.withColumn("status_origem", state).withColumn("caminho", F.col("path"))
    zips = met.where("path IS NOT NULL AND formato = 'zip'").drop("formato", "bytes", "sha256")
    inner = members(zips.select("path").distinct()).select("path", F.col("lineage").alias("within"), "member", "bytes", "sha256")
    unpacked = zips.join(inner, "path").select("*", F.lit("ok").alias("status_origem"), _format(F.col("member")).alias("formato"), F.col("path").alias("zip_caminho"), F.col("member").alias("zip_membro"), (F.size("within") + 1).alias("profundidade"))
    unpacked = unpacked.withColumn("zip_lineage", F.when(F.size("within") > 0, F.concat(F.array("path"), "within")))
    whole = curated(own.select("path").join(hashes, "path"), corpora[0], prefixes, other)
    parts = [whole, plain, unpacked]
    fields = [x.split(" ", 1) for x in MANIFEST.split(", ")]
    shaped = [p.select(*[(F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in fields]) for p in parts]
    short = lambda c: F.regexp_replace(c, "^" + re.escape(root) + "/", "")
    out = shaped[0].unionByName(shaped[1]).unionByName(shaped[2])
    out = out.withColumns({"caminho": short("caminho"), "zip_caminho": short("zip_caminho")}).withColumn("zip_lineage", F.when(F.col("zip_lineage").isNotNull(), F.concat(F.array("zip_caminho"), F.slice("zip_lineage", 2, ZIP_DEPTH + 1))))
    return out, hashes.select(*_KEY, "sha256", "cached")
