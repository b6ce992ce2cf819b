"""Readers and writers of corpus files: index CSVs, JSON documents, JSON lines, Markdown tables, portal pages, ZIP archives."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZIP_DEPTH, CHUNK_BYTES = 5, 64 << 20
#: Columns of an index CSV and of a source manifest's documents.
INDEX_COLUMNS = ("categoria", "processo", "tipo_processo", "ordem", "sei", "tipo_documento", "data", "unidade", "arquivo", "bytes", "status")
SOURCE_COLUMNS = ("family_id", "family_label", "document_type", "official_id", "process_number", "source_system", "version_id", "document_date", "date_source", "locator")


def index_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ;-separated, quoted CSV with a header; a byte order mark is dropped."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in INDEX_COLUMNS)).options(sep=";", header=True, encoding="UTF-8", enforceSchema=False).csv(path)


def named_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path and text of all files of a name below a folder, also of a name that Spark's readers take for hidden. The driver lists, tasks read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, each = [], at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
    while each.hasNext():
        file = each.next().getPath()
        if file.getName() == name:
            found.append((re.sub(r"^file:/(?!/)", "file:///", file.toString()),))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            texts = []
            for url in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(url)
                with store.open_input_stream(inner) as f:
                    texts.append(f.read().decode("utf-8-sig", "replace"))
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.createDataFrame(found, "path string").mapInArrow(read, "path string, text string")


def process_urls(spark: SparkSession, path: str) -> DataFrame:
    """processo and url of all _processo.json files; malformed files are skipped."""
    rows = named_files(spark, path, "_processo.json").select(F.from_json("text", "processo string, url string").alias("j"))
    return rows.select("j.*").where("processo IS NOT NULL").groupBy("processo").agg(F.max("url").alias("url"))


def binary_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def curated_files(spark: SparkSession, path: str, prefixes: dict[str, str]) -> DataFrame:
    """Files of a hand-kept folder but Markdown; the type comes from how the name begins."""
    name = F.substring_index("path", "/", -1)
    kind = F.coalesce(*[F.when(F.lower(name).startswith(p.lower()), F.lit(t)) for p, t in prefixes.items()], F.lit("Documento"))
    files = binary_files(spark, path).where(~F.lower(name).endswith(".md"))
    return files.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("formato"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("tipo_documento"))


def indexed_files(index: DataFrame, files: DataFrame, folder: str | None = None) -> DataFrame:
    """Index rows with their files. status_origem: restrito (no file named), ausente_no_disco, zip or file.

    folder: the index column with the name of the folder that a row's file is in; without it names must be unique."""
    parent = F.substring_index(F.substring_index("path", "/", -2), "/", 1)
    f = files.select(F.substring_index("path", "/", -1).alias("arquivo_em_disco"), parent.alias("pasta_em_disco"), "path", F.col("length").alias("tamanho"), F.sha2("content", 256).alias("sha256"))
    same = F.col("arquivo") == F.col("arquivo_em_disco")
    rows = index.join(f, same & (F.col(folder) == F.col("pasta_em_disco")) if folder else same, "left").drop("pasta_em_disco")
    none = F.col("arquivo").isNull() | (F.col("arquivo") == "")
    state = F.when(none, "restrito").when(F.col("path").isNull(), "ausente_no_disco").when(F.lower("arquivo").endswith(".zip"), "zip").otherwise("file")
    return rows.withColumn("status_origem", state).drop("arquivo_em_disco")


def expand_zips(files: DataFrame, depth: int = ZIP_DEPTH) -> DataFrame:
    """files: path, content. Members of archives and of archives in them, with the archives they came through. A bad outer archive has no
    members, a bad inner one is an error. Archives are spread by Spark; one is opened by one task."""

    def members(data: bytes, lineage: list[str]) -> Iterator[tuple[str, list[str], bytes]]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                inner = z.read(info)
                if info.filename.lower().endswith(".zip") and len(lineage) < depth:
                    yield from members(inner, [*lineage, info.filename])
                else:
                    yield info.filename, lineage, inner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if not zipfile.is_zipfile(io.BytesIO(data)):
                    continue
                for name, lineage, inner in members(data, []):
                    yield pa.record_batch(
                        [pa.array([path]), pa.array([name]), pa.array([lineage], pa.list_(pa.string())), pa.array([len(lineage) + 1], pa.int32()), pa.array([inner], pa.binary())],
                        names=["zip_caminho", "zip_membro", "zip_lineage", "profundidade", "content"],
                    )

    return files.select("path", "content").mapInArrow(run, "zip_caminho string, zip_membro string, zip_lineage array<string>, profundidade int, content binary")


def corpus_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of corpus JSON files, with the corpus version."""
    item = "document_id string, document_version string, family_id string, version_date string, version_date_source string, document_type string, processo_numero string, text string, source_pdf_relpath string"
    rows = spark.read.schema(f"provisional boolean, corpus_version string, documents array<struct<{item.replace(' string', ':string')}>>").option("multiLine", True).json(path)
    return rows.select("corpus_version", F.explode("documents").alias("d")).select("corpus_version", "d.*")


def with_texts(documents: DataFrame, texts: DataFrame, expected: int | None = None) -> DataFrame:
    """documents: name, ...; texts: name, text. Joined; another number of rows than expected is an error."""
    out = documents.drop("text").join(texts, "name")
    if expected is not None and out.count() != expected:
        raise ValueError(f"expected {expected} documents")
    return out


def markdown_corpus(spark: SparkSession, documents: DataFrame, folder: str, corpus_version: str, expected: int | None = None) -> DataFrame:
    """documents: of ``corpus_documents``. Their texts are those of the Markdown files that stand where source_pdf_relpath says, with .md for .pdf, below the folder. Another number
    of documents than expected, a document without a path, and one without a file are errors."""
    if expected is not None and (n := documents.count()) != expected:
        raise ValueError(f"expected {expected} documents, found {n}")
    inner = re.sub(r"^file:/+", "/", folder.rstrip("/"))
    at = F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^.*?" + re.escape(inner) + "/", "")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("value").alias("found"), at.alias("at"))
    met = documents.withColumn("at", F.regexp_replace("source_pdf_relpath", r"\.pdf$", ".md")).join(files, "at", "left")
    why = F.when(F.coalesce("source_pdf_relpath", F.lit("")) == "", "no path of: ").otherwise("no file of: ")
    text = F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.raise_error(F.concat(why, F.col("document_version"))).cast("string"))
    return met.withColumns({"text": text, "corpus_version": F.lit(corpus_version)}).select(*documents.columns)


def relations(spark: SparkSession, path: str) -> DataFrame:
    e = "source_id:string,source_kind:string,target_id:string,target_kind:string,type:string,origin:string,status:string,evidence:struct<document_version:string,locator:string>"
    rows = spark.read.schema(f"provisional boolean, relations array<struct<{e}>>").option("multiLine", True).json(path)
    return rows.select(F.explode("relations").alias("r")).select("r.*").select("*", F.col("evidence.document_version").alias("evidence_document_version"), F.when(F.col("evidence").isNotNull(), F.coalesce("evidence.locator", F.lit(""))).alias("evidence_locator")).drop("evidence")


def declared_hits(spark: SparkSession, path: str) -> DataFrame:
    """query and its hits in order; an alias has its target's hits and takes the place of a query of its name."""
    hit = "family_id:string,document_version:string,chunk_id:string,excerpt:string,score:double"
    rows = spark.read.schema(f"aliases map<string,string>, queries map<string,array<struct<{hit}>>>").option("multiLine", True).json(path)
    queries = rows.select(F.explode("queries").alias("query", "hits"))
    aliases = rows.select(F.explode("aliases").alias("alias", "target"))
    named = aliases.join(queries, F.col("target") == F.col("query"), "left").select(F.col("alias").alias("query"), "hits")
    own = queries.join(aliases, F.col("query") == F.col("alias"), "left_anti")
    return own.unionByName(named).select("query", F.posexplode("hits").alias("pos", "h")).select("query", "pos", "h.*")


def embedding_cache(spark: SparkSession, paths: list[str], dims: int) -> DataFrame:
    """text and embedding of cache files: JSON lines, or one query as a JSON document. Tombstones are skipped, vectors of another length are an
    error, and the last file and line win."""
    parts = []
    for i, path in enumerate(paths):
        single = path.endswith(".json")
        rows = spark.read.schema("query string, text string, embedding array<double>, _tombstone string").option("multiLine", single).json(path)
        parts.append(rows.where("_tombstone IS NULL").select(F.coalesce("query", "text").alias("text"), "embedding", F.struct(F.lit(i).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at")))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    last = all_.groupBy("text").agg(F.max_by("embedding", "at").alias("embedding"))
    fits = F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector has not {dims} numbers")).cast("array<double>"))
    return last.select("text", fits.alias("embedding"))


def embed_cached(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows: text. Their vectors; a text without one is an error."""
    hit = rows.join(cache, "text", "left")
    return hit.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no vector for: "), F.col("text"))).cast("array<double>")))


def markdown_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table, without its header and rule."""
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.trim("value").startswith("|")).select(cells.alias("c"))
    rows = rows.where(~F.forall("c", lambda c: c.rlike(r"^:?-{3,}:?$")) & (F.get("c", F.lit(0)) != columns[0]))
    return rows.select(*[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def fetch_plan(documents: DataFrame, locator: str = "locator") -> DataFrame:
    """What is to be done with each locator: metadata only, download or copy."""
    at = F.lower(F.col(locator))
    action = F.when(at.startswith("missing://") | at.startswith("metadata://"), "metadata_only").when(at.startswith("http://") | at.startswith("https://"), "download").otherwise("copy")
    return documents.withColumn("action", action)


def source_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Complete documents of a source manifest, and the incomplete ones with what they lack."""
    item = ",".join(f"{c}:string" for c in SOURCE_COLUMNS)
    rows = spark.read.schema(f"documents array<struct<{item}>>").option("multiLine", True).json(path).select(F.explode("documents").alias("d")).select("d.*")
    lacks = F.filter(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(c)) for c in SOURCE_COLUMNS]), lambda x: x.isNotNull())
    checked = rows.withColumn("lacks", lacks)
    return checked.where(F.size("lacks") == 0).drop("lacks"), checked.where(F.size("lacks") > 0)


def form_feed_pages(texts: DataFrame, key: str, text: str, pages: Column) -> DataFrame:
    """Pages of whole-document text; another number of pages than told is an error."""
    parts = F.split(F.regexp_replace(text, "\f$", ""), "\f")
    safe = F.when(F.size(parts) == pages, parts).otherwise(F.raise_error(F.concat(F.lit("pages differ: "), F.col(key).cast("string"))).cast("array<string>"))
    return texts.select(key, F.posexplode(safe).alias("i", "text")).select(key, (F.col("i") + 1).alias("page"), "text")


def page_images(listing: DataFrame, key: str, text: str) -> DataFrame:
    """page, width, height, x_ppi and y_ppi from an image listing (a header, a rule, then one image a line); masks of images are none."""
    lines = listing.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).where("i >= 2")
    c = lines.select(key, F.split(F.trim("line"), r"\s+").alias("c")).where((F.size("c") >= 14) & (F.get("c", F.lit(2)) == "image"))
    n = lambda i: F.get("c", F.lit(i)).try_cast("int")
    return c.select(key, n(0).alias("page"), n(3).alias("width"), n(4).alias("height"), n(12).alias("x_ppi"), n(13).alias("y_ppi")).where("page IS NOT NULL")


def scanned_pages(images: DataFrame, sizes: DataFrame, key: str, share: float = 0.6, ppi: int = 150) -> DataFrame:
    """Pages of which an image at ``ppi`` or more covers ``share``. sizes: key, page, width_pt, height_pt."""
    area = (F.col("width") / F.col("x_ppi") * 72) * (F.col("height") / F.col("y_ppi") * 72)
    both = images.join(sizes, [key, "page"])
    return both.where((F.least("x_ppi", "y_ppi") >= ppi) & (area >= share * F.col("width_pt") * F.col("height_pt"))).select(key, "page").distinct()


def degraded_pages(pages: DataFrame, scanned: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Pages with few characters or that are scans, for recognition instead of extraction."""
    s = scanned.select(key, "page", F.lit(True).alias("scan"))
    return pages.join(s, [key, "page"], "left").withColumn("degraded", (F.length(F.regexp_replace("text", r"(?U)\s", "")) < least) | F.coalesce("scan", F.lit(False))).drop("scan")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as when a file is loaded into a dictionary."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def tombstones(versions: DataFrame, seq: Column, version: str = "version") -> DataFrame:
    """Log rows that delete versions: each version once, with the sequence number from which on it is gone."""
    return versions.select(version).distinct().select(seq.alias("seq"), F.lit("tombstone").alias("op"), version)


def fetched(plan: DataFrame, results: DataFrame) -> DataFrame:
    """plan: of fetch_plan, with version_id; results: version_id, bytes, error. A row for each document: metadata_only, downloaded or failed."""
    met = plan.join(results.select("version_id", "bytes", "error"), "version_id", "left")
    status = F.when(F.col("action") == "metadata_only", "metadata_only").when(F.col("error").isNull() & F.col("bytes").isNotNull(), "downloaded").otherwise("failed")
    return met.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", F.coalesce("error", F.lit("no result"))))


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def request_log(requests: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON line for each request; a missing field is a hyphen."""
    return requests.select(F.to_json(F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("-")).alias(f) for f in fields])).alias("value"))


def download_manifest(documents: DataFrame) -> DataFrame:
    """Families with their versions, newest first, and a timeline as text."""
    rows = F.sort_array(F.collect_list(F.struct("document_date", "version_id", "document_type")), asc=False)
    out = documents.groupBy("family_id", "family_label").agg(rows.alias("versions"))
    return out.withColumn("timeline", F.array_join(F.transform("versions", lambda v: F.concat_ws(" ", v["document_date"], v["version_id"], v["document_type"])), "\n"))
