"""WARC archives in which equal payloads are kept once and further captures are revisit records.

Payload digests are compared by a shuffle of headers alone, added up before it; for each digest the smallest page_id is the response. Pages
then meet their digest's decision, the pages of one digest dealt over ``SALTS`` tasks. Each record is a gzip member of its own; files begin
with a warcinfo record and are rolled at ``FILE_BYTES``. On reading, revisits are joined to the responses that they refer to and get
payload, length and digest from these; a damaged response, or a revisit whose response is missing or differs, is an error.

A null html is an empty payload. A null page_id sorts behind all others and is written without an X-Page-Id header; rows that
repeat a page_id are separate records, of which only one (the first by url) is the response. An empty table gives no archive and no rows. Extra
columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._files import write_file
from tessel.llm._store import Workspace, table

LEAST_BYTES, FILE_BYTES, SALTS, DATE = 100, 16 << 20, 16, "2024-01-01T00:00:00Z"
_NO_KEY = 2**63 - 1
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.UUID("7d5b0a52-5e0c-4b7e-9a55-1c7a0f0f6a01")


def record_id(page_id: int | None, digest: str, kind: str = "response", url: str | None = None, nth: int = 1) -> str:
    """nth: the number of the record among those that are equal in all else."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{kind} {page_id} {digest} {nth}' + ('' if url is None else f' {url}'))}>"


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, body (null for revisits), payload_bytes, payload_digest, record_type, refers_to, refers_url and nth (number among equal rows) of each page.

    Bodies move once, to meet their decision; equal pages without page_id are counted before they move.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("body")).select("page_id", "url", "body", F.sha2("body", 256).alias("payload_digest"), F.octet_length("body").cast("long").alias("payload_bytes"))
    k = F.coalesce("page_id", F.lit(_NO_KEY))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min(F.struct(k.alias("k"), "url")).alias("first"), F.count(F.lit(1)).alias("copies"))
    first = first.where(F.col("copies") > 1).select(F.col("payload_digest").alias("d"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")

    def decide(found: DataFrame) -> DataFrame:
        met = found.withColumn("salt", salt).withColumn("k", k).join(first, (F.col("payload_digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
        return met.withColumn("is_first", (F.col("k") == F.col("first.k")) & F.col("url").eqNullSafe(F.col("first.url")))

    nth = F.row_number().over(Window.partitionBy("payload_digest", "salt", "page_id", "url").orderBy(F.lit(0)))
    known = decide(rows.where(F.col("page_id").isNotNull())).withColumn("nth", nth)
    equal = rows.where(F.col("page_id").isNull()).groupBy("page_id", "url", "payload_digest", "payload_bytes").agg(F.first("body").alias("body"), F.count(F.lit(1)).alias("n"))
    nameless = decide(equal).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    found = known.unionByName(nameless).withColumn("response", F.col("first").isNull() | (F.col("is_first") & (F.col("nth") == 1)))
    revisit = ~F.col("response")
    return found.select(
        "page_id",
        "url",
        F.when(F.col("response"), F.col("body")).alias("body"),
        "payload_bytes",
        "payload_digest",
        F.when(F.col("response"), "response").otherwise("revisit").alias("record_type"),
        F.when(revisit & (F.col("first.k") < F.lit(_NO_KEY)), F.col("first.k")).alias("refers_to"),
        F.when(revisit, F.col("first.url")).alias("refers_url"),
        "nth",
    )


def _uri(url: str) -> str:
    return "".join(c if c.isprintable() else "%{:02X}".format(ord(c) & 255) for c in url)


def _record(head: list[tuple], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def info(name: str, date: str = DATE) -> bytes:
    """The record that a file begins with."""
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name, "warcinfo")), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(head, b"format: WARC File Format 1.1\r\n")


def render(page_id, url, body, payload_bytes, digest, kind, refers_to, refers_url, nth: int = 1, date: str = DATE) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest, kind, url, nth)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page_id is not None:
        head.append(("X-Page-Id", page_id))
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, url=refers_url)), ("WARC-Refers-To-Date", date)]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(refers_url)))
    else:
        http += body
    return _record([*head, ("Content-Type", "application/http; msgtype=response")], http)


def parse(data) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a file of gzip members."""
    rest = memoryview(data)
    while len(rest):
        z = zlib.decompressobj(31)
        raw = z.decompress(rest)
        rest = rest[len(rest) - len(z.unused_data) :] if z.unused_data else rest[:0]
        f = io.BytesIO(raw)
        if not f.readline().startswith(b"WARC/"):
            raise ValueError("no WARC record")
        head = {}
        while (line := f.readline().strip(b"\r\n")):
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        block = f.read(int(head["content-length"]))
        yield head, block.partition(b"\r\n\r\n")[2]


def write_warc(resolved: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``part-<partition>-<number>.warc.gz`` and returns one row (file, records, bytes) for each; use the result once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, got, held = TaskContext.get().partitionId(), 0, [], 0

        def close():
            nonlocal number, got, held
            name = f"part-{part:06d}-{number:05d}.warc.gz"
            write_file(folder, name, b"".join([gzip.compress(info(name), 3, mtime=0), *got]))
            row = pa.record_batch({"file": [name], "records": pa.array([len(got)], pa.int64()), "bytes": pa.array([held], pa.int64())})
            number, got, held = number + 1, [], 0
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                got.append(gzip.compress(render(*row), 3, mtime=0))
                held += len(got[-1])
                if held >= file_bytes:
                    yield close()
        if got:
            yield close()

    cols = ["page_id", "url", "body", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url", "nth"]
    rows = resolved.select(*cols).sortWithinPartitions("page_id", "url", "payload_digest", "record_type", "nth")
    return rows.mapInArrow(write, "file string, records long, bytes long")


def read_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Response and revisit records as they stand in the archives; a response's length and digest are those of its payload, which must be the
    digest of its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for head, payload in parse(data.as_buffer()):
                    kind, digest, n = head["warc-type"], head.get("warc-payload-digest", "").partition(":")[2], None
                    if kind not in ("response", "revisit"):
                        continue
                    if kind == "response":
                        n = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record {head['warc-record-id']}")
                    page = head.get("x-page-id")
                    rows.append((head["warc-record-id"], head.get("warc-refers-to"), len(rows) % SALTS, page and int(page), head.get("warc-target-uri"), n, digest, kind, payload if with_payload and n is not None else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["record", "refers", "salt", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "payload"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(read, "record string, refers string, salt int, page_id long, url string, payload_bytes long, payload_digest string, record_type string, payload binary")


def read_warc(records: DataFrame, with_payload: bool = False) -> DataFrame:
    """records: of read_records, written to a table, as they are used more than once. page_id, url, payload_bytes, payload_digest, record_type,
    refers_to (page_id of a revisit's response) and, if asked for, payload of each record."""
    revisits = records.where(F.col("record_type") == "revisit")
    wanted = revisits.select(F.col("refers").alias("w")).distinct()
    responses = records.where(F.col("record_type") == "response")
    found = responses.join(wanted, F.col("record") == F.col("w"), "left_semi")
    found = found.select(F.col("record").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"), F.col("payload").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    met = revisits.join(found, (F.col("refers") == F.col("r")) & (F.col("salt") == F.col("s")), "left")
    bad = F.raise_error(F.concat(F.lit("revisit without its response: "), "record"))
    kept = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    resolved = met.withColumn("payload_bytes", F.when(F.col("d").isNull() | (F.col("d") != F.col("payload_digest")), bad.cast("long")).otherwise(F.col("n")))
    resolved = resolved.withColumn("payload", F.col("p")).select(*kept)
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*kept).unionByName(resolved)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder and returns what reading them back gives."""
    ws = Workspace(spark, "warc")
    written = ws.save(write_warc(resolve_revisits(pages), ws.path("archives")), "manifest")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_warc(ws.save(read_records(spark, ws.path("archives")), "records"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark, table(spark, sf_dir, "pages")).drop("url")


QUERIES = {"op6_warc_revisits": op6_warc_revisits}
ORACLE = {
    "op6_warc_revisits": """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, url, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
      row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS FIRST) AS nth FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 100 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 100 OR nth = 1 THEN NULL ELSE first_id END AS refers_to FROM m""",
}
