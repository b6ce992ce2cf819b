"""Token ids in Simple-8b: each 64-bit word holds a 4-bit selector and as many ids of one width as 60 bits take.

File layout (little-endian): magic ``S8BT``, u32 ids per block, u64 documents, u64 ids, u64 blocks; i64 key of each document and a
byte that says whether it is null; u32 ids of each document; u64 first word of each block, and one more; then the words. A block
holds ``BLOCK`` ids (the last fewer) and can be decoded alone. Selector 1 is the escape: the next word is one id of up to 64 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import _bpe
from tessel.llm._files import write_file
from tessel.llm._store import Workspace, table

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
BLOCK, FILE_IDS, _GROUP = 4096, 1 << 22, 64
_HEAD = struct.Struct("<4sIQQQ")
#: Fixed values of the Simple-8b format: selector, ids in a word, bits of an id; densest first.
SELECTORS = ((2, 60, 1), (3, 30, 2), (4, 20, 3), (5, 15, 4), (6, 12, 5), (7, 10, 6), (8, 8, 7), (9, 7, 8), (10, 6, 10), (11, 5, 12), (12, 4, 15), (13, 3, 20), (14, 2, 30), (15, 1, 60))
ESCAPE = 1
_COUNT = np.zeros(16, np.int64)
for _s, _c, _w in SELECTORS:
    _COUNT[_s] = _c
_COUNT[ESCAPE] = 1


_SHORT = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0."""
    if ids.size == 0 or int(ids.max()) < len(_SHORT):
        return _SHORT[ids]
    bits = np.zeros(ids.shape, np.uint8)
    for k in range(1, 65):
        over = ids >= ids.dtype.type(1 << (k - 1)) if k <= 8 * ids.itemsize else np.False_
        if not over.any():
            break
        bits += over
    return bits


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks, and where each block begins (one more than blocks). All blocks advance together, a word a step."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    blocks, span = -(-n // block), block + 64
    grid = np.zeros((blocks, span), ids.dtype)
    whole = n // block
    grid[:whole, :block] = ids[: whole * block].reshape(whole, block)
    grid[whole:, : n - whole * block] = ids[whole * block :]
    bits = _widths(grid)
    choice = np.full((blocks, span), ESCAPE, np.uint8)
    widest, reach = bits.copy(), 1
    for selector, count, width in reversed(SELECTORS):
        while reach < count:
            widest[:, : span - reach] = np.maximum(widest[:, : span - reach], bits[:, reach:])
            reach += 1
        choice[widest <= width] = selector
    flat, chosen = grid.reshape(-1), choice.reshape(-1)
    length = np.minimum(block, n - np.arange(blocks) * block)
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    rows, places = [], []
    while len(live):
        rows.append(live)
        places.append(p := live * span + at)
        at = at + _COUNT[chosen[p]]
        more = at < length[live]
        live, at = live[more], at[more]
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(rows, kind="stable")
    rows, places = rows[order], places[order]
    s = chosen[places].astype(np.int64)
    wide = np.where(s == ESCAPE, 2, 1)
    to = np.cumsum(wide) - wide
    words = np.zeros(int(wide.sum()), np.uint64)
    for selector, count, width in SELECTORS:
        own = np.flatnonzero(s == selector)
        if len(own):
            word = np.full(len(own), selector << 60, np.uint64)
            for j in range(count):
                word |= flat[places[own] + j].astype(np.uint64) << np.uint64(j * width)
            words[to[own]] = word
    own = np.flatnonzero(s == ESCAPE)
    words[to[own]] = np.uint64(ESCAPE << 60)
    words[to[own] + 1] = flat[places[own]]
    starts = np.zeros(blocks + 1, np.int64)
    np.add.at(starts, rows + 1, wide)
    return words, np.cumsum(starts)


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The first n ids of one block, or of blocks that hold ``BLOCK`` ids each; see unpack_blocks."""
    s = (words >> np.uint64(60)).astype(np.int64)
    if (s == ESCAPE).any():  # the words behind an escape are no selectors
        keep, i = [], 0
        while i < len(words):
            keep.append(i)
            i += 2 if s[i] == ESCAPE else 1
        keep = np.array(keep)
    else:
        keep = np.arange(len(words))
    s = s[keep]
    count = _COUNT[s]
    to = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for selector, c, width in SELECTORS:
        own = np.flatnonzero(s == selector)
        if len(own):
            word, mask = words[keep[own]], np.uint64((1 << width) - 1)
            for j in range(c):
                out[to[own] + j] = (word >> np.uint64(j * width)) & mask
    own = np.flatnonzero(s == ESCAPE)
    out[to[own]] = words[keep[own] + 1]
    return out[:n]


def unpack_blocks(words: np.ndarray, starts: np.ndarray, n: int, block: int = BLOCK, kind: str = "<u8") -> np.ndarray:
    out = np.empty(n, kind)
    for b in range(len(starts) - 1):
        size = min(block, n - b * block)
        out[b * block : b * block + size] = unpack(words[starts[b] : starts[b + 1]], size)
    return out


class TokenFile:
    """A file in the making. Ids are packed as soon as ``_GROUP`` blocks are full, so what is held is about as large as the file."""

    def __init__(self, block: int = BLOCK):
        self.block, self.keys, self.sizes, self.words, self.starts, self.open, self.ids = block, [], [], [], [np.zeros(1, np.int64)], [], 0
        self.waiting = 0

    def add(self, keys: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys += keys
        self.sizes.append(sizes)
        self.open.append(ids)
        self.ids += len(ids)
        self.waiting += len(ids)
        while self.waiting >= (full := self.block * _GROUP):
            flat = np.concatenate(self.open)
            self._pack(flat[:full])
            self.open, self.waiting = [flat[full:]], len(flat) - full

    def _pack(self, ids: np.ndarray) -> None:
        words, starts = pack(ids, self.block)
        self.words.append(words.astype("<u8").tobytes())
        self.starts.append(starts[1:] + self.starts[-1][-1])

    def data(self) -> bytes:
        if self.waiting:
            self._pack(np.concatenate(self.open))
            self.open, self.waiting = [], 0
        null = np.array([k is None for k in self.keys], np.uint8)
        known = np.array([k or 0 for k in self.keys], "<i8")
        sizes, starts = np.concatenate([np.zeros(0, np.int64), *self.sizes]), np.concatenate(self.starts)
        head = _HEAD.pack(b"S8BT", self.block, len(self.keys), self.ids, len(starts) - 1)
        return b"".join([head, known.tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), *self.words])


def to_file(keys: list, sizes: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    file = TokenFile(block)
    file.add(list(keys), np.asarray(sizes), ids)
    return file.data()


def from_file(data: bytes, kind: str = "<u8") -> tuple[list, np.ndarray, np.ndarray]:
    """Keys, ids of each document, and all ids."""
    magic, block, docs, n, blocks = _HEAD.unpack_from(data)
    if magic != b"S8BT":
        raise ValueError("no token file")
    at = _HEAD.size
    known = np.frombuffer(data, "<i8", docs, at)
    null = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs)
    sizes = np.frombuffer(data, "<u4", docs, at := at + docs).astype(np.int64)
    starts = np.frombuffer(data, "<u8", blocks + 1, at := at + 4 * docs).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(starts[-1]), at + 8 * (blocks + 1))
    return [None if z else int(k) for k, z in zip(known, null)], sizes, unpack_blocks(words, starts, n, block, kind)


def _encoded(texts: pa.Array, words: _bpe.Words, end_id: int, step: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For ``step`` texts at a time the ids of all, each text with the end, and how many each text has."""
    flat, begin, size, pieces, off = _bpe.coded(_bpe.byte_level_pieces(texts), words)
    for a in range(0, len(texts), step):
        bounds = off[a : a + step + 1]
        own = pieces[bounds[0] : bounds[-1]]
        ids, upto = _bpe.ranges(flat, begin[own], size[own]), np.concatenate([[0], np.cumsum(size[own], dtype=np.int64)])
        ends = upto[bounds - bounds[0]]
        yield np.insert(ids, ends[1:], np.uint32(end_id)), np.diff(ends) + 1


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK, stored_order: bool = False) -> DataFrame:
    """Writes files ``part-<partition>-<number>.s8b`` in ascending order of the key (nulls first, ties by text), and returns one row
    for each: file, docs, n_ids. With ``stored_order`` (docs as read from Parquet) documents keep the order of their files, by name, and
    rows. Keys are cast to long. Null texts are empty; each document ends with ``end_id``; rows that repeat are written each; an empty
    table gives no file; extra columns are not written. Nothing is written until the result is used; use it once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, number, file = _bpe.byte_level(tokenizer_path), TaskContext.get().partitionId(), 0, TokenFile(block)

        def close():
            nonlocal file, number
            name = f"part-{part:06d}-{number:05d}.s8b"
            write_file(folder, name, file.data())
            row = pa.record_batch({"file": [name], "docs": pa.array([len(file.keys)], pa.int64()), "n_ids": pa.array([file.ids], pa.int64())})
            file, number = TokenFile(block), number + 1
            return row

        for batch in batches:
            for cut in _bpe.slices(batch, 1):
                keys, done = cut.column(0).to_pylist(), 0
                for ids, sizes in _encoded(cut.column(1), words, end_id):
                    ends, a, b = np.cumsum(sizes), 0, 0
                    while a < len(sizes):  # a file ends with the document that fills it
                        before = ends[a - 1] if a else 0
                        b = min(len(sizes), int(np.searchsorted(ends, before + file_ids - file.ids)) + 1)
                        file.add(keys[done + a : done + b], sizes[a:b], ids[before : ends[b - 1]])
                        if file.ids >= file_ids:
                            yield close()
                        a = b
                    done += len(sizes)
        if file.keys:
            yield close()

    cols = [docs[key].cast("long").alias("k"), docs[text].alias("t")]
    if stored_order:
        rows, order = docs.select(*cols, F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r")), ["f", "r"]
    else:
        rows, order = docs.select(*cols), ["k"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "t").select("k", "t")
    return rows.mapInArrow(write, "file string, docs long, n_ids long")


def read_tokens(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """file, key, place (order in the file), at (ids before it in the file), n_tokens and ids_crc32 of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1)):
                keys, sizes, ids = from_file(data.as_buffer(), "<u4")
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.record_batch(
                    {
                        "file": pa.array([path.as_py().rpartition("/")[2]] * len(keys), pa.string()),
                        "k": pa.array(keys, pa.int64()),
                        "place": pa.array(np.arange(len(keys), dtype=np.int64)),
                        "at": pa.array(ends - sizes, pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")
    return files.mapInArrow(read, "file string, k long, place long, at long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, stored_order: bool = False) -> DataFrame:
    """Writes the token files to the shared folder, reads them back, and returns doc_id, start, n_tokens and ids_crc32."""
    ws = Workspace(spark, "tokens")
    written = ws.save(write_tokens(docs, ws.path("ids"), tokenizer_path, end_id, stored_order=stored_order), "manifest")
    before = written.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("before"))
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    back = read_tokens(spark, ws.path("ids"))
    return back.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


QUERIES = {"op5_token_files": op5_token_files}
ORACLE: dict[str, str] = {}
