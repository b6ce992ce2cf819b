"""Encoding of many short pieces with the tokenizers library, each distinct piece once per worker."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessel.llm import _text

_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARKS = ".,;:!?"
#: Letters that no rule composes and that have one lower-case letter each: Latin-1 and Extended A and B, without U+0130.
_LATIN = "\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{24f}"
#: Bytes that byte-level BPE writes as themselves; the others follow from U+0100 on.
_SAME = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = dict(zip([b for b in range(256) if b not in set(_SAME)], range(256, 512)))
_LETTERS.pop(10)  # parts words
_SHORT = 48
_TABLES = [[np.random.default_rng(n).integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (256, _SHORT)] for n in (71, 72)]


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Words:
    """Encodes distinct pieces. A piece that is a word of Latin letters (behind at most one space, if the tokenizer is byte-level) and marks is
    taken apart, and the word goes straight to the tokenizer's model; any other piece goes through the whole tokenizer.

    Ids of short pieces are remembered under two hashes, of 64 and 32 bits, in arrays. Beyond ``most`` pieces those that were met least
    (long ago counting less) are forgotten; with that, a worker holds some 30 MB.
    """

    def __init__(self, tokenizer, lower: bool, most: int = 1 << 19):
        self.t, self.lower, self.most = tokenizer, lower, most
        self.simple = f"^{'' if lower else ' ?'}[A-Za-z{_LATIN}]+$"
        self.key, self.check, self.begin, self.size, self.met, self.ids = (np.zeros(0, k) for k in ("u8", "u4", "i8", "i4", "i4", "u4"))
        tokenizer.model._resize_cache(0)  # each distinct word comes once, so the library's own memory only costs

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all distinct pieces, and for each piece where its own begin and how many they are."""
        begin, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int32)
        length = pc.binary_length(pieces).to_numpy()
        short = np.flatnonzero((length > 0) & (length <= _SHORT))
        key, check = _hashes(pieces.take(pa.array(short)))
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        hit = (self.key[at] == key) & (self.check[at] == check) if len(self.key) else np.zeros(len(key), bool)
        begin[short[hit]], size[short[hit]] = self.begin[at[hit]], self.size[at[hit]]
        self.met[at[hit]] += 1
        miss = np.setdiff1d(np.flatnonzero(length > 0), short[hit], assume_unique=True)
        values = self._fresh(pieces.take(pa.array(miss)))
        size[miss] = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin[miss] = len(self.ids) + np.cumsum(size[miss]) - size[miss]
        flat = np.concatenate([self.ids, np.frombuffer(b"".join(values), "<u4")])
        new = short[~hit]
        key, check = np.concatenate([self.key, key[~hit]]), np.concatenate([self.check, check[~hit]])
        begins, sizes, met = np.concatenate([self.begin, begin[new]]), np.concatenate([self.size, size[new]]), np.concatenate([self.met, np.ones(len(new), np.int32)])
        if len(key) > self.most:
            keep = np.sort(np.argsort(-met, kind="stable")[: self.most // 2])
            key, check, begins, sizes, met = key[keep], check[keep], begins[keep], sizes[keep], met[keep] // 2
        order = np.argsort(key)
        self.key, self.check, self.size, self.met = key[order], check[order], sizes[order], met[order]
        self.ids = ranges(flat, begins[order], self.size)
        self.begin = np.cumsum(self.size, dtype=np.int64) - self.size
        return flat, begin, size

    def _fresh(self, pieces: pa.Array) -> list[bytes]:
        bare = pc.ascii_rtrim(pieces, characters=_MARKS)
        simple = pc.match_substring_regex(bare, self.simple)
        words = pc.if_else(simple, pc.utf8_lower(bare) if self.lower else bare, pieces).dictionary_encode()
        simple, code, names = simple.to_numpy(zero_copy_only=False), words.indices.to_numpy(), words.dictionary.to_pylist()
        plain = np.zeros(len(names), bool)
        plain[code] = simple
        values = [b""] * len(names)
        for own, encode in ((np.flatnonzero(plain), self._model), (np.flatnonzero(~plain), self._whole)):
            for i, v in zip(own.tolist(), encode([names[i] for i in own])):
                values[i] = v
        out = [values[c] for c in code.tolist()]
        size = pc.binary_length(bare).to_numpy()
        marked = np.flatnonzero(simple & (pc.binary_length(pieces).to_numpy() > size)).tolist()
        ends = [p.as_py()[n:] for p, n in zip(pieces.cast(pa.large_binary()).take(pa.array(marked, pa.int64())), size[marked].tolist())]
        tails = dict.fromkeys(ends)
        tails = dict(zip(tails, self._whole([x.decode() for x in tails])))
        for i, x in zip(marked, ends):
            out[i] += tails[x]
        return out

    def _model(self, words: list[str]) -> list[bytes]:
        joined = "\n".join(words)
        letters = joined.replace(" ", "Ġ") if joined.isascii() else joined.encode().decode("latin-1").translate(_LETTERS)
        return _as_bytes([[x.id for x in t] for t in map(self.t.model.tokenize, letters.split("\n"))]) if words else []

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [v for a in range(0, len(pieces), 1000) for v in _as_bytes([e.ids for e in self.t.encode_batch_fast(pieces[a : a + 1000], add_special_tokens=False)])]


def _hashes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each piece of 1 to _SHORT bytes."""
    data, off = _text.raw_bytes(pieces)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    key, check = (np.add.reduceat(np.take(t[0], data) * np.take(t[1], place), off[:-1]) for t in _TABLES)
    return _text.mix(key), (_text.mix(check) >> np.uint64(32)).astype(np.uint32)


def ranges(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of all ranges, one behind the other."""
    upto = np.cumsum(size, dtype=np.int64)
    return values[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]


def _as_bytes(ids: list[list[int]]) -> list[bytes]:
    data, at = np.array(list(chain.from_iterable(ids)), "<u4").tobytes(), 0
    return [data[at : (at := at + 4 * len(x))] for x in ids]


_SPACES = "\\t-\\r \\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Texts in which cutting at each space and line end would part a run of white space; also what has a special token's brackets.
_ODD = f"[{_SPACES}]{{3}}|[{_SPACES}]{{2}}$|\\x00|<\\|"


def spaced_pieces(text: str) -> list[str]:
    """Cuts before each space that stands between two other characters: a byte-level pretokeniser always cuts there."""
    return _CUT.split(text)


def byte_level_pieces(texts: pa.Array) -> pa.Array:
    """The pieces of each text, to be encoded one by one.

    Of a run of white space before a word, a byte-level pretokeniser sets the last character apart and joins a space to the word, so runs of
    one or two characters can be cut at every space and line end. Texts with longer runs, or two at the end, are cut with more care.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.if_else(odd, "", texts)
    cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\x00 "), "\n", "\x00\n\x00"), "\x00")
    if not pc.any(odd).as_py():
        return cut
    some = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    own = pa.array([spaced_pieces(x) for x in texts.take(pa.array(some)).to_pylist()], cut.type)
    at = np.arange(len(texts))
    at[some] = len(texts) + np.arange(len(some))
    return pa.concat_arrays([cut, own]).take(pa.array(at))


def coded(pieces: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids; where those of each distinct piece begin and how many they are; the pieces of all texts by number; and the pieces before each text."""
    off = pieces.offsets.to_numpy().astype(np.int64)
    flat = pieces.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
    return *words.encode(flat.dictionary), flat.indices.to_numpy(), off - off[0]


def slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, a = np.cumsum(size, dtype=np.int64), 0
    while a < batch.num_rows:
        before = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(a, b - a)
        a = b


@functools.cache
def byte_level(path: str) -> Words:
    """One for each worker."""
    return Words(load(path), False)


@functools.cache
def lower_case(path: str) -> Words:
    return Words(load(path), True)
