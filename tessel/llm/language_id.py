"""Language identification with hyperdimensional profiles.

Each letter has a random vector of ``DIM`` signs. A letter trigram is bound as rotate(rotate(a)) * rotate(b) * c, a text is the
bundle (sum) of its trigrams, a language's prototype the bundle of its learned texts, and texts are compared with prototypes by
cosine. Prototypes are compared after taking away their mean direction, which all languages share.

Texts are lower-cased; every run of other characters than letters is one gap. A text that is null or has no letter is ``und``
with score 0, as is every text if nothing could be learned. Empty tables give no rows. Ties go to the first language by code point. Rows that repeat count
and are predicted each; extra columns are ignored; a null key is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm._store import table

DIM, SEED, UNKNOWN, MOST_LANGS = 1024, 11, "und", 4096
_GROUP, _TEXTS, _HELD = 250_000, 1024, 1 << 17  # characters and texts that are counted together; letters or trigrams that are remembered
_ALPHA = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536)
    out = _ALPHA[np.minimum(points, 65535)]
    for p in np.flatnonzero(points > 65535):
        out[p] = chr(points[p]).isalpha()
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers, the text that each belongs to, and for each text whether it has a letter."""
    padded = [f" {x.lower()} " for x in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    owner = np.repeat(np.arange(len(padded)), size)
    symbol = np.where(_is_letter(points), points, 0).astype(np.uint64)
    keep = symbol > 0
    keep[1:] |= symbol[:-1] > 0
    keep[(np.cumsum(size) - size)] = True
    symbol, owner = symbol[keep], owner[keep]
    letters = np.bincount(owner[symbol > 0], minlength=len(texts)) > 0
    if len(symbol) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    whole = owner[2:] == owner[:-2]
    code = (symbol[:-2] << np.uint64(42)) | (symbol[1:-1] << np.uint64(21)) | symbol[2:]
    return code[whole], owner[2:][whole], letters


class Space:
    """Vectors of letters and trigrams, computed when first needed."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed, self.known = dim, seed, {}

    def letters(self, points: np.ndarray, turn: int) -> np.ndarray:
        distinct, at = np.unique(points, return_inverse=True)
        if len(self.known) > _HELD:
            self.known = {}
        for p in distinct.tolist():
            if p not in self.known:
                self.known[p] = (np.random.default_rng([self.seed, p]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1)
        table_ = np.stack([np.roll(self.known[p], turn) for p in distinct.tolist()])
        return table_[at]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        low = np.uint64((1 << 21) - 1)
        a, b, c = codes >> np.uint64(42), (codes >> np.uint64(21)) & low, codes & low
        return self.letters(a, 2) * self.letters(b, 1) * self.letters(c, 0)


def _groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, x in enumerate(texts):
        if i > begin and (held + len(x) > _GROUP or i - begin == _TEXTS):
            yield begin, i
            begin, held = i, 0
        held += len(x)
    if begin < len(texts):
        yield begin, len(texts)


def learn_prototypes(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages by code point and their bundles. Tasks send one vector for each of their languages."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, counts = Space(dim, seed), {}, {}

        def add(name: str) -> None:
            held = counts.pop(name)
            codes, n = np.fromiter(held, np.uint64, len(held)), np.fromiter(held.values(), np.float64, len(held))
            total = sums.setdefault(name, np.zeros(dim))
            for i in range(0, len(codes), 4096):
                total += n[i : i + 4096] @ space.bind(codes[i : i + 4096])  # whole numbers, so exact in any order

        for batch in batches:
            texts, langs = [x or "" for x in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for a, b in _groups(texts):
                codes, owner, _ = trigrams(texts[a:b])
                names = sorted(set(langs[a:b]))
                number = np.array([names.index(x) for x in langs[a:b]])
                distinct, at = np.unique(codes, return_inverse=True)
                n = np.bincount(number[owner] * len(distinct) + at, minlength=len(names) * len(distinct)).reshape(len(names), -1)
                for name, row in zip(names, n):
                    seen = np.flatnonzero(row)
                    held = counts.setdefault(name, {})
                    for c, k in zip(distinct[seen].tolist(), row[seen].tolist()):
                        held[c] = held.get(c, 0) + k
                    if len(held) > _HELD:
                        add(name)
        for name in [*counts]:
            add(name)
        if sums:
            yield pa.record_batch({"lang": pa.array(list(sums)), "v": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang))
    parts = rows.mapInArrow(bundle, "lang string, v array<double>").select("lang", F.posexplode("v").alias("i", "x"))
    sums = parts.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    found = sums.select("lang", F.col("v.x").alias("v")).orderBy("lang").limit(MOST_LANGS + 1).collect()
    if len(found) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    return [r["lang"] for r in found], np.array([r["v"] for r in found], np.float64).reshape(len(found), dim)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def predict(docs: DataFrame, langs: list[str], bundles: np.ndarray, text: str = "text", dim: int = DIM, seed: int = SEED) -> DataFrame:
    """The columns of docs but the text, lang_pred and score (the cosine, at least 0). Columns of docs with these two names give way."""
    prototypes = _unit(bundles)
    mean = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(dim)
    mean = mean / (np.linalg.norm(mean) or 1)
    centred = _unit(prototypes - np.outer(prototypes @ mean, mean)).astype(np.float32)
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    held = [f"k{j}" for j in range(len(others))]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, axis = Space(dim, seed), mean.astype(np.float32)
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            names, scores = [], []
            for a, b in _groups(texts):
                codes, owner, letters = trigrams(texts[a:b])
                distinct, at = np.unique(codes, return_inverse=True)
                vectors = np.zeros((b - a, dim), np.float32)
                for i in range(0, len(distinct), 8192):
                    m = min(8192, len(distinct) - i)
                    own = (at >= i) & (at < i + m) if len(distinct) > 8192 else slice(None)
                    n = np.bincount(owner[own] * m + (at[own] - i), minlength=(b - a) * m).reshape(b - a, m)
                    vectors += n.astype(np.float32) @ space.bind(distinct[i : i + m]).astype(np.float32)
                vectors -= np.outer(vectors @ axis, axis)
                cosine = _unit(vectors) @ centred.T if langs else np.zeros((b - a, 1))
                best = np.argmax(cosine, axis=1)
                known = letters & bool(langs)
                names += [langs[j] if k else UNKNOWN for j, k in zip(best.tolist(), known)]
                scores += np.where(known, np.clip(cosine[np.arange(b - a), best], 0, 1), 0).tolist()
            yield pa.record_batch([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*held, "lang_pred", "score"])

    kept = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(held, others))
    out = docs.select(text, *(F.col(c).alias(k) for k, c in zip(held, others))).mapInArrow(score, f"{kept}lang_pred string, score double")
    return out.withColumnsRenamed(dict(zip(held, others)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    langs, bundles = learn_prototypes(docs.where(~held))
    return predict(docs.select("text", "doc_id", held.alias("held_out")), langs, bundles)


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
