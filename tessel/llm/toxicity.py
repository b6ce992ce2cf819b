"""Toxicity by a learned lexicon whose trie is intersected with Levenshtein automata.

Learning. From labelled texts the document frequencies of words and of word beginnings ("stems" of 3 to 7 letters) are counted
apart for toxic and other texts, a text once however often it is copied. Terms are all with a log-likelihood ratio of at least
``LEAST_G2``, a toxic share of at least ``LEAST_SHARE`` and no broader term beside them. Terms whose share is below
``SURE_SHARE`` are weak. Misspellings are words within one edit of a sure word of ``FUZZY`` letters or more, also of one that a stem
covers. Words that match so but stand in ``LEAST_DOCS`` learned texts or more, with a toxic share below ``LEAST_SHARE``, are ordinary
words and are excepted. A logistic regression is fitted on four counts of a text: hits,
hits of weak terms, misspelled hits, and hits in quotation; each speaks by its logarithm, which stops rising at ``CUT`` hits (all hits are
counted). For the fit the lexicon comes from one half of the learned texts and the
counts from the other, so that it sees how the lexicon does on texts that it was not made of; the final lexicon is made of all.

Scoring. Every distinct word runs through the automaton once per worker. Each hit is judged in a window of ``WINDOW`` words: between
quotation marks, or behind a word of reporting, it counts as quoted. The score is the fitted probability.

Null and empty texts have no hits and get the score of such texts. Rows that repeat count each in the regression and once in the
lexicon (once on either side if they are labelled both ways); a null label teaches nothing; no toxic label at all gives an empty lexicon and a constant score. Labels, languages, sources and keys are not read when scoring.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table

LEAST_G2, LEAST_SHARE, SURE_SHARE, LEAST_DOCS = 20.0, 0.35, 0.9, 4
STEMS, FUZZY, WINDOW, CUT, THRESHOLD, RIDGE = (3, 4, 5, 6, 7), 5, 8, 4, 0.7, 0.05
PRIOR = (4.0, 1.0, 2.0, 0.5)
COUNTS = ("n_hits", "n_weak", "n_misspelled", "n_quoted")
_EDGE = ".,;:!?\"'()[]{}<>*#$%&|/\\-_~`^+=“”„«»‘’…"
_QUOTES = "\"“”„«»"
#: Words that report what someone else said.
REPORTING = frozenset("said says say wrote writes called quote quoted quoting according reported dit écrit selon sagte schrieb laut dijo escribió según".split())


class Automaton:
    """The words within an edit distance of a lexicon, read letter by letter.

    A state is a set of pairs (trie node, edits so far); states are made when first reached and kept. A stem's last node accepts
    whatever follows, if it was reached without edits; words that go on behind it or end there have their own edits.
    """

    def __init__(self, terms: list[tuple[str, bool, bool]], fuzzy: int = FUZZY):
        self.next, self.end, self.stem, self.edits = [{}], {}, {}, [0]
        for number, (term, is_stem, sure) in enumerate(terms):
            node, most = 0, int(len(term) >= fuzzy and sure and not is_stem)
            for c in term:
                if c not in self.next[node]:
                    self.next.append({})
                    self.edits.append(0)
                    self.next[node][c] = len(self.next) - 1
                self.edits[node] = max(self.edits[node], most)
                node = self.next[node][c]
            self.edits[node] = max(self.edits[node], most)
            if is_stem:
                self.stem.setdefault(node, number)
            else:
                self.end.setdefault(node, (number, most))
        self.made: dict[frozenset, list] = {}
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set) -> list | None:
        todo, held = list(pairs), set(pairs)
        while todo:  # letters of the term that the word leaves out
            node, k = todo.pop()
            if k < self.edits[node]:
                for to in self.next[node].values():
                    if (to, k + 1) not in held and k + 1 <= self.edits[to]:
                        held.add((to, k + 1))
                        todo.append((to, k + 1))
        if not held:
            return None
        key = frozenset(held)
        if key not in self.made:
            found = min(((k, self.end[n][0]) for n, k in held if n in self.end and k <= self.end[n][1]), default=None)
            stuck = min(((k, self.stem[n]) for n, k in held if n in self.stem and k == 0), default=None)
            self.made[key] = [found, {}, key, stuck]
        return self.made[key]

    def _step(self, state: list, c: str) -> list | None:
        out = set()
        for node, k in state[2]:
            to = self.next[node].get(c)
            if to is not None:
                out.add((to, k))
            if k < self.edits[node]:
                out.add((node, k + 1))
                out.update((x, k + 1) for x in self.next[node].values() if k + 1 <= self.edits[x])
        state[1][c] = new = self._state(out)
        return new

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first of equals."""
        state = self.start
        for c in word:
            if state[3] is not None:
                return state[3]
            to = state[1].get(c, 0)
            state = self._step(state, c) if to == 0 else to
            if state is None:
                return None
        return state[3] or state[0]


def count_features(learn: DataFrame) -> DataFrame:
    """feature ("word" or "stem*"), toxic and other: in how many texts of each kind it stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (Counter(), Counter())

        def out():
            names = list(kinds[0].keys() | kinds[1].keys())
            rows = pa.record_batch({"feature": pa.array(names, pa.string()), "toxic": pa.array([kinds[1][x] for x in names], pa.int64()), "other": pa.array([kinds[0][x] for x in names], pa.int64())})
            kinds[0].clear(), kinds[1].clear()
            return rows

        held = 0
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in (x.strip(_EDGE) for x in set((text or "").lower().split())) if w}
                kinds[bool(toxic)].update(words)
                kinds[bool(toxic)].update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
                held += sum(map(len, words))
                if len(kinds[0]) + len(kinds[1]) > 150_000 or held > 16 << 20:
                    yield out()
                    held = 0
        if kinds[0] or kinds[1]:
            yield out()

    parts = learn.select("text", "toxic").mapInArrow(count, "feature string, toxic long, other long")
    return parts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _uncovered(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """rows: feature, toxic and other, strongest first, with the same first letters. Those without a broader term beside them, and covered
    words that can be misspelled."""
    chosen: dict[str, tuple[int, int]] = {}
    below: Counter = Counter()  # toxic texts of the chosen by their beginnings

    def add(feature: str, sign: int) -> None:
        name = feature.removesuffix("*")
        below.update({name[:n]: sign * chosen[feature][0] for n in STEMS if n <= len(name)})

    for feature, toxic, other in rows:
        is_stem, name = feature.endswith("*"), feature.removesuffix("*")
        if any(f"{name[:n]}*" in chosen for n in STEMS if n <= len(name)):
            continue
        if is_stem and below[name] * 1.5 >= toxic:
            continue
        for x in [x for x in chosen if x.startswith(name)] if is_stem else ():
            add(x, -1)
            del chosen[x]
        chosen[feature] = toxic, other
        add(feature, 1)
    fuzzy = [x for x in rows if x[0] not in chosen and not x[0].endswith("*") and len(x[0]) >= FUZZY and x[1] >= SURE_SHARE * (x[1] + x[2])]
    return [(x, *n) for x, n in chosen.items()] + fuzzy


def strongest(features: DataFrame, n_toxic: int, n_other: int) -> list[tuple[str, bool, bool]]:
    """All terms, strongest first: (letters, is a stem, is sure). Features that a stem can cover share its first three letters and so are judged together."""
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    share = n_toxic / max(n_toxic + n_other, 1)
    term = lambda x, p: F.when(x > 0, x * F.log(x / ((a + b) * p))).otherwise(0.0)
    g2 = 2 * (term(a, max(share, 1e-9)) + term(b, max(1 - share, 1e-9)))
    kept = features.where((a >= LEAST_DOCS) & (a / (a + b) >= LEAST_SHARE)).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)

    def judge(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["g2"], r["feature"].endswith("*"), -len(r["feature"]), r["feature"]))
        strength = {r["feature"]: r["g2"] for r in rows}
        return pa.Table.from_pylist([{"feature": x, "toxic": n, "other": m, "g2": strength[x]} for x, n, m in _uncovered([(r["feature"], r["toxic"], r["other"]) for r in rows])], pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("other", pa.int64()), ("g2", pa.float64())]))

    chosen = kept.groupBy(F.substring("feature", 1, min(STEMS)).alias("head")).applyInArrow(lambda t: judge(t.select(["feature", "toxic", "other", "g2"])), "feature string, toxic long, other long, g2 double")
    rows = sorted(chosen.collect(), key=lambda r: (-r["g2"], r["feature"].endswith("*"), -len(r["feature"]), r["feature"]))
    return [(r["feature"].removesuffix("*"), r["feature"].endswith("*"), r["toxic"] >= SURE_SHARE * (r["toxic"] + r["other"])) for r in rows]


class Reader:
    """Finds the hits of texts; remembers the lately met words that are none, up to ``most`` characters twice over."""

    def __init__(self, terms: list[tuple[str, bool, bool]], ordinary: frozenset, most: int = 1 << 20):
        self.terms, self.automaton, self.ordinary, self.hits = terms, Automaton(terms), ordinary, {}
        self.none, self.before, self.held, self.most = set(), set(), 0, most

    def counts(self, text: str | None) -> tuple[int, int, int, int]:
        """Hits, hits of weak terms, misspelled hits and quoted hits."""
        words = (text or "").lower().split()
        if len(self.hits) > 50_000:
            self.hits = {}
        new = set(words).difference(self.none)
        own = new.intersection(self.hits)
        if self.held > self.most:
            self.none, self.before, self.held = set(), self.none, 0
        for w in new.difference(own):
            found = None
            if w not in self.before:
                bare = w.strip(_EDGE)
                found = self.automaton.match(bare) if bare not in self.ordinary else None
            if found is None:
                self.none.add(w)
                self.held += len(w)
            else:
                self.hits[w] = found
                own.add(w)
        if not own:
            return 0, 0, 0, 0
        n = [0, 0, 0, 0]
        for i, w in enumerate(words):
            if w in own:
                edits, term = self.hits[w]
                n[3 if self._quoted(words, i) else 2 if edits else 0 if self.terms[term][2] else 1] += 1
        return tuple(n)

    @staticmethod
    def _quoted(words: list[str], i: int) -> bool:
        before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
        if any(w.strip(_EDGE) in REPORTING for w in before):
            return True
        opened = sum(w.count(q) for w in (*before, words[i][:1]) for q in _QUOTES)
        closed = sum(w.count(q) for w in (words[i][1:], *after) for q in _QUOTES)
        return opened % 2 == 1 and closed > 0


def _near_words(features: DataFrame, terms: list[tuple[str, bool, bool]]) -> frozenset:
    """Ordinary words that look like a misspelling of a term: at most what lies within one edit of the terms."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(terms)
        for batch in batches:
            found = [w for w in batch.column(0).to_pylist() if (m := automaton.match(w)) and m[0]]
            yield pa.record_batch({"w": pa.array(found, pa.string())})

    n = F.col("toxic") + F.col("other")
    ordinary = features.where(~F.col("feature").endswith("*") & (n >= LEAST_DOCS) & (F.col("toxic") < LEAST_SHARE * n))
    return frozenset(r["w"] for r in ordinary.select("feature").mapInArrow(near, "w string").collect())


def hit_counts(docs: DataFrame, terms: list[tuple[str, bool, bool]], ordinary: frozenset, keep_text: bool = False) -> DataFrame:
    """The columns of docs (the text only if asked for) and the four counts. Columns of docs with their names, or ``score``, give way."""
    others = [c for c in docs.columns if c not in (*COUNTS, "score") and (c != "text" or keep_text)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, ordinary)
        for batch in batches:
            n = [reader.counts(x) for x in batch.column(0).to_pylist()]
            cols = [pa.array([x[j] for x in n], pa.int64()) for j in range(4)]
            yield pa.record_batch([*batch.columns[1:], *cols], names=[*(f"k{j}" for j in range(len(others))), *COUNTS])

    kept = "".join(f"k{j} {docs.schema[c].dataType.simpleString()}, " for j, c in enumerate(others))
    found = docs.select("text", *(F.col(c).alias(f"k{j}") for j, c in enumerate(others))).mapInArrow(find, kept + ", ".join(f"{c} long" for c in COUNTS))
    return found.withColumnsRenamed({f"k{j}": c for j, c in enumerate(others)})


def fit(cells: list[tuple[tuple[int, ...], int, int]]) -> list[float]:
    """Ridge logistic regression on (counts, texts, toxic texts), by Newton's method; at most (CUT + 1) ** 4 cells."""
    if not cells:
        return [-3.0, *PRIOR]
    x = np.array([[1.0, *(np.log1p(c[0]))] for c in cells])
    n, y = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    prior, penalty = np.array([np.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), *PRIOR]), np.diag([1e-6, *[RIDGE] * len(PRIOR)])
    b = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - n * p) - penalty @ (b - prior))
        b = b + np.clip(step, -2, 2)
    return b.tolist()


def probability(b: list[float]) -> Column:
    z = F.lit(b[0])
    for k, c in zip(b[1:], COUNTS):
        z = z + F.lit(k) * F.log1p(F.least(F.col(c), F.lit(CUT)).cast("double"))
    return 1 / (1 + F.exp(-z))


def _lexicon(learn: DataFrame) -> tuple[list[tuple[str, bool, bool]], frozenset]:
    totals = {r["toxic"]: r["n"] for r in learn.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(True):
        return [], frozenset()
    ws = Workspace(learn.sparkSession, "features")
    features = ws.save(count_features(learn).where(F.col("toxic") + F.col("other") >= LEAST_DOCS), "features")  # fewer texts decide nothing
    terms = strongest(features, totals[True], totals.get(False, 0))
    ordinary = _near_words(features, terms) if terms else frozenset()
    ws.drop("features")
    return terms, ordinary


def learn_model(learn: DataFrame) -> tuple[list[tuple[str, bool, bool]], frozenset, list[float]]:
    """learn: text, toxic, n (rows of the text). The terms, the ordinary words near them, and the coefficients."""
    half = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2))
    held = [F.least(F.col(c), F.lit(CUT)).alias(c) for c in COUNTS]
    cells = hit_counts(learn.where(half == 1).select("text", "toxic", "n"), *_lexicon(learn.where(half == 0))).groupBy(*held).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("toxic") > 0, F.col("n")).otherwise(0)).alias("y"))
    b = fit(sorted((tuple(r[c] for c in COUNTS), r["n"], r["y"]) for r in cells.collect()))
    return *_lexicon(learn), b


def distinct_texts(learn: DataFrame) -> DataFrame:
    """learn: text, toxic. One row for each text and kind: text, toxic (0 or 1) and n, its rows."""
    return learn.groupBy(F.sha2("text", 256).alias("h"), (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")).select("text", "toxic", "n")


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, ws: Workspace, learned: Column | None = None, keep_text: bool = False) -> DataFrame:
    """The columns of docs (the text only if asked for), the four counts and score. learned: which rows' labels may be used."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("i"), "toxic")
    rows = docs.where(learned) if learned is not None else docs
    learn = ws.save(distinct_texts(rows.select("doc_id", "text").join(marks.hint("merge"), F.col("doc_id") == F.col("i")).select("text", "toxic")), "learn")
    terms, ordinary, b = learn_model(learn)
    ws.drop("learn")
    return hit_counts(docs, terms, ordinary, keep_text).withColumn("score", probability(b))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    out = toxicity(spark, docs.select("doc_id", "text", held.alias("held_out")), table(spark, sf_dir, "labels"), Workspace(spark, "toxicity"), ~F.col("held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *COUNTS)


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}
