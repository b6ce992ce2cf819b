"""Whole operators against plain Python on small tables, where SQL can't express them; and empty tables."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import decontamination, hmm_scoring, language_id, mixing, ngram_jaccard, quality, token_counts, toxicity, warc
from tessel.llm._store import Workspace

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_scores(spark):
    """Prototypes and cosines from dictionaries of trigrams, each bound letter by letter."""
    r = np.random.default_rng(3)
    make = lambda letters: " ".join("".join(r.choice(list(letters), r.integers(2, 7))) for _ in range(30)) + ", 12 É!"
    rows = [(i, make(x), k) for i, (k, x) in enumerate([("aa", "abcdeé"), ("bb", "cdefgh"), ("cc", "шарбde")] * 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letters = {}

    def vector(c):
        if c not in letters:
            letters[c] = np.random.default_rng([language_id.SEED, 0 if c == " " else ord(c)]).integers(0, 2, language_id.DIM, dtype=np.int8).astype(int) * 2 - 1
        return letters[c]

    def bundle(text):
        s = " " + re.sub(r"[^\w]|[\d_]", " ", text.lower()) + " "
        s = re.sub(" +", " ", s)
        return sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(s, s[1:], s[2:]))

    unit = lambda v: v / np.linalg.norm(v)
    names = ["aa", "bb", "cc"]
    prototypes = np.array([unit(sum(bundle(t) for i, t, k in rows if k == name and i % 4 != 2)) for name in names])
    mean = unit(prototypes.mean(axis=0))
    centred = np.array([unit(p - (p @ mean) * mean) for p in prototypes])
    got = {x["doc_id"]: x for x in language_id.predict(d, *language_id.learn_prototypes(d.where("doc_id % 4 <> 2"))).collect()}
    for i, t, _ in rows:
        v = bundle(t)
        cosine = centred @ unit(v - (v @ mean) * mean)
        assert got[i]["lang_pred"] == names[int(np.argmax(cosine))] and got[i]["score"] == pytest.approx(np.clip(cosine.max(), 0, 1), abs=1e-4)


def test_quality_verdict(spark):
    """Histograms, Jensen-Shannon distances and verdicts, character by character."""
    r = np.random.default_rng(5)
    usual = {"en": ["the", "and", "whatever", "because", "of"], "xx": ["þau", "ekki", "vegna", "sem", "hvernig"]}
    rows = []
    for i in range(130):
        lang = ["en", "xx"][i % 2]
        words = [usual[lang][r.integers(5)] if r.random() < 0.5 else "".join(r.choice(list("abcdefgh"), r.integers(2, 9))) for _ in range(700)]
        if i % 13 == 0:
            words = ["#%&" + str(r.integers(10**6)) + "ÄÖ" for _ in range(120)]
        rows.append((i, " ".join(w.capitalize() + "." if r.random() < 0.1 else w for w in words) + "\n", lang))
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "", None), rows[1]], "doc_id long, text string, lang string")

    def classes(t):
        n = collections.Counter()
        for c in t:
            kind = "lower" if "a" <= c <= "z" else "space" if c == " " else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "break" if c in "\t\n\x0b\f\r" else "mark" if c in ".,;:!?'\"()-" else "wide" if c > "\x7f" else "sign"
            n[kind] += 1
        return [n[k] for k in quality.CLASSES]

    every = [*rows, (900, "", "en"), (901, "", None), rows[1]]
    counts = collections.defaultdict(collections.Counter)
    for _, t, lang in every:
        counts[lang].update(w.lower() for w in WORD.findall(t))
    top = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]] for k, c in counts.items()}

    def histogram(t, lang):
        n = collections.Counter(w.lower() for w in WORD.findall(t))
        own = [n[w] for w in top[lang]]
        return [*own, sum(n.values()) - sum(own)]

    def js(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(max(0, (kl(p) + kl(q)) / 2))

    ref = {k: (np.sum([classes(t) for _, t, x in every if x == k], axis=0), np.sum([histogram(t, k) for _, t, x in every if x == k], axis=0)) for k in ("en", "xx")}
    assert all(sum(h) >= quality.LEAST_REFERENCE for _, h in ref.values())
    got, refused = {x["doc_id"]: x for x in quality.judge(spark, d, Workspace(spark, "t")).collect()}, 0
    for i, t, lang in rows:
        a, b = js(classes(t), ref[lang][0]), js(histogram(t, lang), ref[lang][1])
        assert (got[i]["class_distance"], got[i]["word_distance"]) == (pytest.approx(a, abs=1e-9), pytest.approx(b, abs=1e-9))
        assert got[i]["kept"] == (not got[i]["base_failed"] and a <= quality.MOST_CLASS and b <= quality.MOST_WORD)
        refused += not got[i]["kept"] and not got[i]["base_failed"]
    assert refused == 10 and got[900]["class_distance"] is None


def test_hmm_likelihood_and_partitions(spark):
    """With one state the likelihood has a closed form; with more, scores don't depend on how the texts lie."""
    r = np.random.default_rng(9)
    rows = [(i, " ".join(f"W{x}" for x in np.minimum(r.zipf(1.4, r.integers(0, 300)), 900))) for i in range(60)] + [(60, None), (61, "never seen"), (62, "W1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") < 50)
    c = collections.Counter()
    for i, t in rows[:50]:
        c.update([*(t or "").lower().split(), None])
    n, width = sum(c.values()), len(c) + hmm_scoring._SUFFIXES
    share = lambda k: (k + hmm_scoring.STRENGTH * (k + 0.5) / (n + 0.5 * width)) / (n + hmm_scoring.STRENGTH)
    got = {x["doc_id"]: x["score"] for x in hmm_scoring.score(spark, d, Workspace(spark, "t"), states=1, rounds=1).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(sum(math.log10(share(c[w])) for w in [*(t or "").lower().split(), None]), rel=1e-9)
    one, five = ({x["doc_id"]: x["score"] for x in hmm_scoring.score(spark, d.repartition(k), Workspace(spark, "t"), rounds=2).collect()} for k in (1, 5))
    assert all(one[i] == pytest.approx(five[i], abs=1e-6) for i in one)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_toxic_hits(spark):
    """Hits of texts against edit distances to every term and a window read word by word."""
    terms = [("scum", False, True), ("idiot", False, True), ("mor", True, True), ("weakling", False, False), ("trash", False, True)]
    r = np.random.default_rng(2)
    pool = ["scum", "scun", "idiot", "idiott", "idot", "idoit", "moron", "mo", "weakling", "weaklin", "trash", "crash", "tras", "the", "said", '"idiot"', "(trash)", "a", "book", "»", "“", "”"]
    texts = [" ".join(r.choice(pool, r.integers(0, 25))) for _ in range(200)] + ["", None]

    def nearest(w):
        if w in {"crash"}:
            return None
        if w.startswith("mor"):
            return 0, 2
        found = [(k, i) for i, (t, stem, sure) in enumerate(terms) if not stem and (k := _distance(w, t)) <= int(len(t) >= toxicity.FUZZY and sure)]
        return min(found, default=None)

    def counts(text):
        words, n = (text or "").lower().split(), [0, 0, 0, 0]
        for i, w in enumerate(words):
            hit = nearest(w.strip(toxicity._EDGE))
            if hit:
                before, after = words[max(0, i - 8) : i], words[i + 1 : i + 9]
                marks = lambda xs: sum(x.count(q) for x in xs for q in toxicity._QUOTES)
                quoted = any(x.strip(toxicity._EDGE) in toxicity.REPORTING for x in before) or (marks([*before, w[:1]]) % 2 == 1 and marks([w[1:], *after]) > 0)
                n[3 if quoted else 2 if hit[0] else 0 if terms[hit[1]][2] else 1] += 1
        return tuple(n)

    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: tuple(x[c] for c in toxicity.COUNTS) for x in toxicity.hit_counts(d, terms, frozenset({"crash"})).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_warc_payloads(spark):
    """Long payloads come back whole, also those of revisits; a revisit without its response is an error."""
    long = "<p>" + "ä" * 300_000
    rows = [(1, "a", long), (2, "b", long), (3, "c", "x" * 150), (None, None, "y" * 150), (None, None, "y" * 150)]
    ws = Workspace(spark, "t")
    assert ws.save(warc.write_warc(warc.resolve_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), ws.path("w")), "m").count() > 0
    records = ws.save(warc.read_records(spark, ws.path("w"), True), "r")
    back = warc.read_warc(records, True).collect()
    assert sorted(((x["page_id"], x["payload_bytes"], hashlib.sha256(x["payload"]).hexdigest() == x["payload_digest"], x["refers_to"]) for x in back), key=str) == sorted(((i, len(t.encode()), True, 1 if i == 2 else None) for i, _, t in rows), key=str)
    assert {(x["page_id"], bytes(x["payload"]).decode()) for x in back} == {(i, t) for i, _, t in rows}
    assert collections.Counter(x["record_type"] for x in back) == {"response": 3, "revisit": 2}
    with pytest.raises(Exception, match="revisit without its response"):
        warc.read_warc(records.where("record_type = 'revisit' OR page_id = 3")).collect()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert ngram_jaccard.ngram_components(spark, none, Workspace(spark, "t")).count() == 0
    assert token_counts.token_counts(none, P.path(token_counts.TOKENIZER)).count() == 0
    assert mixing.mix(spark, none, Workspace(spark, "t"))[0].count() == 0
    long = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30_000)) + " needle in this very long haystack of words today")], "doc_id long, text string")
    item = spark.createDataFrame([(7, "needle in this very long haystack of words today")], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontamination.leaks(spark, long, item, Workspace(spark, "t")).collect()] == [(1, 7)]


def test_empty_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
