"""Operators for training corpora, held against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessel.llm import _bpe, _text, decontamination, hmm_scoring, language_id, mixing, ngram_jaccard, quality, simple8b, token_counts, toxicity, warc
from tessel.llm._store import Workspace

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, k string"
rng = np.random.default_rng(0)
VOCABULARY = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(VOCABULARY[i] for i in np.minimum(r.zipf(1.3, n), 400) - 1)


@pytest.fixture(scope="module")
def texts():
    base = prose(120, 1).split()
    near = [" ".join(base[:i] + ["zz"] + base[i + 1 :]) for i in (3, 60, 100)]
    return [prose(120, 1), prose(120, 1), *near, prose(90, 2), prose(3, 3), prose(3, 3), "One", "", "  \n\t ", None, "Ünï çödé £ — ñ x <|endoftext|> y", "a\x00b c", "word " * 30, prose(9000, 4), "x" * 70000, "A b\nA b\nc", "# * $ % & | < >", "idiot you are an idiot"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "s1", "s2", "é"][i % 4], None, 0.0, "x") for i, t in enumerate(texts)]
    rows += [rows[3], (None, "no key", "de", "s1", 1, 0.0, "x")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


# words and hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t\x0b\x1c z", max_size=30)), max_size=8))
def test_words(texts):
    hashes, first = _text.words_of(pa.array(texts, pa.string()))
    want = [words((t or "").translate(LOWER)) for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want]
    flat = [w for t in want for w in t]
    assert len(set(hashes.tolist())) == len(set(flat)) and len({*zip(hashes.tolist(), flat)}) == len(set(flat))


# 1


def brute_components(rows, k, num, den):
    sets, up = {}, {}
    for i, t in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        up[i] = i

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components(spark, docs, texts, k, num, den):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_components(spark, docs, Workspace(spark, "t"), k, num, den).collect()}
    want = brute_components(list(enumerate(texts)), k, num, den)
    assert got.pop(None)[1] is None
    assert got == want


def test_many_near_copies(spark):
    base = prose(150, 9).split()
    rows = []
    for i in range(700):  # more than one block; some are as far as the limit from each other
        r = np.random.default_rng(i)
        w = list(base)
        for p in r.integers(0, 150, 1 + i % 5):
            w[p] = f"w{r.integers(0, 50)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.ngram_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), Workspace(spark, "t")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows, 4, 85, 100).items()}


def test_tree_loses_no_pair():
    r = np.random.default_rng(3)
    sets = []
    for i in range(150):
        s = set(r.integers(0, 2**63, 60, dtype=np.uint64).tolist()) if i % 3 == 0 else set(list(sets[-1])[: int(r.integers(50, 60))]) | set(r.integers(0, 2**63, int(r.integers(0, 8)), dtype=np.uint64).tolist())
        sets.append(s)
    n = np.array([len(s) for s in sets])
    bits = np.zeros((150, ngram_jaccard.BITS), bool)
    for i, s in enumerate(sets):
        bits[i, [x % ngram_jaccard.BITS for x in s]] = True
    packed = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    p, q = ngram_jaccard.Tree(n, packed, np.arange(150)).pairs(85, 100)
    found = set(zip(p.tolist(), q.tolist()))
    for a in range(150):
        for b in range(a + 1, 150):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                assert (a, b) in found


def test_components_of_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["c"] for r in ngram_jaccard.components(links, Workspace(spark, "t"), "x").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# 2


def test_token_counts(spark, docs, texts):
    path = P.path(token_counts.TOKENIZER)
    t = _bpe.load(path)
    for chunk, overlap in ((32768, 512), (200, 20)):
        got = token_counts.token_counts(docs, path, chunk=chunk, overlap=overlap).collect()
        for r in got:
            x = (texts[r["doc_id"]] if r["doc_id"] is not None else "no key") or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)), x[:40]


_BITS = [*"ab\t\x0b\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000\x00_½ﬁ\u200b\ufeff", " ", " ", "  ", "\n", "\n\n", "\n\n\n", " \n", "\r\n", "<|endoftext|>", "<|", "Word", "don't", "'s", " 'll", "élan", "e\u0301", "ß", "ΑΣ", "İ", "日本", "12", "...", "!?", "#%&", "x" * 40, " the"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_BITS), max_size=12).map("".join), max_size=40))
def test_pieces_give_what_the_library_gives(texts):
    """Pieces cut at white space of all kinds, encoded one by one, against whole texts, for both tokenizers."""
    path, other = P.path(simple8b.TOKENIZER), P.path(token_counts.TOKENIZER)
    got = [x.tolist() for ids, n in simple8b._encoded(pa.array(texts, pa.string()), _bpe.byte_level(path), 2, step=7) for x in np.split(ids, np.cumsum(n))[:-1]]
    assert got == [e.ids + [2] for e in _bpe.load(path).encode_batch(texts, add_special_tokens=False)]
    t = _bpe.load(other)
    _, _, size, units, off = _bpe.coded(pc.ascii_split_whitespace(pa.array(texts, pa.large_string())), _bpe.lower_case(other))
    upto = np.concatenate([[0], np.cumsum(size[units], dtype=np.int64)])
    whole = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert np.diff(upto[off]).tolist() == whole
    assert [len(token_counts.encode_long(t, x, 16, 4)) for x in texts] == whole


def test_long_texts_are_spliced():
    t = _bpe.load(P.path(token_counts.TOKENIZER))
    for x in (prose(3000, 5), "é " * 900, "it's <|endoftext|> " * 200, "y" * 3000, "a b" + " " * 900 + "c"):
        assert token_counts.encode_long(t, x, 300, 8).tolist() == t.encode(x, add_special_tokens=False).ids


# 3


def test_mixing(spark, docs, texts):
    out, plan = mixing.mix(spark, docs, Workspace(spark, "t"))
    rows = out.collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3.0 * sizes[s] for s in over)
        free -= over
    taken = collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert taken[s] == pytest.approx(target[s], rel=0.02, abs=2)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(spark, docs.repartition(5), Workspace(spark, "t"))[0].collect()))
    slots = plan.orderBy("position").collect()
    assert len({r["position"] for r in slots}) == len(slots)
    half = collections.Counter(r["sid"] for r in slots[: len(slots) // 2])
    whole = collections.Counter(r["sid"] for r in slots)
    assert all(abs(half[s] - whole[s] / 2) <= 0.02 * len(slots) + 2 for s in whole)


# 4


def test_automaton():
    a = toxicity.Automaton([("idiot", False, True), ("lowei", True, True), ("scum", False, True)])
    near = lambda x, y: x == y or len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1 or abs(len(x) - len(y)) == 1 and any((x if len(x) > len(y) else y)[:i] + (x if len(x) > len(y) else y)[i + 1 :] == (x if len(x) < len(y) else y) for i in range(max(len(x), len(y))))
    r = np.random.default_rng(1)
    for _ in range(3000):
        w = list("idiot")
        for _ in range(r.integers(0, 3)):
            p = int(r.integers(0, len(w) + 1))
            w[p : p + int(r.integers(0, 2))] = list("xdit"[: int(r.integers(0, 2))])
        w = "".join(w)
        assert (a.match(w) is not None) == near(w, "idiot"), w
    assert a.match("loweixyz") == (0, 1) and a.match("scuum") is None and a.match("") is None


def test_toxicity(spark, docs, none):
    r = np.random.default_rng(2)
    rows, marks = [], []
    for i in range(400):
        bad = i % 8 == 0
        w = prose(60, 1000 + i).split()
        for _ in range(2 * bad):
            w.insert(int(r.integers(0, 60)), ["moronix", "trashy"][int(r.integers(0, 2))])
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad), 1))
    rows += [(400, None), (401, ""), (402, "he said \"moronix\" was the word"), (403, "moronixx"), (404, "you moronix moronix")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    got = {x["doc_id"]: x for x in toxicity.toxicity(spark, d, labels, Workspace(spark, "t"), F.col("doc_id") % 3 != 1).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    held = [i for i in range(400) if i % 3 == 1]
    assert np.mean([(got[i]["score"] >= 0.7) == (i % 8 == 0) for i in held]) > 0.98
    assert got[402]["n_quoted"] == 1 and got[402]["score"] < got[404]["score"] and got[403]["n_misspelled"] == 1
    assert got[400]["score"] == got[401]["score"] < 0.7
    assert toxicity.toxicity(spark, none, labels, Workspace(spark, "t")).count() == 0
    assert toxicity.toxicity(spark, docs, labels.where("doc_id < 0"), Workspace(spark, "t")).count() == docs.count()


# 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 2**16), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 70))
def test_simple8b(ids, block):
    x = np.array(ids, np.uint64)
    packed, starts = simple8b.pack(x, block)
    assert simple8b.unpack_blocks(packed, starts, len(x), block).tolist() == ids
    keys, sizes, back = simple8b.from_file(simple8b.to_file([None, 5], np.array([len(ids), 0]), x, block))
    assert keys == [None, 5] and sizes.tolist() == [len(ids), 0] and back.tolist() == ids


def test_token_files(spark, docs, texts, none):
    path = P.path(simple8b.TOKENIZER)
    t = _bpe.load(path)
    got = sorted(simple8b.encode_documents(spark, docs, path).collect(), key=lambda r: r["start"])
    start, order = 0, [None, 0, 1, 2, 3, 3, *range(4, len(texts))]
    assert [r["doc_id"] for r in got] == order
    for r in got:
        x = (texts[r["doc_id"]] if r["doc_id"] is not None else "no key") or ""
        ids = np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert simple8b.encode_documents(spark, none, path).count() == 0


# 6


def test_warc(spark):
    long, short = "<p>" + "x" * 200, "<p>"
    rows = [(5, "u5", long), (2, "u2", long), (9, None, long), (1, "u1", short), (3, "u3", short), (4, "u\r\n4", None), (2, "u2", long), (None, "n", long), (7, "u7", "é" * 60), (8, "u8", "é" * 60)]
    got = warc.archive_pages(spark, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit(1))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] in (1, 3, 4):
            assert (r["record_type"], r["refers_to"]) == ("response", None)
        assert r["record_type"] == "response" or r["refers_to"] in (2, 7)
    assert collections.Counter(r["record_type"] for r in got) == {"response": 5, "revisit": 5}
    assert {r["payload_digest"] for r in got if r["page_id"] == 4} == {hashlib.sha256(b"").hexdigest()}
    assert warc.archive_pages(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 7


def test_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    r = np.random.default_rng(5)
    for _ in range(200):
        a, b = r.integers(0, 6, r.integers(1, 20)), r.integers(0, 6, r.integers(0, 40))
        assert decontamination.common_subsequence(a, b) == slow(a.tolist(), b.tolist())


def test_leaks(spark, docs, none):
    r = np.random.default_rng(8)
    items = [(i, " ".join(f"t{x}" for x in r.integers(0, 5000, 30)) + ". final " + f"answer{i}.") for i in range(5)] + [(90, None), (91, ""), (92, "  ")]
    rows = []
    for i in range(200):
        w = " ".join(f"t{x}" for x in r.integers(0, 5000, 150)).split()
        if i % 10 == 0:
            item = items[(i // 10) % 5][1].upper().split()
            if i % 20 == 0:  # a paraphrase: some words go, some come
                item = [x for j, x in enumerate(item) if j % 7 != 3]
                item.insert(5, "extra")
            w[40:40] = item
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame([*rows, (500, None), (501, ""), rows[0]], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(spark, d, b, Workspace(spark, "t"), items=4).collect()}
    assert got == {(i, (i // 10) % 5) for i in range(0, 200, 10)}
    assert decontamination.leaks(spark, none, b, Workspace(spark, "t")).count() == 0
    assert decontamination.leaks(spark, docs, b.where("item_id > 50"), Workspace(spark, "t")).count() == 0


def test_leaks_of_all_lengths(spark):
    """Whole copies of items of 5 to 2000 words, and of items full of repeated words, are all found; of paraphrases at least 0.9 of those that brute force finds."""
    r = np.random.default_rng(21)
    common, rare = [f"c{x}" for x in range(60)], [f"r{x}" for x in range(20000)]
    prose_ = lambda n: [rare[r.integers(20000)] if r.random() < 0.4 else common[r.integers(60)] for _ in range(n)]
    sizes = [5, 12, 30, 60, 65, 100, 180, 220, 300, 400, 600, 1000, 2000]
    items = [prose_(n) for n in sizes] + [(["chorus", "line"] * 6 + prose_(8)) * 3] + [prose_(int(n)) for n in r.integers(20, 400, 60)]
    rows, whole, changed = [], set(), []
    for i in range(240):
        w = prose_(int(r.integers(100, 300)))
        at = int(r.integers(len(w)))
        if i < len(items):
            w[at:at] = items[i]
            whole.add((i, i))
        elif i < 2 * len(items):
            q = i - len(items)
            part = [x if r.random() > 0.12 else "changed" for x in items[q]]
            w[at:at] = part
            changed.append((i, q, [(x or "") for x in w]))
        rows.append((i, " ".join(w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(q, " ".join(x)) for q, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.leaks(spark, d, b, Workspace(spark, "t"), items=64).collect()}
    assert whole <= got
    number = {x: k for k, x in enumerate({x for _, _, w in changed for x in w} | {x for w in items for x in w})}
    code = lambda w: np.array([number[x] for x in w])
    wanted = {(i, q) for i, q, w in changed if any(decontamination.common_subsequence(code(items[q]), code(w[a : a + math.ceil(1.25 * len(items[q]))])) >= decontamination.SURE * len(items[q]) for a in range(0, len(w), max(1, len(items[q]) // 8)))}
    assert len(wanted) > 50 and len(wanted & got) >= 0.9 * len(wanted), (len(wanted), len(wanted - got), sorted((len(items[q]), q) for _, q in wanted - got))
    assert all(i == q or i == q + len(items) for i, q in got)
    print("recall", len(wanted & got), len(wanted))


# 8


def brute_likelihood(model, symbols):
    total = 0.0

    def walk(t, state, p):
        nonlocal total
        p *= model.emit[state, symbols[t]]
        if t + 1 == len(symbols):
            total += p
            return
        for s in range(len(model.start)):
            walk(t + 1, s, p * model.moves[state, s])

    for s in range(len(model.start)):
        walk(0, s, model.start[s])
    return math.log(total)


def test_forward_and_counts():
    m = hmm_scoring.Model.first(np.array([0.5, 0.3, 0.2]), 3)
    seqs = [[0, 1, 2, 2, 0], [1, 1], [2]]
    flat, sizes = np.array([x for s in seqs for x in s]), np.array([5, 2, 1])
    log = hmm_scoring.forward(m, flat, np.cumsum(sizes) - sizes, sizes, False)[0]
    assert log == pytest.approx([brute_likelihood(m, s) for s in seqs])
    first, moves, emit = hmm_scoring.expected_counts(m, flat, np.cumsum(sizes) - sizes, sizes)
    assert first.sum() == pytest.approx(3) and moves.sum() == pytest.approx(5) and emit.sum(axis=0) == pytest.approx(np.bincount(flat))


def test_hmm_scores(spark, docs, texts, none):
    d = docs.select("doc_id", "text", (F.coalesce(F.col("doc_id"), F.lit(0)) % 5 != 1).alias("train"))
    got = hmm_scoring.score(spark, d, Workspace(spark, "t"), rounds=2).collect()
    every = [(r["doc_id"], (texts[r["doc_id"]] if r["doc_id"] is not None else "no key")) for r in got]
    c = collections.Counter()
    for i, t in every:
        if (i or 0) % 5 != 1:
            c.update([*words((t or "").translate(LOWER)), None])
    n, floor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for (i, t), r in zip(every, got):
        w = [*words((t or "").translate(LOWER)), None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / floor) for x in w))
        assert r["score"] < 0
    assert hmm_scoring.score(spark, none.select("doc_id", "text", F.lit(True).alias("train")), Workspace(spark, "t")).count() == 0
    alone = hmm_scoring.score(spark, d.withColumn("train", F.lit(False)), Workspace(spark, "t"))
    assert alone.agg(F.sum("n_known")).first()[0] == 0


# 9


def test_languages(spark, docs, none):
    r = np.random.default_rng(4)
    kinds = {"aa": ["tha", "wer", "ing", "sho"], "bb": ["çon", "eux", "rée", "qui"], "cc": ["шар", "мол", "коt", "дом"]}
    rows = [(i, " ".join("".join(r.choice(kinds[k], r.integers(1, 4))) for _ in range(20)), k) for i, k in enumerate(list(kinds) * 40)]
    d = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "aa"), (902, "", None), rows[5]], "doc_id long, text string, lang string")
    langs, bundles = language_id.learn_prototypes(d.where("doc_id % 4 <> 2"))
    assert langs == ["aa", "bb", "cc"]
    got = {x["doc_id"]: x for x in language_id.predict(d, langs, bundles).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows)
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (900, 901, 902))
    assert all(0 <= x["score"] <= 1 for x in got.values())
    langs, bundles = language_id.learn_prototypes(none)
    assert {x["lang_pred"] for x in language_id.predict(docs, langs, bundles).collect()} == {"und"}


# 10


def test_quality(spark, docs, texts, none):
    got = quality.judge(spark, docs, Workspace(spark, "t")).collect()
    assert len(got) == docs.count()
    for r in got:
        t = (texts[r["doc_id"]] if r["doc_id"] is not None else "no key") or ""
        w = words(t)
        n = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)), t[:30]
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])  # the references are too small to speak
    assert quality.judge(spark, none, Workspace(spark, "t")).count() == 0


def test_divergence(spark):
    d = spark.createDataFrame([([1, 0], [1.0, 0.0]), ([1, 0], [0.0, 1.0]), ([0, 0], [0.5, 0.5])], "n array<long>, q array<double>")
    assert [r[0] for r in d.select(quality.js_distance(F.col("n"), F.col("q"))).collect()] == [0.0, 1.0, None]
