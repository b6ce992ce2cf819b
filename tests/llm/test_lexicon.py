"""The toxic lexicon on copies, quotations and covered words; leaks of long items."""

import numpy as np

from tessel.llm import decontamination, toxicity
from tessel.llm._store import Workspace


def test_copies_do_not_fill_the_lexicon(spark):
    r = np.random.default_rng(3)
    letters = lambda n: ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(n)]
    plain = letters(300)
    rows = [(" ".join(r.choice(plain, 30)) + (" moronix" if i % 20 == 0 else ""), int(i % 20 == 0)) for i in range(400)]
    rows += [(" ".join(letters(600)), 1)] * 50
    learn = toxicity.distinct_texts(spark.createDataFrame(rows, "text string, toxic int"))
    assert learn.agg({"n": "sum"}).first()[0] == len(rows)
    assert [t for t, _, _ in toxicity._lexicon(learn)[0]] == ["moronix"]
    many = spark.createDataFrame([(x, 30, 0) for x in letters(5000)], "feature string, toxic long, other long")
    assert len(toxicity.strongest(many, 1000, 100000)) == many.distinct().count()


def test_long_items_leak(spark):
    r = np.random.default_rng(4)
    words = lambda n: [f"t{x}" for x in r.integers(0, 20000, n)]
    items = [words(400), words(1500), words(30)]
    rows = [words(900) for _ in range(40)]
    for i, w in enumerate(rows[:6]):
        w[100 + 7 * i : 100 + 7 * i] = items[i % 3]
    rows[6][50:50] = items[0][:200]  # half of an item is no leak
    rows[7][300:300] = [x for j, x in enumerate(items[0]) if j % 6]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["lcs_share"] for x in decontamination.leaks(spark, d, b, Workspace(spark, "t")).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 0), (4, 1), (5, 2), (7, 0)}
    assert min(got[i, i % 3] for i in range(6)) > 0.99


def test_one_quotation_excepts_no_misspelling(spark):
    r = np.random.default_rng(6)
    plain = ["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for _ in range(300)]
    rows = [(" ".join(r.choice(plain, 30)) + (f" moronix grubby{'xyz'[i // 20 % 3]} grubby" if i % 10 == 0 else " motonix" if i % 10 == 1 else ""), int(i % 10 == 0)) for i in range(400)]
    rows.append(("someone called him moronlx", 0))
    terms, ordinary = toxicity._lexicon(toxicity.distinct_texts(spark.createDataFrame(rows, "text string, toxic int")))
    assert "moronlx" not in ordinary and "motonix" in ordinary
    reader = toxicity.Reader(terms, ordinary)
    assert reader.counts("you moronlx") == (0, 0, 1, 0) and reader.counts("the motonix") == (0, 0, 0, 0)


def test_covered_words_keep_their_edits():
    rows = [("lowei*", 60, 0), ("loweing", 40, 0), ("loweind", 10, 9)]
    assert toxicity._uncovered(rows) == rows[:2]
    a = toxicity.Automaton([("lowei", True, True), ("loweing", False, True)])
    assert a.match("loweixx") == (0, 0) and a.match("lxweing") == (1, 1) and a.match("lxweixx") is None and a.match("lxwei") is None
