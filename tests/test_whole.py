"""Whole jobs: every request, document and node."""

import numpy as np
import pytest

from tessel import catalogue
from tessel.operators import tiles


@pytest.mark.parametrize("by_label", [False, True])
@pytest.mark.parametrize("digits", [1, 6])
def test_nearest(spark, digits, by_label):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 3) / 4], int(r.integers(0, 6))) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0], 9), (302, [0.5, None, 0.5], 2), (303, [1.0, 0.0, 0.0], None)]
    v = spark.createDataFrame(rows, "id long, v array<float>, label int").repartition(3)
    got = tiles.nearest(v, v.select(v["id"].alias("request"), v["v"].alias("q")), 4, digits, False, by_label, tile_rows=40).collect()

    def brute(i, q):
        best = []
        for j, x, label in rows:
            ok = j != i and q is not None and x is not None and len(x) == len(q) and None not in x and None not in q
            s = sum(a * b for a, b in zip(q, x)) if ok else None
            if j != i:
                best.append((-np.inf if s is None else np.floor(abs(s) * 10**digits + 0.5) / 10**digits * (1 if s >= 0 else -1), j, label))
        out, seen = [], set()
        for s, j, label in sorted(best, key=lambda t: (-t[0], t[1])):
            if not by_label or label not in seen:
                seen.add(label)
                out.append((i, j, None if s == -np.inf else s + 0.0, label))
        return out[:4]

    want = {(i, n + 1): (j, s, label) for i, q, _ in rows for n, (_, j, s, label) in enumerate(brute(i, q))}
    assert {(x["request"], x["rank"]): (x["id"], x["score"], x["label"]) for x in got} == want


def test_headings_of_all_languages(spark, tmp_path):
    texts = [(1, "de", "Große Straße\nund zwei"), (2, None, "one\n12"), (3, "en", "a b"), (4, "fr", "mot"), (5, "de", "ab1\n" + "x" * 121)]
    spark.createDataFrame(texts, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(text):
        n = 0
        for line in (x.strip() for x in text.upper().split("\n")):
            letters = [c for c in line if c.isalpha()]
            n += 1 <= len(line) <= 120 and "  " not in line and len(letters) >= 3 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)
        return n

    want = {i: brute(t) for i, _, t in texts}
    assert {x["doc_id"]: x["n"] for x in catalogue.queries()["heading_lines_whole"](spark, str(tmp_path)).collect()} == {i: n for i, n in want.items() if n}
    pages = catalogue.queries()["page_carry_forward_whole"](spark, str(tmp_path)).collect()
    assert {(x["doc_id"], x["page"]): x["n"] for x in pages} == {(i, p): n for i, _, t in texts for p, n in ((1, 1), (9, t.count("\n"))) if n}


def test_kinds_of_all_nodes(spark, tmp_path):
    spark.createDataFrame([(1, 5), (250001, 6)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,), (2,)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(2,), (3,)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    got = catalogue.queries()["node_kind_whole"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "family"), (2, "family"), (3, "process"), (100005, "part"), (100006, "part"), (250001, "order")]
