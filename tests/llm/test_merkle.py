"""Merkle manifest against a plain walk of the trees."""

import hashlib
import zlib

import pytest

from tessel.llm import merkle as op


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], r[1])))


def climb(nodes, at):
    """The root, and for the node at a place the left and right siblings of each level."""
    path = []
    while len(nodes) > 1:
        if at is not None:
            a = at // 8 * 8
            path.append((nodes[a:at], nodes[at + 1 : a + 8]))
            at //= 8
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], path


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in by.values():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    roots = [climb([leaf(r) for r in by[x]], None)[0] for x in langs]
    out = []
    for n, x in enumerate(langs):
        leaves = [leaf(r) for r in by[x]]
        for i, r in enumerate(by[x]):
            path = climb(leaves, i)[1] + climb(roots, n)[1]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            low = r[1].translate({c: c + 32 for c in range(65, 91)}) if hit else r[1]
            now = leaf((r[0], low, *r[2:]))
            for left, right in path:
                now = H(*left, now, *right)
            root = climb(roots, None)[0]
            out.append((r[0], leaves[i], roots[n], root, H(*(d for a, b in path for d in a + b)), now, now == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, name):
    path = tmp_path / name
    spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row int, leaf string").repartition(3).write.parquet(str(path / "documents.parquet"))
    return sorted(map(tuple, op.op13_merkle_manifest(spark, str(path)).collect()), key=str)


@pytest.mark.parametrize("widely", [1024, 4])
def test_brute_force(spark, tmp_path, monkeypatch, widely):
    monkeypatch.setattr(op, "WIDELY", widely)
    rows = [(i, f"Text {'Ä' if i % 2 else 'b'} {i}", ("de", "en", None, "Ü", "")[min(4, i % 13)], None if i % 5 == 0 else f"s{i % 3}", i) for i in range(700)]
    rows += [(1000 + i, "x Y", f"l{i}", "s", 3) for i in range(70)]
    rows += [(5, None, "de", None, None), (None, "A", "de", "s", 1), (None, None, None, None, None), (3, "", "en", "", 0), (-7, "Z" * 100_000, "en", "s", 100_000)]
    rows += [(9, "Same", "en", "s", 4)] * 30
    got = run(spark, tmp_path, rows, "many")
    assert got == brute(rows) and {x[6] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", i) for i in range(n)]
    assert run(spark, tmp_path, rows, f"n{n}") == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, [], "none") == []
