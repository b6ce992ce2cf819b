"""Memory of language identification on many short texts; unique record ids of repeated pages."""

import numpy as np
from pyspark.sql import functions as F

from tessel.llm import language_id, warc
from tessel.llm._store import Workspace


def test_groups_of_short_texts():
    texts = ["ab"] * 5000 + ["x" * 400_000, "", "y"]
    got = list(language_id._groups(texts))
    assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == len(texts)
    assert all(b - a <= language_id._TEXTS and (b - a == 1 or sum(map(len, texts[a:b])) <= language_id._GROUP) for a, b in got)
    assert list(language_id._groups([])) == []


def test_prototypes_do_not_depend_on_what_is_held(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [("".join(r.choice(list("abcdefghijklmno "), 40)), "xy"[i % 2]) for i in range(300)]
    d = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    whole = language_id.learn_prototypes(d)
    monkeypatch.setattr(language_id, "_HELD", 7)
    monkeypatch.setattr(language_id, "_TEXTS", 3)
    # the closure reads the module of the worker, so the bounds are tried on the space in this process too
    space, plain = language_id.Space(), language_id.Space()
    codes, _, _ = language_id.trigrams([t for t, _ in rows[:20]])
    assert all((space.bind(codes[i : i + 5]) == plain.bind(codes[i : i + 5])).all() for i in range(0, len(codes), 5))
    again = language_id.learn_prototypes(d.repartition(5))
    assert whole[0] == again[0] == ["x", "y"] and (whole[1] == again[1]).all()


def test_record_ids_of_repeated_pages(spark):
    body = "b" * 200
    rows = [(1, "u", body), (1, "u", body), (1, "v", body), (2, None, body), (2, "", body), (3, "u", "s"), (3, "u", "s"), (None, None, body), (None, None, body), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    ws = Workspace(spark, "t")
    ws.save(warc.write_warc(warc.resolve_revisits(pages), ws.path("w")), "m")
    records = ws.save(warc.read_records(spark, ws.path("w")), "r")
    assert records.count() == len(rows) == records.select("record").distinct().count()
    got = warc.read_warc(records)
    assert got.count() == len(rows)
    assert got.where("record_type = 'revisit'").select("refers_to").distinct().collect() == [(1,)]
    assert got.where("record_type = 'response'").agg(F.count(F.lit(1))).first()[0] == 4
