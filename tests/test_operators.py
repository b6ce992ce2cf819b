import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.operators import catalog, graph, manifest, notify, search, state
from tessel.plans import vectors
from tessel.sources import files
from tessel.streaming import events


def test_family_neighbours(spark):
    rows = [("a", [1.0, 0.0, 0.0]), ("a", [0.0, 1.0, 0.0]), ("b", [1.0, 0.0, 0.0]), ("c", [0.6, 0.8, 0.0]), ("d", [0.0, 0.0, 1.0])]
    fam = vectors.family_vectors(spark.createDataFrame(rows, "f string, v array<float>"), "f", "v")
    got = {r["dst"]: round(r["score"], 5) for r in vectors.neighbors(fam, 3).where("src = 'a'").collect()}
    assert got == {"c": 0.98995, "b": 0.70711, "d": 0.0}


def test_top_chunks(spark):
    c = spark.createDataFrame([("c1", [1.0, 0.0, 0.0]), ("c2", [0.0, 1.0, 0.0]), ("c3", [0.9, 0.1, 0.0])], "key string, v array<double>")
    q = spark.createDataFrame([([1.0, 0.0, 0.0],)], "q array<double>")
    assert [r["key"] for r in vectors.top_chunks(c, q, 2).collect()] == ["c1", "c3"]


def test_face_and_pieces(spark):
    v = spark.createDataFrame([("f", 1, "2024-03-04"), ("f", 2, "2024-04-18"), ("g", 3, "2024-03-20"), ("h", 4, "2024-05-02")], "family string, version int, day string").withColumn("kind", F.lit("decisao"))
    p = catalog.process_summary(v.select("family", F.lit("p").alias("process")).distinct(), catalog.face_version(v), F.col("kind")).first()
    assert (p["latest"], p["pieces"], p["latest_kind"]) == ("2024-05-02", 3, "decisao")
    s = catalog.family_summary(v).where("family = 'f'").first()
    assert (s["face"], s["versions_count"], s["latest"]) == (2, 2, "2024-04-18")


def test_search_order_and_cursor(spark):
    hits = spark.createDataFrame([(1, "v2", 0, 0.5, 0), (1, "v1", 0, 0.5, 1), (1, "v3", 0, 0.9, 2), (1, "zz", 0, 1.0, 3), (1, "v1", 0, 0.5, 4)], "request int, version string, chunk int, score double, hit_pos int")
    known = spark.createDataFrame([("v1",), ("v2",), ("v3",)], "version string")
    r = search.resolve_hits(hits, known)
    assert [x["version"] for x in r.orderBy("pos").collect()] == ["v3", "v1", "v1", "v2"]
    assert search.page(r, 1, 2).count() == 2
    assert search.replay(search.freeze(r), r).first()["matches"] is True


def test_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "source long, target long")
    n = spark.createDataFrame([(1,), (2,)], "node long")
    assert sorted((r["node"], r["other"]) for r in graph.adjacent(e, n).collect()) == [(1, 2), (1, 3), (2, 1), (2, 2)]
    old = spark.createDataFrame([(1, "confirmed", 0.5)], "k int, status string, score double")
    new = spark.createDataFrame([(1, "suggested", 0.9), (2, "suggested", 0.1)], "k int, status string, score double")
    got = {r["k"]: (r["status"], r["score"]) for r in graph.merge(old, new, ["k"], ["status"]).collect()}
    assert got == {1: ("confirmed", 0.9), 2: ("suggested", 0.1)}


def test_references(spark):
    refs = spark.createDataFrame([("f1", 35, 2025, "SFT"), ("f2", 35, 2025, "SFT"), ("f3", 9, 2020, None), ("f1", 7, 2024, "AA")], "family string, number int, year int, suffix string")
    targets = spark.createDataFrame([("f2", 35, 2025, None), ("f8", 7, 2024, "BB")], "target string, number int, year int, suffix string")
    assert [(r["family"], r["target"]) for r in graph.resolve_unique(refs, targets).collect()] == [("f1", "f2")]


def test_replay_of_log(spark):
    log = spark.createDataFrame([(1, "c1", "v", "put"), (2, "c1", "v", "put"), (3, None, "v", "tomb"), (4, "c2", "v", "put"), (5, "c3", "w", "put")], "seq int, chunk string, version string, op string")
    got = state.replay(log, "chunk", "version", "seq", F.col("op") == "tomb")
    assert sorted((r["chunk"], r["seq"]) for r in got.collect()) == [("c2", 4), ("c3", 5)]


def test_triage_and_versions(spark):
    names = ["Recibo 42", "Carta", "Voto", "CNPJ", "Despacho", "Anexo I"]
    d = spark.createDataFrame([(n, "pdf") for n in names] + [("Carta", "MP4")], "tipo_documento string, formato string")
    got = [(r["tipo_documento"], r["formato"]) for r in manifest.triage(d).where("descartado").collect()]
    assert sorted(got) == [("CNPJ", "pdf"), ("Carta", "MP4"), ("Recibo 42", "pdf")]
    k = spark.createDataFrame([("b",), ("a",)], "key string")
    assert manifest.corpus_version(k).first()[0] == manifest.corpus_version(k.orderBy("key")).first()[0]
    import hashlib

    assert manifest.listed_version(k) == hashlib.sha256(b"a\nb").hexdigest()
    values = [["ç", None, 1], ['q"\\/\n\r\t\b\f\x01\x7f', "😀 a", -5], ["", "\u2028", 0]]
    rows = spark.createDataFrame([tuple(v) for v in values], "a string, b string, n int").select(manifest.canonical_key(F.col("a"), F.col("b"), F.col("n"))).collect()
    assert [r[0] for r in rows] == [json.dumps(v) for v in values]


def test_notifications(spark):
    wanted = spark.createDataFrame([(1, "d1"), (1, "d2")], "user int, version string")
    new, old = notify.split_new(wanted, spark.createDataFrame([(1, "d1")], "user int, version string"), ["user", "version"])
    assert notify.events_of(new, old, "user", "version").count() == 3
    with pytest.raises(ValueError):
        notify.filtered(wanted, limit=-1)


def test_files(spark, tmp_path):
    (tmp_path / "i.csv").write_bytes("﻿".encode() + b'"categoria";"processo";"tipo_processo";"ordem";"sei";"tipo_documento";"data";"unidade";"arquivo";"bytes";"status"\n"04";"p1";"";"1";"2";"Carta 1";"01/01/2026";"U";"a.pdf";"3";"ok"\n"04";"p1";"";"2";"3";"Voto";"";"U";"";"";"restrito"\n"04";"p1";"";"3";"3";"Voto";"";"U";"gone.pdf";"";""\n')
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(b"abc")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(docs / "o.zip", "w") as z:
        z.writestr("flat.txt", "y")
        z.writestr("in.zip", inner.getvalue())
    (docs / "bad.zip").write_bytes(b"no archive")
    index = files.index_csv(spark, str(tmp_path / "i.csv"))
    assert index.first()["categoria"] == "04"
    got = files.indexed_files(index, files.binary_files(spark, str(docs), "*.pdf"))
    assert sorted(r["status_origem"] for r in got.collect()) == ["ausente_no_disco", "file", "restrito"]
    z = files.expand_zips(files.binary_files(spark, str(docs), "*.zip"))
    assert sorted((r["zip_membro"], r["profundidade"]) for r in z.collect()) == [("deep.txt", 2), ("flat.txt", 1)]
    (tmp_path / "q.json").write_text(json.dumps({"aliases": {"al": "q1"}, "queries": {"q1": [{"family_id": "f", "score": 0.5}]}}))
    assert sorted(r["query"] for r in files.declared_hits(spark, str(tmp_path / "q.json")).collect()) == ["al", "q1"]
    (tmp_path / "t.md").write_text("# x\n| tipo | tema |\n| --- | --- |\n| A | B |\n")
    assert [tuple(r) for r in files.markdown_table(spark, str(tmp_path / "t.md"), ["tipo", "tema"]).collect()] == [("A", "B")]
    (tmp_path / "e.jsonl").write_text('{"text":"a","embedding":[1.0,2.0]}\n{"_tombstone":"v"}\n{"text":"a","embedding":[3.0,4.0]}\n')
    cache = files.embedding_cache(spark, [str(tmp_path / "e.jsonl")], 2)
    assert [r["embedding"] for r in cache.collect()] == [[3.0, 4.0]]
    plan = files.fetch_plan(spark.createDataFrame([("missing://x",), ("https://x",), ("/x",)], "locator string"))
    assert [r["action"] for r in plan.collect()] == ["metadata_only", "download", "copy"]
    ff = files.form_feed_pages(spark.createDataFrame([(1, "a\fb\f", 2)], "k int, t string, n int"), "k", "t", F.col("n"))
    assert [(r["page"], r["text"]) for r in ff.collect()] == [(1, "a"), (2, "b")]


def test_stream(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "a", 1.0, "{}"), (2, "2024-01-01 00:10:00", 1, "a", 2.0, "{}"), (3, "2024-01-01 02:00:00", 2, "b", 3.0, "{}")], "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    s = events.event_stream(spark, str(tmp_path / "in"))
    events.upsert_into(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r["user_id"]: r["event_id"] for r in events.latest(spark, str(tmp_path / "out")).collect()} == {1: 2, 2: 3}
    q = events.first_notifications(s).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_opinion_of_whole_families(spark):
    v = spark.createDataFrame([(1, 10, "2024-01-01"), (1, 11, "2024-02-01"), (2, 20, "2024-01-01"), (9, 90, "2024-01-01")], "family int, version int, day string")
    assert catalog.opinion(v, {"main": 1, "other": 2}).first().asDict() == {"main": 11, "other": 20, "n_main": 2, "n_other": 1}
    with pytest.raises(Exception, match="no versions of: gone"):
        catalog.opinion(v, {"main": 1, "gone": 7}).collect()


def test_nested_answer(spark):
    hits = [("q", 0, None, "f1", "v1", 0, 0.855), ("q", 1, "p", "f2", "v2", 0, 0.8), ("q", 2, "p", "f3", "v3", 1, 0.7), ("q", 3, "p", "f2", "v2", 4, 0.61), ("q", 4, None, "f1", "v1", 0, 0.5)]
    got = search.nested_by_process(spark.createDataFrame(hits, "request string, pos int, process string, family string, version string, chunk int, score double")).orderBy("rank").collect()
    assert [(r["group"], r["adherence"], r["very_relevant"], r["average"]) for r in got] == [("f1", 86, True, 83), ("p", 80, False, 83)]
    assert [[(d["family"], [(h["version"], h["chunk"]) for h in d["hits"]]) for d in r["documents"]] for r in got] == [[("f1", [("v1", 0), ("v1", 0)])], [("f2", [("v2", 0), ("v2", 4)]), ("f3", [("v3", 1)])]]


def test_markdown_corpus(spark, tmp_path):
    docs = [{"document_id": "d", "document_version": f"v{i}", "family_id": "f", "source_pdf_relpath": p} for i, p in enumerate(("a b/x+1.pdf", "c.pdf"))]
    (tmp_path / "c.json").write_text(json.dumps({"corpus_version": "demo", "documents": docs}))
    (tmp_path / "md" / "a b").mkdir(parents=True)
    (tmp_path / "md" / "a b" / "x+1.md").write_text("first\n\ntext")
    (tmp_path / "md" / "c.md").write_text("second")
    rows = files.corpus_documents(spark, str(tmp_path / "c.json"))
    real = files.markdown_corpus(spark, rows, str(tmp_path / "md"), "real", 2)
    assert sorted((r["document_version"], r["text"], r["corpus_version"]) for r in real.collect()) == [("v0", "first\n\ntext", "real"), ("v1", "second", "real")]
    with pytest.raises(ValueError):
        files.markdown_corpus(spark, rows, str(tmp_path / "md"), "real", 3)
    (tmp_path / "md" / "c.md").unlink()
    with pytest.raises(Exception, match="no file of: v1"):
        files.markdown_corpus(spark, rows, str(tmp_path / "md"), "real", 2).collect()
