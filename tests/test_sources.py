import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import catalog
from tessel.operators.html import latin1_text
from tessel.sources import files, stores


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_indexed_files_by_folder(spark, tmp_path):
    for folder in ("p1", "p2"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.pdf").write_bytes(folder.encode())
    index = spark.createDataFrame([("p1", "a.pdf"), ("p2", "a.pdf"), ("p3", "a.pdf"), ("p1", "")], "processo string, arquivo string")
    got = files.indexed_files(index, files.binary_files(spark, str(tmp_path)), "processo")
    assert sorted((r["processo"], r["status_origem"], r["tamanho"]) for r in got.collect()) == [("p1", "file", 2), ("p1", "restrito", None), ("p2", "file", 2), ("p3", "ausente_no_disco", None)]


def test_process_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "_processo.json").write_text(json.dumps({"processo": "p1", "url": "u"}))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "_processo.json").write_text("{")
    urls = files.process_urls(spark, str(tmp_path))
    index = spark.createDataFrame([("p1",), ("p2",)], "processo string")
    assert sorted((r["processo"], r["processo_url"]) for r in stores.with_urls(index, urls).collect()) == [("p1", "u"), ("p2", None)]


def test_curated_and_both_corpora(spark, tmp_path):
    (tmp_path / "Voto 1.PDF").write_bytes(b"v")
    (tmp_path / "outro.html").write_bytes(b"h")
    (tmp_path / "Voto 1.md").write_bytes(b"m")
    curated = files.curated_files(spark, str(tmp_path), {"voto": "Voto"})
    assert sorted((r["name"], r["formato"], r["tipo_documento"]) for r in curated.collect()) == [("Voto 1.PDF", "pdf", "Voto"), ("outro.html", "html", "Documento")]
    both = stores.corpus_manifest(("case", curated), ("index", spark.createDataFrame([("a.pdf", "p")], "name string, processo string")))
    assert sorted((r["corpus_id"], r["name"], r["processo"]) for r in both.collect()) == [("case", "Voto 1.PDF", None), ("case", "outro.html", None), ("index", "a.pdf", "p")]
    version = stores.write_manifest(both, str(tmp_path / "m"), "name")
    again = stores.write_manifest(both.orderBy("name"), str(tmp_path / "m2"), "name")
    assert version.first()["rows"] == 3 and version.first()["corpus_version"] == again.first()["corpus_version"]


def test_member_by_lineage(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(tmp_path / "o.zip", "w") as z:
        z.writestr("deep.txt", "flat")
        z.writestr("in.zip", inner.getvalue())
    archives = files.binary_files(spark, str(tmp_path), "*.zip")
    wanted = files.expand_zips(archives).where("profundidade = 2").select("zip_caminho", "zip_lineage", "zip_membro")
    assert [bytes(r["content"]) for r in stores.members_again(archives, wanted).collect()] == [b"x"]


def test_corpus_json(spark, tmp_path):
    d = {"provisional": False, "corpus_version": "c1", "documents": [{"document_id": "AI 1", "document_version": "v1", "family_id": "f", "version_date": "2026-01-01", "source_pdf_relpath": "a.pdf"}]}
    (tmp_path / "c.json").write_text(json.dumps(d))
    docs = files.corpus_documents(spark, str(tmp_path / "c.json"))
    assert docs.first()["corpus_version"] == "c1" and docs.first()["document_version"] == "v1"
    texts = spark.createDataFrame([("v1", "t")], "name string, text string")
    named = docs.withColumn("name", F.col("document_version"))
    assert files.with_texts(named, texts, 1).first()["text"] == "t"
    with pytest.raises(ValueError):
        files.with_texts(named, texts, 10)
    r = {"relations": [{"source_id": "a", "source_kind": "family", "target_id": "b", "target_kind": "process", "type": "membro", "origin": "explicit", "status": "confirmed", "evidence": {"document_version": "v1"}}, {"source_id": "c"}]}
    (tmp_path / "r.json").write_text(json.dumps(r))
    got = {x["source_id"]: (x["evidence_document_version"], x["evidence_locator"]) for x in files.relations(spark, str(tmp_path / "r.json")).collect()}
    assert got == {"a": ("v1", ""), "c": (None, None)}


def test_scans(spark):
    listing = "page num type width height color comp bpc enc interp object ID x-ppi y-ppi size ratio\n----\n   1     0 image    2480  3508  gray    1   8  jpeg   no        10  0   300   300  100K  1%\n   2     1 image    100  100  gray    1   8  jpeg   no        10  0   300   300  1K  1%"
    images = files.page_images(spark.createDataFrame([("k", listing)], "k string, t string"), "k", "t")
    sizes = spark.createDataFrame([("k", 1, 595.0, 842.0), ("k", 2, 595.0, 842.0)], "k string, page int, width_pt double, height_pt double")
    scanned = files.scanned_pages(images, sizes, "k")
    assert [r["page"] for r in scanned.collect()] == [1]
    pages = spark.createDataFrame([("k", 1, "x" * 99), ("k", 2, "y" * 99), ("k", 3, " a b ")], "k string, page int, text string")
    assert {r["page"]: r["degraded"] for r in files.degraded_pages(pages, scanned, "k").collect()} == {1: True, 2: False, 3: True}


def test_source_manifest_and_logs(spark, tmp_path):
    full = {c: "x" for c in files.SOURCE_COLUMNS}
    (tmp_path / "s.json").write_text(json.dumps({"documents": [full, {**full, "locator": " "}, {"family_id": "f"}]}))
    good, bad = files.source_documents(spark, str(tmp_path / "s.json"))
    assert good.count() == 1 and sorted(len(r["lacks"]) for r in bad.collect()) == [1, 9]
    line = files.request_log(spark.createDataFrame([("GET", None)], "method string, user string"), ["method", "user"]).first()["value"]
    assert json.loads(line) == {"method": "GET", "user": "-"}
    docs = spark.createDataFrame([("f", "F", "2026-01-01", "v1", "carta"), ("f", "F", "2026-03-01", "v2", "voto")], "family_id string, family_label string, document_date string, version_id string, document_type string")
    assert files.download_manifest(docs).first()["timeline"] == "2026-03-01 v2 voto\n2026-01-01 v1 carta"
    files.append_log(docs, str(tmp_path / "log"))
    files.append_log(docs, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    files.write_jsonl(docs, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert files.last_of_each(docs, "family_id", "document_date").first()["version_id"] == "v2"


def test_cache_and_fetching(spark, tmp_path):
    rows = [{"text": f"t{i % 50}", "embedding": [float(i), 0.0]} for i in range(3000)] + [{"_tombstone": "v"}]
    (tmp_path / "e.jsonl").write_text("\n".join(map(json.dumps, rows)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")  # the file is read in many parts
    try:
        cache = files.embedding_cache(spark, [str(tmp_path / "e.jsonl")], 2).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r["text"]: r["embedding"][0] for r in cache} == {f"t{i}": 2950.0 + i for i in range(50)}
    known = spark.createDataFrame(cache)
    assert files.embed_cached(spark.createDataFrame([("t7",)], "text string"), known).first()["embedding"] == [2957.0, 0.0]
    with pytest.raises(Exception, match="no vector for: new"):
        files.embed_cached(spark.createDataFrame([("new",)], "text string"), known).collect()
    plan = files.fetch_plan(spark.createDataFrame([("a", "missing://x"), ("b", "https://x"), ("c", "/x"), ("d", "/y")], "version_id string, locator string"))
    done = spark.createDataFrame([("b", 5, None), ("c", None, "gone")], "version_id string, bytes long, error string")
    assert {r["version_id"]: (r["status"], r["error"]) for r in files.fetched(plan, done).collect()} == {"a": ("metadata_only", None), "b": ("downloaded", None), "c": ("failed", "gone"), "d": ("failed", "no result")}
    graves = files.tombstones(spark.createDataFrame([("v",), ("v",)], "version string"), F.lit(9))
    assert [tuple(r) for r in graves.collect()] == [(9, "tombstone", "v")]


def test_stores(spark, tmp_path):
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    path, texts = str(tmp_path / "texts"), lambda *rows: spark.createDataFrame(rows, "version string, text string")
    stores.write_texts(texts(("v1", "a"), ("v2", "b")), path, parts=2)
    stores.write_texts(texts(("v1", "new"), ("v3", "c")), path, parts=2)
    assert sorted((r["version"], r["text"]) for r in spark.read.parquet(path).collect()) == [("v1", "new"), ("v2", "b"), ("v3", "c")]
    assert stores.seed(texts(("t", "x")), str(tmp_path / "dim")).count() == stores.seed(texts(("u", "y")), str(tmp_path / "dim")).count() == 1
    ids = spark.createDataFrame([("a", None), ("a", None), ("a", "b")], "x string, y string").select(stores.job_id(F.col("x"), F.col("y")).alias("i"))
    assert len({r["i"] for r in ids.collect()}) == 2 and len(ids.first()["i"]) == 36
    assert len({(r["job"], r["at"]) for r in stores.in_job(texts(("a", "b"), ("c", "d")), "j", "2026-01-02 03:04:05").collect()}) == 1
    results = spark.createDataFrame([("q", 0, "v1"), ("q", 1, "v2"), ("r", 0, "v3")], "request string, pos int, version string")
    kept = {r["request"]: (r["total"], json.loads(r["first_page"])) for r in stores.execution(results, 1).collect()}
    assert kept["q"] == (2, [{"pos": 0, "version": "v1"}]) and kept["r"][0] == 1
    cost = spark.createDataFrame([(1000000, "m"), (5, "unknown")], "n long, model string").select(stores.cost_usd(F.col("n"), F.col("model"), {"m": 0.02}).alias("c"))
    assert [r["c"] for r in cost.collect()] == [0.02, None]


def test_small_text_functions(spark):
    assert one(spark, "Energia: solar - x", fn.macro_theme) == "Energia" and one(spark, "Energia - solar", fn.macro_theme) == "Energia"
    assert one(spark, "a|b", fn.escape_cell) == "a\\|b" and one(spark, " a b\n", fn.solid_length) == 2
    assert one(spark, "bedrock", fn.data_mode) == "real" and one(spark, "fake", fn.data_mode) == "demo"
    assert one(spark, "A.PDF", fn.extension) == "pdf" and one(spark, " Carta 65　", fn.normalize_type) == "Carta"
    assert spark.createDataFrame([(["a   b", "c   d", "x"],)], "l array<string>").select(fn.is_table(F.col("l"))).first()[0] is True
    assert spark.createDataFrame([(bytearray("é".encode("latin-1")),)], "b binary").select(latin1_text(F.col("b"))).first()[0] == "é"
    rows = spark.createDataFrame([("a", "2"), ("b", "3"), ("c", "2"), ("d", None)], "p string, d string")
    assert {r["p"]: r["pos"] for r in catalog.numbered(rows, "d", "p").collect()} == {"b": 1, "c": 2, "a": 3, "d": 4}
