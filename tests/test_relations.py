import pytest
from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import measure, notify, portal, relations, routes, state


def test_citations_and_keys(spark):
    c = spark.createDataFrame([("v", "c0", "o Auto de  Infração nº 0035/2025-SFT e AUTO DE INFRACAO – AI – No. 7/2024; auto de infração nº 12/20"), ("v", "c1", "Auto de Infração nº 0035/2025-SFTx")], "version string, locator string, text string")
    got = {(r["locator"], r["identifier"]) for r in relations.citations(c).collect()}
    assert got == {("c0", "Auto de Infração nº 0035/2025-SFT"), ("c1", "Auto de Infração nº 0035/2025")}
    keys = spark.createDataFrame([("AI 35/2025-SFT",), ("Auto de Infração nº 0035/2025",), ("MAI 3/2020",), ("nada",), (None,)], "t string").select("t", relations.notice_key(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] and tuple(r["k"]) for r in keys.collect()} == {"AI 35/2025-SFT": (35, 2025, "SFT"), "Auto de Infração nº 0035/2025": (35, 2025, None), "MAI 3/2020": None, "nada": None, None: None}


def test_reference_edges(spark):
    cited = spark.createDataFrame([("v1", "c", "Auto de Infração nº 0035/2025-SFT", 0), ("v1", "c", "Auto de Infração nº 9/2020", 1), ("v2", "c", "Auto de Infração nº 7/2024-AA", 0), ("v3", "c", "Auto de Infração nº 35/2025", 0)], "version string, locator string, identifier string, pos int")
    versions = spark.createDataFrame([("v1", "f1"), ("v2", "f2"), ("v3", "f8")], "version string, family string")
    known = spark.createDataFrame([("f8", "AI 35/2025-SFT"), ("f3", "AI 7/2024-BB"), ("f1", None)], "family string, document_id string")
    assert [(r["source"], r["target"], r["type"]) for r in relations.reference_edges(cited, versions, known).collect()] == [("f1", "f8", "referencia")]


def test_similarity_edges_in_band(spark):
    n = spark.createDataFrame([("a", "b", 0.97), ("b", "a", 0.80), ("a", "c", 0.7999), ("c", "gone", 0.9), ("c", "b", 0.85), ("b", "c", 0.85)], "src string, dst string, score double")
    f = spark.createDataFrame([("a",), ("b",), ("c",)], "family string")
    assert sorted((r["source"], r["target"], r["score"]) for r in relations.similarity_edges(n, f).collect()) == [("a", "b", 0.8), ("b", "c", 0.85)]


def test_refused_rows(spark):
    rows = spark.createDataFrame([(1, "f", "up"), (2, " ", "up"), (3, "f", "sideways"), (4, None, None)], "k int, family string, vote string")
    good, bad = relations.checked(rows, ("family",), vote=("up", "down"))
    assert [r["k"] for r in good.collect()] == [1] and {r["k"]: len(r["reasons"]) for r in bad.collect()} == {2: 1, 3: 1, 4: 2}


def test_log_and_reset(spark):
    log = spark.createDataFrame([(1, "c1", "v", "put"), (2, None, "v", "tomb")], "seq int, chunk string, version string, op string")
    with pytest.raises(ValueError):
        state.rebuild(log, "chunk", "version", "seq", F.col("op") == "tomb")
    old = spark.createDataFrame([(1, "m"), (2, "n")], "k int, model string")
    assert sorted(tuple(r) for r in state.reindex(old, spark.createDataFrame([(9,)], "k int"), "m").collect()) == [(2, "n"), (9, "m")]
    left, counts = state.reset({"a": old})
    assert left["a"].count() == 0 and tuple(counts.first()) == ("a", 2)


def test_display_and_fan_out(spark):
    n = spark.createDataFrame([(1, "v1"), (2, "vx")], "id int, version string")
    v = spark.createDataFrame([("v1", "AI 1", "norma")], "version string, document_id string, document_type string")
    assert sorted((r["id"], r["document_id"], r["opened"]) for r in notify.for_display(n, v, spark.createDataFrame([(2,), (2,)], "id int")).collect()) == [(1, "AI 1", False), (2, None, True)]
    with pytest.raises(ValueError):
        notify.fan_out(n.select(F.col("id").alias("user_id")), v.select("version"), most=0)


def test_route(spark):
    pages = spark.createDataFrame(
        [("d", 1, "48500.123456/2026-01\nCONTEUDO PRINCIPAL DA PAGINA UM\n\n\nDocumento assinado digitalmente"), ("d", 2, "Segunda linha de conteudo relevante."), ("e", 1, ""), ("e", 2, "x")], "sha256 string, page int, text string"
    )
    got = {r["sha256"]: r for r in routes.pdf_text_route(pages).collect()}
    assert got["d"]["markdown"] == "<!-- page:1 -->\nCONTEUDO PRINCIPAL DA PAGINA UM\n\n<!-- page:2 -->\nSegunda linha de conteudo relevante.\n"
    assert (got["d"]["status"], got["d"]["pages_kept"], got["d"]["percent_removed"]) == ("extracted", 2, 33.3)
    assert (got["e"]["status"], got["e"]["markdown"]) == ("pending", None) and "0.5" in got["e"]["message"]
    stored = routes.store_markdown(spark.createDataFrame([("d", "v1", "old")], "sha256 string, extractor_version string, markdown string"), routes.pdf_text_route(pages), "v1")
    assert [r["markdown"] for r in stored.collect()] == ["old"]
    size = spark.createDataFrame([("Pages: 2\nPage    1 size: 595.3 x 841.9 pts (A4)",)], "t string").select(routes.page_size(F.col("t")).alias("s")).first()["s"]
    assert tuple(size) == (595.3, 841.9)


def test_portal(spark):
    raw = "| Processo | 48500.123456/2024-53 |\n| 0012345 | Ofício  1 | 01/02/2026 | 02/02/2026 | SFT |\n"
    pages = spark.createDataFrame([(1, raw), (2, "Processo: 48500.000001/2020-01\n0099999 Nota Técnica 03/04/2025 05/04/2025 SRM")], "page int, text string")
    header = {r["page"]: r["process_number"] for r in portal.page_header(pages).collect()}
    assert header == {1: "48500.123456/2024-53", 2: "48500.000001/2020-01"}
    rows = portal.protocol_rows(pages).withColumn("process_number", F.when(F.col("page") == 1, header[1])).withColumn("href", F.lit(None).cast("string"))
    docs = {r["official_identifier"]: r for r in portal.source_documents(rows, "sei").collect()}
    assert docs["0012345"]["family_id"] == "sei-process-48500-123456-2024-53" and docs["0012345"]["version_date"] == "2026-02-01" and docs["0012345"]["document_type"] == "oficio_1"
    assert docs["0099999"]["locator"] == "missing://sei/0099999" and docs["0099999"]["process_number"] == "processo-desconhecido"


def test_measures(spark):
    m = spark.createDataFrame([("a", "A")], "raw string, canonical string")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "p string")
    assert sorted(str(r["p"]) for r in measure.canonical(rows, m, "p").collect()) == ["A", "None", "b"]
    with pytest.raises(Exception, match="unknown: b"):
        measure.canonical(rows, m, "p", strict=True).collect()
    with pytest.raises(Exception, match="zero vector"):
        measure.mean_vectors(spark.createDataFrame([("f", [1.0, 0.0]), ("f", [-1.0, 0.0])], "f string, v array<double>"), "f", "v").collect()
    one = lambda value, f: spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert one("ﬁm Ǆ ½ ÇÃO ☃", fn.slug) == "fim-dz-12-cao"
    assert one("  …", lambda c: fn.slug(c, "_", "documento")) == "documento" and one("-a/b.-", fn.file_name) == "a-b"
