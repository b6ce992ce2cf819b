import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as fn
from tessel.operators import excerpts
from tessel.operators import lines as op
from tessel.operators.chunking import Chunker, blocks_of, chunk_documents, heading, kind_of
from tessel.operators.html import to_blocks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_types(spark):
    cases = {"Carta 65": "Carta", "Contrato 51/2026": "Contrato", "Despacho de Mero Expediente 214": "Despacho de Mero Expediente", "Ofício Nº 00915": "Ofício", "Requerimento de Inclusão em Pauta": None, "Documentação Societária": None, "Anexo I": None}
    for name, want in cases.items():
        assert one(spark, name, fn.normalize_type) == (want or name)


def test_small_functions(spark):
    assert one(spark, "48500_012345_2026-01", fn.process_number) == "48500.012345/2026-01"
    assert one(spark, "a_b", fn.process_number) == "a_b"
    assert one(spark, "01/02/2026", fn.iso_date) == "2026-02-01"
    assert one(spark, "2026-02-01", fn.iso_date) == "2026-02-01"
    assert one(spark, " Ação: Única ", fn.slug) == "acao-unica"
    assert one(spark, "dv#chunk-0012", fn.chunk_index) == 12
    assert one(spark, "  a   b\n", fn.collapse_space) == "a b"
    assert one(spark, "nota_tecnica", fn.title_of) == "Nota Tecnica"
    assert one(spark, "<!-- page:7 -->", fn.page_marker) == 7
    assert one(spark, "I – DA IDENTIFICAÇÃO", fn.is_heading) is True
    assert one(spark, "uma frase comum", fn.is_heading) is False
    assert one(spark, None, fn.slug) is None


def test_line_rules(spark):
    text = "48500.123456/2026-01\n\n\n\nTexto\n(Assinado digitalmente)\nNOME\nCARGO\n\nDocumento assinado digitalmente\nfim"
    kept = lambda lines, **rules: one(spark, "\n".join(lines), lambda c: op.filter_lines(c, **rules)).split("\n")
    assert kept(["Texto", "(Assinado digitalmente)", "NOME", "CARGO", "", "fim"]) == ["Texto", "", "fim"]
    assert kept(["(Assinado digitalmente)", "a", "b", "c", "d"]) == ["d"]
    assert kept(["Documento", "Documentoassinado", "x", "Consulte a autenticidade de", "fim"]) == ["fim"]
    assert kept(["a", "Documento", " documentoASSINADO ", "x", "(Assinado digital)", "y"]) == ["a"]
    assert kept(["Documento", "x"]) == ["Documento", "x"]
    assert kept(["Documento assinado eletronicamente por A", "b", "", "A autenticidade deste documento pode ser conferida", "x", "", "Referência: Processo nº 1", "fim"]) == ["fim"]
    assert kept(["Documento assinado eletronicamente por A", "b", "", "", "Referência: Processo nº 1", "fim"]) == ["fim"]
    assert kept(["Documento assinado eletronicamente por A", "(Assinado digitalmente)", "", "fim"]) == ["fim"]
    assert kept(["p", "Documento assinado eletronicamente por A"]) == ["p"]
    assert kept(["texto" + " " * 8 + "AB", "AB"], rubrics=("AB",)) == ["texto", "AB"]
    assert kept(["x", " y ", "z"], literals=("y",), contains=("z",)) == ["x"]
    assert kept(["Documento\u00a0assinado digitalmente", "fim"]) == ["fim"]
    assert one(spark, None, op.filter_lines) is None and one(spark, "", op.filter_lines) == ""
    assert one(spark, text, op.drop_first_stamp).startswith("\n\n\nTexto")
    assert one(spark, "a\n\n\nb", op.collapse_blank_runs) == "a\n\nb"
    assert "Documento assinado" not in one(spark, text, op.filter_lines)
    pages = one(spark, "x\n<!-- pdftotext:page 1 -->\na\n<!-- pdftotext:page 2 -->\nb", op.marked_pages)
    assert [(p["page"], p["text"].strip()) for p in pages] == [(1, "a"), (2, "b")]


def test_highlight(spark):
    d = spark.createDataFrame([("abc def ghi", ["def", "ef g", "zz"]), (None, ["a"]), ("abc", [])], "t string, e array<string>")
    got = [r[0] for r in d.select(excerpts.highlight("t", "e")).collect()]
    assert [(s["highlighted"], s["text"]) for s in got[0]] == [(False, "abc "), (True, "def"), (False, " ghi")]
    assert got[1] is None and len(got[2]) == 1


@pytest.mark.parametrize("at_once", [1 << 20, 0])
def test_excerpts_in_texts(spark, at_once):
    r = random.Random(3)
    word = lambda: r.choice(["ab", "ba", "b", "über", "😀x"])
    texts = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + [(100, None), (None, "ab"), (101, ""), (102, "ab " * 30_000 + "the end"), (0, "again ab")]
    wanted = [(i, " ".join(word() for _ in range(r.randint(1, 4)))[r.randint(0, 1) :]) for i in range(50)] + [(90, ""), (91, None), (92, "ab " * 40 + "ab the"), (93, "the end"), (94, "ab " * 40 + "ab no"), (95, "the end"), (None, "ab")]
    t, e = spark.createDataFrame(texts, "doc_id int, text string").repartition(3), spark.createDataFrame(wanted, "item_id int, excerpt string").withColumn("place", F.lit(7))
    want = {(d, i, x, text.index(x)) for d, text in texts for i, x in wanted if None not in (d, i, text) and x and x in text}
    places = excerpts.excerpt_places(t, e, at_once)
    assert set(map(tuple, places.collect())) == want and places.count() == len(want)
    one = t.where("doc_id IS NOT NULL AND text NOT LIKE 'again%'")
    got = {}
    for x in excerpts.highlighted(one, excerpts.excerpt_places(one, e, at_once)).orderBy("doc_id", "pos").collect():
        got.setdefault(x["doc_id"], []).append((x["highlighted"], x["text"]))
    for d, text in texts[:-1]:
        found, out, at = sorted((p, i, len(x)) for k, i, x, p in want if k == d and text == dict(texts[:-1])[k] and text.find(x) == p), [], 0
        for p, _, n in found:
            if p >= at:
                out += [(False, text[at:p])] * (p > at) + [(True, text[p : p + n])]
                at = p + n
        if found:
            assert got[d] == out + [(False, text[at:])] * (at < len(text))
        else:
            assert d not in got
    assert not excerpts.excerpt_places(t, e.limit(0), at_once).count() and not excerpts.excerpt_places(t.limit(0), e, at_once).count()


def test_html():
    assert to_blocks("<table><tr><td colspan=2>GOIÁS 1</td><td>Acatar</td></tr></table>")[0].split("\n")[0] == "| GOIÁS 1 |  | Acatar |"
    assert to_blocks("<table><tr><td>a|b</td></tr></table>")[0].startswith("| a\\|b |")
    assert to_blocks("<p>intro<table><tr><td><p>a</p></td><td><p>b</p></td></tr><tr><td><p>c<p>d</td></tr></table><p>z") == ["intro", "| a | b |\n| --- | --- |\n| cd |  |", "z"]
    assert to_blocks("<head><title>t</title></head><noscript><p>n</p></noscript>") == ["n"]
    assert to_blocks("<div unselectable='on'>sig</div><p>x</p>") == ["x"]
    assert to_blocks("<table><tr><td>Referência: Processo nº 48500.1/2024-1 SEI nº 123</td></tr></table><p>y</p>") == ["y"]
    assert to_blocks("<div><div>in <b>bold</b><br>next</div></div><h2>T</h2><script>x</script>") == ["in bold\nnext", "## T"]


def test_blocks_and_chunks(spark):
    assert heading("I – DA IDENTIFICAÇÃO") and not heading("uma frase")
    assert kind_of(["a   b", "c   d"]) == "table"
    b = blocks_of("<!-- page:1 -->\nTITULO GRANDE\n\num\n<!-- page:2 -->\ndois\n\na   b\nc   d")
    assert [(x.kind, x.first, x.last) for x in b] == [("heading", 1, 1), ("paragraph", 1, 2), ("table", 2, 2)]
    c = Chunker()
    prose = "\n\n".join(" ".join(f"palavra{i}" for i in range(k, k + 180)) + "." for k in range(0, 3000, 180))
    got = c.chunks(prose, "doc-x")
    assert got == c.chunks(prose, "doc-x") and got[0][2] == "doc-x#chunk-0000"
    assert max(r[6] for r in got) <= 800 and len(got) > 3
    assert got[1][7].split(" ")[0] in got[0][7]  # the overlap
    table = "\n".join(["cab   um"] + [f"linha{i}   {i}" for i in range(900)])
    assert all(r[7].startswith("cab   um") for r in c.chunks(table, "t"))
    assert chunk_documents(spark.createDataFrame([("a", None), ("b", ""), ("c", "x")], "k string, t string"), "k", "t").count() == 1


def test_chunks_do_not_overlap_into_tables():
    c = Chunker(target=5, most=8, overlap=2)
    got = c.chunks("um dois tres quatro cinco\n\na   b\nc   d\n\nseis sete", "k")
    assert got[1][7].startswith("a   b")
