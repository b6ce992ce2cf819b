"""The walk over both corpora: four outcomes, archives in archives, the cache, members read alone."""

import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessel.sources import walk

HEAD = "categoria;processo;tipo_processo;ordem;sei;tipo_documento;data;unidade;arquivo;bytes;status\n"


def packed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("a folder")
        for name, data in members.items():
            z.writestr(name.replace("__", "."), data)
    return out.getvalue()


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def root(tmp_path):
    own = tmp_path / "own" / "48500.004024-2017-80"
    own.mkdir(parents=True)
    (own / "Voto-1.PDF").write_bytes(b"vote")
    (own / "recurso-2.html").write_bytes(b"appeal")
    (own / "notes.md").write_bytes(b"no")
    (own / "loose").write_bytes(b"")
    process = tmp_path / "all docs" / "04 Category" / "48500.000001_2026-01"
    process.mkdir(parents=True)
    (process / "001 Carta.pdf").write_bytes(b"letter")
    deep = packed(deepest__txt=b"5")
    for _ in range(4):
        deep = packed(in__ZIP=deep, side__txt=b"s")
    (process / "002.zip").write_bytes(packed(a__pdf=b"A" * 3_000_000, b__txt=b"", inner__zip=packed(c__pdf=b"C", d=b"D")))
    (process / "003.ZIP").write_bytes(deep)
    (process / "004.zip").write_bytes(b"no archive")
    (process / "unlisted.pdf").write_bytes(b"u")
    (process / "_processo.json").write_text(json.dumps({"processo": "48500.000001/2026-01", "url": "https://x/1"}))
    other = tmp_path / "all docs" / "05" / "p_2"
    other.mkdir(parents=True)
    (other / "_processo.json").write_text("{broken")
    line = lambda n, kind, file, status, day="01/01/2026", sei="9": f'"c";"48500.000001/2026-01";"t";"{n}";"{sei}";"{kind}";"{day}";"u";"{file}";"1";"{status}"\n'
    rows = [line(1, "Carta 1", "001 Carta.pdf", "ok"), line(2, "Anexo", "002.zip", "ok"), line(3, "Anexo", "003.ZIP", "ok"), line(4, "Anexo", "004.zip", "ok"), line(5, "Voto", "", "restrito", "", ""), line(6, "Voto", "", ""), line(7, "Nota", "gone.pdf", "ok")]
    (tmp_path / "all docs" / "04 Category" / "_indice_1.csv").write_text("﻿" + HEAD + "".join(rows), encoding="utf-8")
    (tmp_path / "all docs" / "05" / "_indice_2.csv").write_text(HEAD + '"c";"p/2";"t";"1";"";"Carta";"";"u";"none.html";"1";"ok"\n')
    return tmp_path


def run(spark, root, cache=None):
    return walk.corpus_walk(spark, str(root), "own", "all docs", ("one", "two"), {"voto-": "Voto", "recurso-": "Recurso"}, "Desconhecido", cache)


def test_four_outcomes(spark, root):
    rows, hashes = run(spark, root)
    got = rows.collect()
    own = {x["caminho"]: (x["processo"], x["tipo_documento"], x["formato"], x["bytes"], x["sha256"], x["status_origem"]) for x in got if x["corpus_id"] == "one"}
    at = "own/48500.004024-2017-80/"
    assert own == {
        at + "Voto-1.PDF": ("48500.004024/2017-80", "Voto", "pdf", 4, sha(b"vote"), "ok"),
        at + "recurso-2.html": ("48500.004024/2017-80", "Recurso", "html", 6, sha(b"appeal"), "ok"),
        at + "loose": ("48500.004024/2017-80", "Desconhecido", None, 0, sha(b""), "ok"),
    }
    two = [x for x in got if x["corpus_id"] == "two"]
    here = "all docs/04 Category/48500.000001_2026-01/"
    plain = list([x["categoria"], x["tipo_documento"], x["numero_sei"], x["data"], x["caminho"], x["formato"], x["bytes"], x["sha256"], x["status_origem"], x["processo_url"]] for x in two if x["zip_membro"] is None and x["categoria"] != "05")
    url = "https://x/1"
    assert sorted(plain, key=str) == sorted(
        [
            ["04 Category", "Carta 1", "9", "01/01/2026", here + "001 Carta.pdf", "pdf", 6, sha(b"letter"), "ok", url],
            ["04 Category", "Voto", None, None, None, None, None, None, "restrito", url],
            ["04 Category", "Voto", "9", "01/01/2026", None, None, None, None, "restrito", url],
            ["04 Category", "Nota", "9", "01/01/2026", None, "pdf", None, None, "ausente_no_disco", url],
        ],
        key=str,
    )
    zipped = {(x["zip_caminho"], tuple(x["zip_lineage"] or ()), x["zip_membro"]): (x["profundidade"], x["formato"], x["bytes"], x["sha256"], x["caminho"]) for x in two if x["zip_membro"]}
    a, b = here + "002.zip", here + "003.ZIP"
    want = {(a, (), "a.pdf"): (1, "pdf", 3_000_000, sha(b"A" * 3_000_000), None), (a, (), "b.txt"): (1, "txt", 0, sha(b""), None)}
    want |= {(a, (a, "inner.zip"), "c.pdf"): (2, "pdf", 1, sha(b"C"), None), (a, (a, "inner.zip"), "d"): (2, None, 1, sha(b"D"), None)}
    want |= {(b, (b, *["in.ZIP"] * n) if n else (), "side.txt"): (n + 1, "txt", 1, sha(b"s"), None) for n in range(4)}
    assert zipped == want | {(b, (b, *["in.ZIP"] * 4), "deepest.txt"): (5, "txt", 1, sha(b"5"), None)}
    five = [x for x in two if x["categoria"] == "05"]
    assert [(x["status_origem"], x["formato"], x["numero_sei"], x["processo_url"]) for x in five] == [("ausente_no_disco", "html", None, None)]
    assert not any("unlisted" in (x["caminho"] or "") for x in got) and hashes.where("NOT cached").count() == hashes.count() == 5


def test_only_changed_files_are_read(spark, root):
    first, hashes = run(spark, root)
    cache = hashes.withColumn("sha256", F.when(F.col("path").endswith("recurso-2.html"), "from the cache").otherwise(F.col("sha256")))
    at = root / "own" / "48500.004024-2017-80"
    (at / "Voto-1.PDF").write_bytes(b"longer vote")
    rows, again = run(spark, root, cache)
    assert {x["path"].rsplit("/", 1)[1] for x in again.where("NOT cached").collect()} == {"Voto-1.PDF"}
    found = {x["caminho"].rsplit("/", 1)[1]: x["sha256"] for x in rows.where("corpus_id = 'one'").collect()}
    assert found == {"Voto-1.PDF": sha(b"longer vote"), "recurso-2.html": "from the cache", "loose": sha(b"")}


def test_members_alone(spark, root):
    path = str(root / "all docs/04 Category/48500.000001_2026-01/002.zip")
    wanted = spark.createDataFrame([(path, [], "b.txt"), (path, ["inner.zip"], "c.pdf"), (path, [], "unknown")], "path string, lineage array<string>, member string")
    assert sorted((x["member"], bytes(x["content"])) for x in walk.contents(wanted).collect()) == [("b.txt", b""), ("c.pdf", b"C")]


def test_bad_inner_archive_and_no_folders(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(packed(in__zip=b"no archive"))
    with pytest.raises(Exception, match="zip"):
        walk.members(spark.createDataFrame([(str(tmp_path / "x.zip"),)], "path string")).collect()
    rows, hashes = run(spark, tmp_path)
    assert not rows.count() and not hashes.count()
