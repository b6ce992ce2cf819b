"""Rules around the ports: proposals that are good, bad or fail; recognised pages."""

import json

from pyspark.sql import functions as F

from tessel.operators import specs
from tessel.sources import files

GOOD = {"drop_pages": [2], "drop_line_literals": ["Header"], "drop_line_contains": ["junk"], "strip_trailing_rubric_tokens": ["AB."], "notes": "why"}


def test_answers_are_checked(spark):
    cases = {
        json.dumps(GOOD): None, json.dumps({"notes": "n"}): None, json.dumps(GOOD | {"drop_pages": []}): None,
        "": "no JSON", "{broken": "no JSON", "[1]": "no object", json.dumps(GOOD | {"notes": " "}): "no notes", json.dumps(GOOD | {"notes": 5}): "no notes", json.dumps({k: v for k, v in GOOD.items() if k != "notes"}): "no notes",
        json.dumps(GOOD | {"drop_pages": ["2"]}): 'drop_pages is no list of whole numbers: ["2"]', json.dumps(GOOD | {"drop_pages": 2}): "drop_pages is no list of whole numbers: 2",
        json.dumps(GOOD | {"drop_line_contains": [1]}): "drop_line_contains is no list of texts: [1]", json.dumps(GOOD | {"drop_line_literals": ["a", None]}): 'drop_line_literals is no list of texts: ["a",null]',
        json.dumps(GOOD | {"drop_line_literals": None}): "drop_line_literals is no list of texts: null",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", specs.checked_spec(F.col("a")).alias("c")).collect()
    assert {r["a"]: r["c"]["reason"] for r in rows} == cases
    for r in rows:
        if r["c"]["reason"]:
            assert r["c"]["spec"].asDict() == {"drop_pages": [], "drop_line_literals": [], "drop_line_contains": [], "strip_trailing_rubric_tokens": [], "notes": ""}
    assert next(r["c"]["spec"].asDict() for r in rows if r["a"] == json.dumps(GOOD)) == GOOD


def test_proposals_are_asked_for_once(spark):
    docs = spark.createDataFrame([(1, "good"), (2, "good"), (3, "bad"), (4, "fails"), (5, "silent"), (6, "known")], "key int, text string")
    asked = []

    def ask(rows):
        asked.extend(r["text"] for r in rows.collect())
        answer = F.when(F.col("text") == "good", json.dumps(GOOD)).when(F.col("text") == "bad", "{}")
        return rows.where("text <> 'silent'").select("spec_key", answer.alias("answer"), F.when(F.col("text") == "fails", "no credit").alias("error"))

    cache = docs.where("key = 6").select(specs.spec_key(F.col("text"), "v1", "m").alias("spec_key"), specs.checked_spec(F.lit(json.dumps(GOOD))).getField("spec").alias("spec"))
    found, kept = specs.propose(docs, cache, ask, "v1", "m")
    got = {r["key"]: (r["state"], r["reason"], r["spec"]["notes"]) for r in found.collect()}
    assert got == {1: ("proposed", None, "why"), 2: ("proposed", None, "why"), 3: ("fallback", "no notes", ""), 4: ("fallback", "no credit", ""), 5: ("fallback", "no answer", ""), 6: ("cached", None, "why")}
    assert sorted(asked[:4]) == ["bad", "fails", "good", "silent"] and kept.count() == 1
    again, _ = specs.propose(docs.where("key < 3"), cache.unionByName(kept), ask, "v1", "m")
    assert {r["state"] for r in again.collect()} == {"cached"}
    other, _ = specs.propose(docs.where("key = 1"), cache.unionByName(kept), ask, "v2", "m")
    assert {r["state"] for r in other.collect()} == {"proposed"}


def test_route(spark):
    text = ["Header\nkept        AB.\nsome junk here\n\n\n\nlast", "whole page", "48500.000001/2024-11\nDocumento assinado digitalmente.\nend"]
    pages = spark.createDataFrame([(k, i + 1, t) for k in (1, 2) for i, t in enumerate(text)], "key int, page int, text string").repartition(3)
    answer = {1: json.dumps(GOOD), 2: "no"}
    ask = lambda rows: rows.crossJoin(pages.select("key").distinct()).where("key = 1 OR key = 2").select("spec_key", F.lit(answer[1]).alias("answer"), F.lit(None).cast("string").alias("error"))
    raw = specs.raw_texts(pages)
    assert raw.first()["text"].startswith("<!-- pdftotext:page 1 -->\nHeader\n") and raw.first()["text"].count("<!-- pdftotext") == 3
    none = spark.createDataFrame([], f"spec_key string, spec {specs.SPEC}")
    found, _ = specs.propose(raw.where("key = 1"), none, ask, "v", "m")
    plain, _ = specs.propose(raw.where("key = 2"), none, lambda rows: rows.select("spec_key", F.lit("no").alias("answer"), F.lit(None).cast("string").alias("error")), "v", "m")
    got = {r["key"]: r for r in specs.spec_route(pages, found.unionByName(plain)).collect()}
    assert got[1]["markdown"] == "<!-- page:1 -->\nkept\n\nlast\n\n<!-- page:3 -->\nend\n" and (got[1]["pages_total"], got[1]["pages_kept"], got[1]["state"]) == (3, 2, "proposed")
    assert got[1]["percent_removed"] == 54.5  # 5 of 11 lines stay
    assert got[2]["markdown"] == "<!-- page:1 -->\nHeader\nkept        AB.\nsome junk here\n\nlast\n\n<!-- page:2 -->\nwhole page\n\n<!-- page:3 -->\nend\n" and got[2]["reason"] == "no JSON"


def test_pages_from_raw_listings(spark):
    """Sizes and images as the published tools list them: a full scan, a logo, a photo, a mask, and a page without text."""
    head = "page   num  type   width height color comp bpc  enc interp  object ID x-ppi y-ppi size ratio\n----\n"
    image = lambda page, kind, w, h, ppi: f"  {page}     0 {kind}    {w}  {h}  rgb     3   8  jpx    no        12  0   {ppi}   {ppi} 1M 1.0%\n"
    images = spark.createDataFrame([("d", head + image(1, "image", 543, 223, 577) + image(2, "image", 2550, 3300, 300) + image(3, "image", 560, 480, 335) + image(4, "smask", 2550, 3300, 300) + image(5, "image", 612, 792, 72))], "key string, text string")
    sizes = spark.createDataFrame([("d", "Title: x\n" + "".join(f"Page    {i} size: {'612 x 792' if i == 2 else '595.5 x 842.25'} pts (letter)\n" for i in range(1, 7)))], "key string, text string")
    whole = spark.createDataFrame([("d", "\f".join(["enough characters on this page"] * 5 + [" 12 "]) + "\f")], "key string, text string")
    pages = files.form_feed_pages(whole.withColumn("n", F.lit(6)), "key", "text", F.col("n"))
    scans = files.scanned_pages(files.page_images(images, "key", "text"), specs.page_sizes(sizes, "key", "text"), "key")
    judged = files.degraded_pages(pages, scans, "key")
    assert [r["page"] for r in judged.where("degraded").orderBy("page").collect()] == [2, 6]
    answers = spark.createDataFrame([("d", 2, "text that was read from it", None), ("d", 6, None, "no credit"), ("d", 1, "not asked for", None)], "key string, page int, recognised string, error string")
    swapped = specs.recognised(judged, answers)
    got = {r["page"]: (r["text"], r["note"]) for r in swapped.collect()}
    assert got[2] == ("text that was read from it", None) and got[6] == (" 12 ", "p.6: no credit") and got[1] == ("enough characters on this page", None)
    assert tuple(specs.recognition_notes(swapped).first()) == ("d", [2, 6], ["p.6: no credit"])
    assert not specs.needs_recognition(swapped).first()["pending"]
