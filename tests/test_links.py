"""Links of saved pages, HTML and Markdown."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessel.operators import links, portal


def test_links_and_text(spark):
    html = [
        (1, "u", '<p>one <a href="/x">two<br>three <b>four</b></a> five</p><a>six</a><a href="y"/>seven<a href="z"> A&amp;B&nbsp;C </a>'),
        (2, "u", "plain [label one](http://x/1) ![picture](p.png) [t](a.html \"title\") []( ) [two](b)"),
        (3, "u", None),
        (4, "u", ""),
        (5, "u", "<a href='q'>open <a href='r'>inner</a> still"),
        (6, "u", "<script>var a = 1</script><!-- no -->"),
    ]
    read = links.read_pages(spark.createDataFrame(html, "page int, url string, html string").withColumn("links", F.lit(1)).repartition(2))
    texts = {x["page"]: x["text"] for x in read.collect()}
    assert texts[1] == "one\ntwo\nthree\nfour\nfive\nsix\nseven\nA&B C" and texts[3] is None and texts[4] == "" and texts[6] == "var a = 1"
    got = [(x["page"], x["pos"], x["label"], x["href"]) for x in links.links_of(read).orderBy("page", "pos").collect()]
    assert got == [
        (1, 0, "two", "/x"), (1, 1, "three", "/x"), (1, 2, "four", "/x"), (1, 3, "A&B C", "z"),
        (2, 0, "label one", "http://x/1"), (2, 1, "t", "a.html"), (2, 2, "two", "b"),
        (5, 0, "open", "q"), (5, 1, "inner", "r"), (5, 2, "still", "q"),
    ]
    assert not links.links_of(links.read_pages(spark.createDataFrame([], "page int, url string, html string"))).count()


def test_hits_from_a_saved_page(spark):
    page = '<table><tr><td>48500.000001/2024-11</td></tr></table><a href="doc?i=2">48500.000002/2024-12</a><a href="#old">48500.000002/2024-12</a><a href="/all">see 48500.000001/2024-11</a>'
    read = links.read_pages(spark.createDataFrame([("r1", "https://h/search/list?q=1", page)], "page string, url string, html string"))
    got = {x["process"]: x["href"] for x in portal.process_hits(read, links.links_of(read)).collect()}
    assert got == {"48500.000001/2024-11": None, "48500.000002/2024-12": "https://h/search/#old"}


def test_slices_by_bytes():
    b = pa.record_batch([pa.array(["a" * n if n else None for n in (5, 5, 20, 0, 1)])], names=["t"])
    assert [x.num_rows for x in links.batches_by_bytes(b, "t", 10)] == [2, 1, 2]
    assert [x.num_rows for x in links.batches_by_bytes(b.slice(1, 2), "t", 100)] == [2] and not list(links.batches_by_bytes(b.slice(0, 0), "t"))
