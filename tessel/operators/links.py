"""Text and links of saved pages, HTML or Markdown.

A page's text are its pieces of character data, stripped, a line each; a link's label is such a piece within the innermost open ``a`` with an address. Pages are
read in parts of an Arrow batch that are bounded by bytes, so that a few very long ones don't meet in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_BYTES = 8 << 20
_LINK = pa.struct([("pos", pa.int32()), ("label", pa.string()), ("href", pa.string())])


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.links: list[dict] = []
        self._open: list[str | None] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self._open.append(dict(attrs).get("href"))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self._open:
            self._open.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pass  # holds nothing

    def handle_data(self, data: str) -> None:
        if value := data.replace("\xa0", " ").strip():
            self.text.append(value)
            if href := next((x for x in reversed(self._open) if x), None):
                self.links.append({"pos": len(self.links), "label": value, "href": href})


def batches_by_bytes(batch: pa.RecordBatch, column: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of a text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def read_pages(pages: DataFrame) -> DataFrame:
    """pages: page, url, html. page, url, text, and links: array of (pos from 0, label, href) in the page's order. A null page has no text and no links;
    a page without any character data has itself as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_by_bytes(whole, "html"):
                texts, links = [], []
                for page in b.column("html").to_pylist():
                    parser = _Links()
                    parser.feed(page or "")
                    parser.close()
                    texts.append("\n".join(parser.text) or page)
                    links.append(parser.links)
                yield pa.record_batch([b.column("page"), b.column("url"), pa.array(texts, pa.string()), pa.array(links, pa.list_(_LINK))], names=["page", "url", "text", "links"])

    rows = pages.select("page", "url", "html")
    kind = rows.schema["page"].dataType.simpleString()
    return rows.mapInArrow(run, f"page {kind}, url string, text string, links array<struct<pos:int,label:string,href:string>>")


def markdown_links(text: Column) -> Column:
    """Links of Markdown, ``[label](href)``, but for pictures: array of (pos, label, href)."""
    pattern = r'(?<!!)\[([^\[\]]*)\]\(<?([^()\s<>]+)>?(?:\s+"[^"]*")?\)'
    labels, hrefs = (F.regexp_extract_all(text, F.lit(pattern), F.lit(n)) for n in (1, 2))
    return F.transform(F.arrays_zip(labels.alias("label"), hrefs.alias("href")), lambda x, i: F.struct(i.cast("int").alias("pos"), F.trim(x["label"]).alias("label"), x["href"].alias("href")))


def links_of(pages: DataFrame) -> DataFrame:
    """pages: of ``read_pages``. A row for each link: page, pos, label, href; those of the HTML, or of the Markdown where there are none."""
    own = F.when(F.size("links") > 0, F.col("links")).otherwise(F.coalesce(markdown_links(F.col("text")), F.array().cast("array<struct<pos:int,label:string,href:string>>")))
    return pages.select("page", F.inline(own)).select("page", "pos", "label", "href")
