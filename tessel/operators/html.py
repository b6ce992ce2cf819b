"""HTML as Markdown blocks: paragraphs, headings and tables in document order, without signature blocks and reference footers.

A small tree is built with the standard library's parser for each page; pages are spread by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Fixed values.
NO_CONTENT = frozenset(("script", "style", "meta", "title", "link", "hr", "img"))
HEADINGS = {f"h{n}": n for n in range(1, 7)}
BLOCKS = frozenset(("p", "div", "table", *HEADINGS))
PIECE, PIECE_ROWS = 1_000_000, 256
VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"))
FOOTER = re.compile(r"^Refer[êe]ncia:\s*Processo\s*n[ºo°]\.?\s*[\d./-]+\s+SEI\s*n[ºo°]\.?\s*\d+$", re.IGNORECASE)


class Node:
    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.inner = tag, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "table"):
            self._end("p", ("table", "td", "th"))  # a paragraph or table ends the paragraph before it, in its own cell
        node = Node(tag, dict(attrs))
        self.open[-1].inner.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inner.append(Node(tag, dict(attrs)))

    def handle_endtag(self, tag):
        self._end(tag, ("td", "th") if tag == "p" else ())

    def _end(self, tag, within):
        """Closes the innermost open element of that tag, unless one of those of ``within`` is open inside it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in within:
                return

    def handle_data(self, data):
        self.open[-1].inner.append(data)


def inline(node: Node) -> str:
    """Visible text; a line break is a line end, cell ends are blanks, links give their text only."""
    parts = []
    for x in node.inner:
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        elif x.tag not in NO_CONTENT:
            parts.append(" " * (x.tag in ("td", "th", "tr")) + inline(x))
    return "".join(parts)


def _is_boilerplate(node: Node) -> bool:
    if node.tag == "div":
        return node.attrs.get("unselectable") == "on"
    return node.tag == "table" and bool(FOOTER.match(" ".join(inline(node).split())))


def _rows(table: Node) -> list[Node]:
    return [r for x in table.inner if isinstance(x, Node) for r in ([x] if x.tag == "tr" else [y for y in x.inner if isinstance(y, Node) and y.tag == "tr"] if x.tag in ("thead", "tbody", "tfoot") else [])]


def _span(cell: Node) -> int:
    value = cell.attrs.get("colspan") or ""
    return max(1, int(value)) if re.fullmatch(r"\s*\d+\s*", value) else 1


def table_markdown(table: Node) -> str | None:
    rows = []
    for tr in _rows(table):
        cells = [c for c in tr.inner if isinstance(c, Node) and c.tag in ("td", "th")]
        if cells:
            rows.append([x for c in cells for x in [" ".join(inline(c).split()).replace("|", "\\|"), *[""] * (_span(c) - 1)]])
    if not rows:
        return None
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def blocks(node: Node) -> list[str]:
    out, run = [], []

    def close():
        text = "".join(run).strip()
        run.clear()
        if text:
            out.append(text)

    for x in node.inner:
        if isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append("\n")
        elif x.tag in NO_CONTENT or _is_boilerplate(x):
            continue
        elif x.tag in BLOCKS:
            close()
            if x.tag == "div":
                out += blocks(x)
            elif x.tag == "table":
                out += [t for t in [table_markdown(x)] if t]
            else:
                text = inline(x).strip()
                out += ["#" * HEADINGS[x.tag] + " " + text if x.tag in HEADINGS else text] if text else []
        elif any(isinstance(y, Node) for y in x.inner) and x.tag in ("html", "head", "body", "noscript", "article", "main", "section", "header", "footer", "nav", "ul", "ol", "li", "form", "center"):
            close()
            out += blocks(x)
        else:
            run.append(inline(x))
    close()
    return out


def to_blocks(html: str) -> list[str]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return blocks(builder.root)


def _in_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Blocks of a few pages at a time, about a million characters: of a batch only its Arrow bytes are held, no trees, texts or blocks of all its pages."""
    for pages in batches:
        out, size = [], 0
        for page in pages:
            html = page.as_py()
            out.append(None if html is None else to_blocks(html))
            size += len(html or "")
            if size >= PIECE or len(out) == PIECE_ROWS:
                yield pa.array(out, pa.list_(pa.string()))
                out, size = [], 0
        if out:
            yield pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def html_blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _in_pieces(batches)


def latin1_text(content: Column) -> Column:
    """Bytes of a page, which are always read as ISO-8859-1."""
    return F.decode(content, "ISO-8859-1")
