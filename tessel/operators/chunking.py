"""Structural chunks of Markdown with page markers.

Blocks (headings, tables, paragraphs) are gathered into chunks of about ``TARGET`` tokens, never past ``MOST`` by gathering. A block above MOST
is split first: tables by rows with their header repeated, anything else at sentence ends with ``OVERLAP`` tokens taken over. A chunk's
section is the heading in force when its first block came; the overlap is taken over only from a paragraph to a paragraph.

Token counts come from a port; the default splits text into words and single marks, as the reference's vocabulary file isn't at hand, so counts
differ from it while the structure rules do not. Each document is read by one function call, documents are spread by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TARGET, MOST, OVERLAP = 600, 800, 100
_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARKER = re.compile(r"^<!--\s*page:(\d+)\s*-->\s*$")
_GAP = re.compile(r"\S {2,}\S")
_SENTENCE = re.compile(r"(?<=[.;:!?])\s+")
#: From the white space before the last word on, and up to the white space behind the first one; None where there is no such place.
_LAST_WORD, _FIRST_WORD = re.compile(r"(?<=\S)\s+\S+\s*\Z"), re.compile(r"\s*\S+(?=\s)")
SCHEMA = "key string, chunk_index int, chunk_id string, section string, page_start int, page_end int, token_count int, text string"


def spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


@dataclass
class Block:
    lines: list[str]
    kind: str
    first: int | None
    last: int | None
    text: str = field(init=False)
    n: int = 0  # tokens, as soon as a chunker has counted them
    joined: tuple[Block, int] | None = None  # the block it was last put behind, and how many tokens the two have more or less for that

    def __post_init__(self):
        self.text = "\n".join(self.lines)


def heading(line: str) -> bool:
    s = line.strip()
    letters = [c for c in s if c.isalpha()]
    return bool(s) and len(s) <= 120 and not _GAP.search(s) and len(letters) >= 3 and sum(c.isupper() for c in letters) >= 0.8 * len(letters)


def kind_of(lines: list[str]) -> str:
    if len(lines) == 1 and heading(lines[0]):
        return "heading"
    gaps = sum(bool(_GAP.search(x.strip())) for x in lines)
    return "table" if len(lines) >= 2 and gaps >= 0.6 * len(lines) else "paragraph"


def blocks_of(markdown: str) -> list[Block]:
    """Runs of lines between blank lines. A page marker sets the page of what follows and ends no run."""
    out, lines, pages, page = [], [], [], None
    for line in [*markdown.splitlines(), ""]:
        marker = _MARKER.match(line.strip())
        if marker:
            page = int(marker[1])
        elif line.strip():
            lines.append(line)
            pages.append(page)
        elif lines:
            out.append(Block(lines, kind_of(lines), pages[0], pages[-1]))
            lines, pages = [], []
    return out


class Chunker:
    """``tokens``: the places of a text's tokens. How joined texts are counted:

    - ``additive``: their tokens are those of the texts. So for the default, which never joins across white space.
    - ``by_words``: a text may be cut before white space that follows a word, and its tokens are those of both parts. So for tokenizers that look at words (with the white space
      before them) one by one, as byte-level BPE does. What changes where two texts are joined are then the last word of one and the first of the other: these alone are counted again.
    - else joined texts are counted anew, which takes long for long texts.
    """

    def __init__(self, tokens: Callable[[str], list[tuple[int, int]]] = spans, target: int = TARGET, most: int = MOST, overlap: int = OVERLAP, additive: bool | None = None, by_words: bool = False):
        self.tokens, self.target, self.most, self.overlap = tokens, target, most, overlap
        self.additive, self.by_words = tokens is spans if additive is None else additive, by_words

    def count(self, text: str) -> int:
        return len(self.tokens(text))

    def seam(self, left: str, between: str, right: str) -> int:
        """How many tokens left, between and right have together more than left and right alone."""
        if self.additive or not left or not right:
            return 0
        if self.by_words:
            last, first = _LAST_WORD.search(left), _FIRST_WORD.match(right)
            left, right = left[last.start() :] if last else left, first[0] if first else right
        return self.count(left + between + right) - self.count(left) - self.count(right)

    def _behind(self, left: Block, right: Block) -> int:
        if right.joined is None or right.joined[0] is not left:
            right.joined = left, self.seam(left.text, "\n\n", right.text)
        return right.joined[1]

    def tail(self, text: str) -> str:
        found = self.tokens(text)
        return text if len(found) <= self.overlap else text[found[-self.overlap][0] :]

    def _block(self, lines: list[str], kind: str, first: int | None, last: int | None) -> Block:
        block = Block(lines, kind, first, last)
        block.n = self.count(block.text)
        return block

    def fitting(self, block: Block) -> Iterator[Block]:
        """The block, or its parts if it is too large. A single sentence or row can stay too large."""
        block.n = self.count(block.text)
        if block.n <= self.most:
            yield block
            return
        made = self._rows(block.lines) if block.kind == "table" else self._sentences(block.text)
        kind = "table" if block.kind == "table" else "paragraph"
        parts = [self._block(lines, kind, block.first, block.last) for lines in made]
        yield from parts or [block]

    def _rows(self, lines: list[str]) -> Iterator[list[str]]:
        head = self.count(lines[0])
        held, n = lines[:1], head
        for row in lines[1:]:
            own = self.count(row)
            if len(held) > 1 and n + own + self.seam(held[-1], "\n", row) > self.most:
                yield held
                held, n = lines[:1], head
            n += own + self.seam(held[-1], "\n", row)
            held.append(row)
        if len(held) > 1:
            yield held

    def _sentences(self, text: str) -> Iterator[list[str]]:
        held, n = "", 0
        for sentence in _SENTENCE.split(text):
            own = self.count(sentence)
            longer, more = (f"{held} {sentence}".strip(), own + self.seam(held, " ", sentence)) if held else (sentence, own)
            if held and n + more > self.most:
                yield held.split("\n")
                end = self.tail(held)
                longer, n, more = f"{end} {sentence}".strip(), self.count(end), own + self.seam(end, " ", sentence)
            held = longer
            n += more
        if held:
            yield held.split("\n")

    def chunks(self, markdown: str, key: str) -> list[tuple]:
        out: list[tuple] = []
        held: list[Block] = []
        section = of_chunk = None

        def text_of(blocks: list[Block]) -> str:
            return "\n\n".join(b.text for b in blocks)

        def size(*extra: Block) -> int:
            blocks = [*held, *extra]
            return sum(b.n for b in blocks) + (0 if self.additive else sum(map(self._behind, blocks, blocks[1:])))

        def flush(coming: Block | None) -> None:
            nonlocal held
            if not held:
                return
            pages = [p for b in held for p in (b.first, b.last) if p is not None]
            out.append((key, len(out), f"{key}#chunk-{len(out):04d}", of_chunk, min(pages, default=None), max(pages, default=None), size(), text_of(held)))
            last = held[-1]
            seed = coming is not None and last.kind == coming.kind == "paragraph"
            held = [self._block(self.tail(last.text).split("\n"), "paragraph", last.last, last.last)] if seed else []

        blocks = [p for b in blocks_of(markdown) for p in self.fitting(b)]
        for i, block in enumerate(blocks):
            following = blocks[i + 1] if i + 1 < len(blocks) else None
            if block.kind == "heading":
                if held and size() >= self.target:
                    flush(block)
                section = block.text.strip()
            elif held and size(block) > self.most:
                flush(block)
                if held and size(block) > self.most:
                    held = []
            if not held:
                of_chunk = section
            held.append(block)
            if block.kind != "heading" and size() >= self.target:
                flush(following)
        if held:
            flush(None)
        return out


def spread(rows: DataFrame) -> DataFrame:
    """Dealt over the session's cores if a small input has fewer partitions than these."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def chunk_documents(docs: DataFrame, key: str, text: str, chunker: Chunker | None = None) -> DataFrame:
    """One row for each chunk. Null and blank texts have none."""
    made = chunker or Chunker()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for k, t in zip(frame["k"], frame["t"]) if t for r in made.chunks(t, k)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"page_start": "Int32", "page_end": "Int32"})

    return spread(docs.select(docs[key].cast("string").alias("k"), docs[text].alias("t"))).mapInPandas(run, SCHEMA)
