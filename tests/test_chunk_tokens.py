"""Chunks by a real tokenizer: exact counts without counting joined texts anew."""

import random
import time

import pytest

from tessel.operators.chunking import Chunker, blocks_of

PATH = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokens():
    library = pytest.importorskip("tokenizers")
    try:
        t = library.Tokenizer.from_file(PATH)
    except Exception:
        pytest.skip("no vocabulary here")
    return lambda text: t.encode(text, add_special_tokens=False).offsets


def text_of(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Contrato", "nº", "51/2026", "ção", "...", "x" * 30, "I'm", "don't", "日本", " ", "$", "1,000.50", "—", "é"])
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.08:
            out.append(f"<!-- page:{len(out)} -->")
        elif kind < 0.15:
            out.append(r.choice(["I – DA IDENTIFICAÇÃO", "II - DOS FATOS"]))
        elif kind < 0.25:
            out.append("\n".join(f"{word()}   {word()}    {word()}" for _ in range(r.randint(2, 40))))
        else:
            out.append(" ".join(word() + r.choice(["", "", "", ".", ";", "  "]) for _ in range(r.randint(1, 200))).replace("; ", ";\n", 1))
        out.append(r.choice(["", "", " ", "\t"]))
    return "\n".join(out)


@pytest.mark.parametrize("sizes", [(600, 800, 100), (40, 60, 10), (5, 8, 3)])
def test_equal_to_counting_anew(tokens, sizes):
    fast, slow = Chunker(tokens, *sizes, by_words=True), Chunker(tokens, *sizes, additive=False)
    slow.seam = lambda left, between, right: slow.count(left + between + right) - slow.count(left) - slow.count(right) if left and right else 0
    for seed in range(12):
        text = text_of(seed, 30)
        got = fast.chunks(text, "k")
        assert got == slow.chunks(text, "k") and len(got) > 1
        assert all(c[6] == fast.count(c[7]) for c in got)  # the count is that of the chunk's text


def test_seams(tokens):
    c = Chunker(tokens, by_words=True)
    r = random.Random(1)
    parts = ["a", " ", "\n", "  ", "word", "I'm", "123", " ", "日", "!?", "\t", "é"]
    for _ in range(4000):
        left, right = ("".join(r.choice(parts) for _ in range(r.randint(1, 6))).strip() for _ in "ab")
        for between in (" ", "\n", "\n\n"):
            assert c.count(left) + c.count(right) + c.seam(left, between, right) == c.count(left + between + right) or not left or not right, (left, between, right)


def test_time(tokens):
    """A long text costs about as much as counting its tokens a few times, not a square of it."""
    text = "\n\n".join(text_of(s, 30) for s in range(40))
    began = time.perf_counter()
    for b in blocks_of(text):
        tokens(b.text)
    once = time.perf_counter() - began
    began = time.perf_counter()
    Chunker(tokens, by_words=True).chunks(text, "k")
    assert time.perf_counter() - began < 12 * once + 1
