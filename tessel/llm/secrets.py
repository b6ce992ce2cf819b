"""Secret scans through an inverted index of trigrams.

From each rule's pattern a Boolean query of trigrams is derived: what every match has to hold, as alternatives of sets. One pass over the texts notes
which of the rules' trigrams a text holds; these postings (trigram, document) are written. Queries intersect postings: a rule's candidates are the
documents that stand in all postings of one of its alternatives. Candidates alone are verified with the pattern. Rules without a mandatory trigram scan all
texts, in the first pass. Only column expressions are used.

- Matches are leftmost and don't overlap within a rule; places count code points, the end is exclusive. A rule's ``least`` is asked of a match's group afterwards,
  so a match that is too short is dropped and still hides what overlaps it.
- Trigrams are of lower-cased texts: more candidates, none lost. Letters outside ASCII are never folded in a match.
- A null text counts as empty. Empty texts and texts without secrets have a row without spans. Texts of any length are scanned whole, and their
  places are added up by a window over a text's own matches. Repeated rows each have a row; null ids are ids like others. An empty table
  gives an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as _C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and the fewest characters of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def either_case(text: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


_WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
_FREE = r"[^\x20\x09-\x0D/@"
#: The shapes of secrets. The first three are the base rules; their runs are as long as can be, so the least length of the second and third is in the pattern.
RULES = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}"),
    Rule("bearer", either_case("bearer") + r"\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("login", rf"[a-z][a-z0-9+.-]{{1,20}}://{_FREE}:]{{1,64}}:{_FREE}]{{1,64}}@"),
)
BASE = ("assign", "access", "hex")
#: Of a query: alternatives, letters that a class may stand for, and trigrams of an alternative (bits of a long).
_MOST, _LETTERS, _BITS = 64, 6, 60
_ANY = frozenset([frozenset()])


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives: sets of trigrams, of which every lower-cased match holds all of one. None if nothing is mandatory."""
    query = _closed(*_walk(_parser.parse(pattern), _ANY, frozenset([""])))
    least = frozenset(a for a in query if not any(b < a for b in query))
    return None if frozenset() in query else least


def _and(a: frozenset, b: frozenset) -> frozenset:
    both = frozenset(x | y for x in a for y in b)
    return both if len(both) <= _MOST else min(a - _ANY or b, b - _ANY or a, key=len)


def _closed(query: frozenset, texts: frozenset) -> frozenset:
    """The query, and the trigrams of the text so far."""
    return _and(query, frozenset(frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in texts))


def _walk(items, query: frozenset, texts: frozenset) -> tuple[frozenset, frozenset]:
    """The query so far, and the texts that what came since its last gap may be."""

    def longer(ends: set[str]) -> None:
        nonlocal query, texts
        if len(texts) * len(ends) > _MOST:
            gap()
        texts = frozenset(a + b for a in texts for b in ends)

    def gap() -> None:
        nonlocal query, texts
        query, texts = _closed(query, texts), frozenset([""])

    def either(branches) -> None:
        nonlocal query, texts
        found = [_walk(b, _ANY, texts) for b in branches]
        joined = frozenset().union(*(t for _, t in found))
        if all(q == _ANY for q, _ in found) and len(joined) <= _MOST:
            texts = joined
        else:
            query, texts = _and(query, frozenset().union(*(_closed(*f) for f in found))), frozenset([""])

    for op, av in items:
        if op is _C.LITERAL:
            longer({chr(av).lower()})
        elif op is _C.IN:
            letters = {chr(c).lower() for kind, x in av if kind in (_C.LITERAL, _C.RANGE) for c in (range(x[0], x[1] + 1) if kind is _C.RANGE else (x,))}
            if any(kind not in (_C.LITERAL, _C.RANGE) for kind, _ in av) or len(letters) > _LETTERS:
                gap()
            else:
                longer(letters)
        elif op is _C.SUBPATTERN:
            query, texts = _walk(av[-1], query, texts)
        elif op is _C.BRANCH:
            either(av[1])
        elif op in (_C.MAX_REPEAT, _C.MIN_REPEAT):
            low, high, part = av
            if (low, high) == (0, 1):
                either([part, []])
                continue
            for _ in range(min(low, 3)):
                query, texts = _walk(part, query, texts)
            if high > min(low, 3):
                gap()
        elif op not in (_C.AT, _C.ASSERT, _C.ASSERT_NOT):
            gap()
    return query, texts


def matches(text: Column, rule: Rule) -> Column:
    """Array of a text's matches: i (from 0), skip (characters since the match before), size, and whether it counts."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    long = F.transform(hits if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    part = F.arrays_zip(F.transform(between, F.length).alias("skip"), F.transform(hits, F.length).alias("size"), long.alias("counts"))
    all_ = F.transform(F.filter(part, lambda x: x["size"].isNotNull()), lambda x, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("i"), x["skip"].alias("skip"), x["size"].alias("size"), x["counts"].alias("counts")))
    return F.when(F.regexp_like(text, pattern), all_).otherwise(F.array().cast("array<struct<kind:string,i:int,skip:int,size:int,counts:boolean>>"))


def _placed(found: DataFrame) -> DataFrame:
    """found: k1, k2, row, m (a match). Each span that counts, once: k1, k2, kind, start, end."""
    rows = found.select("k1", "k2", "row", "m.*")
    end = F.sum(F.col("skip").cast("long") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("i"))
    spans = rows.withColumn("end", end).where("counts")
    return spans.select("k1", "k2", "kind", (F.col("end") - F.col("size")).alias("start"), "end").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """id, text, and the 128-bit key of both."""
    rows = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64(F.lit(1), "id", "text"), "k2": F.xxhash64(F.lit(2), "id", "text")})


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...], ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (id, k1, k2, matches of the rules that have no query) and the postings (gram, k1, k2), both written."""
    queries = {r: trigram_query(r.pattern) for r in rules}
    grams = sorted(frozenset().union(*(a for q in queries.values() if q for a in q)))
    low = _keyed(docs).withColumn("low", F.lower("text"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    full = [matches(F.col("text"), r) for r in rules if queries[r] is None]
    read = ws.save(low.select("id", "k1", "k2", held.alias("grams"), (F.concat(*full) if full else matches(F.lit(""), rules[0])).alias("full")), "read")
    postings = ws.save(read.select(F.explode("grams").alias("gram"), "k1", "k2").sortWithinPartitions("gram"), "postings")
    return read, postings


def candidates(postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """k1, k2, kind: documents in all postings of one alternative of the rule's query."""
    terms = []
    for r in rules:
        for n, alternative in enumerate(sorted(map(sorted, trigram_query(r.pattern) or ()))):
            few = alternative[:_BITS]
            terms += [(r.kind, n, g, 1 << b, (1 << len(few)) - 1) for b, g in enumerate(few)]
    asked = postings.sparkSession.createDataFrame(terms, "kind string, alternative int, gram string, bit long, all long")
    met = postings.join(F.broadcast(asked), "gram")  # the rules' own trigrams
    return met.groupBy("k1", "k2", "kind", "alternative", "all").agg(F.bit_or("bit").alias("bits")).where(F.col("bits") == F.col("all")).select("k1", "k2", "kind").distinct()


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs: id, text. A row for each: id, and ``found``, its spans (start, rule, end) in order of start and rule's place in ``rules``."""
    ws = Workspace(docs.sparkSession, "secrets")
    read, postings = trigram_index(docs, rules, ws)
    likely = ws.save(candidates(postings, rules).groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds")), "candidates")
    texts = _keyed(docs).join(likely, ["k1", "k2"]).withColumn("row", F.monotonically_increasing_id())
    none = F.array().cast("array<struct<kind:string,i:int,skip:int,size:int,counts:boolean>>")
    verified = [F.when(F.array_contains("kinds", r.kind), matches(F.col("text"), r)).otherwise(none) for r in rules if trigram_query(r.pattern)]
    by_index = texts.select("k1", "k2", "row", F.explode(F.concat(none, *verified)).alias("m"))
    by_scan = read.where(F.size("full") > 0).withColumn("row", F.monotonically_increasing_id()).select("k1", "k2", "row", F.explode("full").alias("m"))
    spans = _placed(by_index).unionByName(_placed(by_scan))
    place = F.element_at(F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (r.kind, n)]), F.col("kind"))
    found = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", place.alias("rule"), "end"))).alias("found"))
    out = read.select("id", "k1", "k2").join(found, ["k1", "k2"], "left")
    return out.select("id", F.coalesce("found", F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")).alias("found"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    kinds = F.array(*[F.lit(r.kind) for r in RULES])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["rule"] < len(BASE))
    rules = F.transform("found", lambda s: s["rule"])
    counts = [(F.size(rules) - F.size(F.array_remove(rules, n))).cast("long").alias(f"n_{k}") for n, k in enumerate(BASE)]
    return secrets(docs).select(F.col("id").alias("doc_id"), *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def _sql_matches(n: int, r: Rule) -> str:
    p = "'" + r.pattern.replace("'", "''") + "'"
    return f"""SELECT num, {n} AS rule, generate_subscripts(hits, 1) AS i, unnest(list_transform(between[:len(hits)], lambda x: length(x))) AS skip, unnest(list_transform(hits, lambda x: length(x))) AS size, unnest(list_transform(parts, lambda x: length(x) >= {r.least})) AS counts
  FROM (SELECT num, string_split_regex(text, {p}) AS between, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {r.group}) AS parts FROM d WHERE regexp_matches(text, {p}))"""


_NAME = "(['" + "', '".join(r.kind for r in RULES) + "'])[rule + 1] || ':' || e - size || ':' || e"
QUERIES = {"op12_secret_scan": op12_secret_scan}
ORACLE = {
    "op12_secret_scan": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS num FROM documents),\nm AS ("
    + "\nUNION ALL ".join(itertools.starmap(_sql_matches, enumerate(RULES)))
    + f"""),
s AS (SELECT *, CAST(sum(skip + size) OVER (PARTITION BY num, rule ORDER BY i) AS BIGINT) AS e FROM m),
g AS (SELECT num, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
  string_agg({_NAME}, ',' ORDER BY e - size, rule) FILTER (WHERE rule < {len(BASE)}) AS base, string_agg({_NAME}, ',' ORDER BY e - size, rule) AS spans FROM s WHERE counts GROUP BY num)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (num)"""
}
