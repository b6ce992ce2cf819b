"""Merkle manifest of a data set: a tree for each group of rows, a tree over the groups' roots, and an inclusion proof for every row.

The nodes of all trees are one table of coordinates (tree, level, pos) and digests. A row's proof needs no walk: from its place in its group and the
group's size follow the coordinates of all siblings; these are exploded, joined with the node table, put in order and concatenated, and the row's digest
is folded through them.

- H is the lower-case hex SHA-256 of the joined inputs, digests as hex text. A leaf is H of its fields, each ``-`` if null, else its UTF-8 bytes' number,
  ``:`` and the value. A level's nodes become, eight by eight in order (fewer in the last run, even one), the next level's, until one is left.
- Rows of a group go by id, null ids first; rows with the same id by leaf. Groups go by their key, null first, bytewise. Repeated rows are leaves of their own.
- A group of one row has its leaf as root; if it is the only group, the leaf is the root of all and its proof has no siblings (H of nothing).
- Texts of any length are hashed where they are read; nothing but digests is shuffled. An empty table gives an empty result. Columns not named are ignored.

No task holds a group: places come from a sort by ranges and the sizes of the ranges before. Nodes near the roots, which very many rows ask for, are
broadcast: at most 8192 of a level whatever the table's size, as the parent of such a node stands above more than 1/1024 of all rows. The others have few
rows each that ask for them, and meet these in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm._store import Workspace, table

FAN = 8
#: A node is asked for widely if its parent stands above more than this share of all rows.
WIDELY = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def numbered(ws: Workspace, rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``idx``, their place in their group from 0, ``n``, the group's size, and ``row``, a number of their own.

    Rows are sorted by ranges of (group, order) and written; a row's place is its distance from its range's first row of the group, and how many rows of the
    group the ranges before have. The salt parts rows that are equal in all of these, which may be very many.
    """
    keys = [*group, *order, "salt"]
    salted = ws.save(rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))), f"{name}-read")  # looking for ranges reads the rows, too
    ranges = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    placed = ws.save(ranges.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), name)
    sizes = placed.groupBy("part", *group).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("size"))
    key = F.struct(F.lit(0), *group)
    before = F.sum("size").over(Window.partitionBy(key).orderBy("part")) - F.col("size")
    sizes = sizes.select("part", *group, (before - F.col("first")).alias("shift"), F.sum("size").over(Window.partitionBy(key)).alias("n"))
    same = F.col("r.part") == F.col("s.part")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}"))
    met = placed.alias("r").join(sizes.alias("s"), same)
    return met.select(*[F.col(f"r.{c}") for c in rows.columns], F.col("r.row"), (F.col("r.row") + F.col("shift")).alias("idx"), "n")


def levels_above(ws: Workspace, leaves: DataFrame, name: str) -> list[DataFrame]:
    """leaves: tree, pos, n, hash, rows. A table for each level: tree, level, pos, n (nodes of that level in the tree), hash, rows (of the data below) and ``asked``
    (of the data below the parent). The last levels have a row for each tree that reaches them."""
    out, level = [], leaves.withColumn("level", F.lit(0))
    while True:
        run = Window.partitionBy("tree", F.floor(F.col("pos") / FAN))
        here = ws.save(level.select("tree", "level", "pos", "n", "hash", "rows", F.sum("rows").over(run).alias("asked")), f"{name}-{len(out)}")
        out.append(here)
        more = here.where("n > 1")
        if more.isEmpty():
            return out
        parents = more.groupBy("tree", F.floor(F.col("pos") / FAN).alias("pos")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash"))).alias("below"), F.sum("rows").alias("rows"))
        level = parents.select("tree", F.lit(len(out)).alias("level"), "pos", F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join(F.transform("below", lambda x: x["hash"]), ""), 256).alias("hash"), "rows")


def _depth(n: Column) -> Column:
    """Levels between a tree's leaves and its root: how often n nodes become a eighth of them until one is left."""
    return F.size(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.when(F.pow(F.lit(float(FAN)), i) < n, i))))


def _runs(place: Column, n: Column, tree: Column, base: int) -> Column:
    """For each level below the root: the tree, its level from ``base`` on, the row's own node there, and the run's first and last node."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(float(FAN)), level).cast("long")
        own = F.floor(place / size)
        first = F.floor(own / FAN) * FAN
        last = F.least(first + FAN, F.ceil(n / size)) - 1
        return F.struct(tree.cast("long").alias("tree"), (level + base).cast("int").alias("level"), own.alias("own"), first.alias("first"), last.alias("last"))

    depth = _depth(n)
    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), at)).otherwise(F.array())


#: Levels of the tree over the groups are numbered from here; its tree has number -1.
TOP = 32


def manifest(leaves: DataFrame) -> DataFrame:
    """leaves: grp, id, leaf, tampered (a leaf or null), and columns that stay, but for those with names of the result. Adds subroot, root, proof_sha256 (H of
    the siblings' digests), folded_root (the tampered leaf folded through them, or the leaf where that is null) and verified."""
    ws = Workspace(leaves.sparkSession, "merkle")
    stay = [c for c in leaves.columns if c not in ("leaf", "tampered", "grp", "subroot", "root", "proof_sha256", "folded_root", "verified")]
    leaves = leaves.select("grp", "id", "leaf", "tampered", F.struct(*stay).alias("stay"))
    rows = numbered(ws, leaves, ["grp"], ["id", "leaf"], "leaves")
    groups = rows.where("idx = 0").select("grp", "n")
    groups = numbered(ws, groups.withColumnRenamed("n", "size"), [], ["grp"], "groups").select("grp", F.col("idx").alias("tree"), F.col("n").alias("trees"))
    # each range of rows has few groups: meeting them there spares a join by the group, which may be a third of all rows
    rows = ws.save(_with_groups(rows, groups), "rows")
    total = rows.count()
    nodes = levels_above(ws, rows.select("tree", F.col("idx").alias("pos"), "n", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("rows")), "nodes")
    roots = _union([t.where("n = 1") for t in nodes])
    n_trees = roots.count()
    top = levels_above(ws, roots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "hash", "rows"), "top")
    root = top[-1].select("hash").first() if n_trees else None
    every = _union([*nodes, *(t.withColumn("level", F.col("level") + TOP) for t in top)]).select("tree", "level", "pos", F.unhex("hash").alias("hash"), "asked")

    runs = F.concat(_runs(F.col("idx"), F.col("n"), F.col("tree"), 0), _runs(F.col("tree"), F.col("trees"), F.lit(-1), TOP))
    siblings = F.flatten(F.transform(runs, lambda r: F.transform(F.filter(F.sequence(r["first"], r["last"]), lambda p: p != r["own"]), lambda p: F.struct(r["tree"].alias("tree"), r["level"].alias("level"), p.alias("pos")))))
    own_root = F.struct(F.lit(-1).cast("long").alias("tree"), F.lit(TOP).alias("level"), F.col("tree").alias("pos"))
    asked = rows.select("row", F.explode(F.array_append(siblings, own_root)).alias("at")).select("row", "at.*")
    widely = F.col("asked") * WIDELY > total
    key = ["tree", "level", "pos"]
    hot = every.where(widely).select(*key, "hash")
    cold = every.where(~widely).select(*key, "hash")
    near = asked.join(F.broadcast(hot), key, "left")
    found = near.where("hash IS NOT NULL").unionByName(near.where("hash IS NULL").drop("hash").join(cold, key)).select("row", "level", "pos", "hash")

    hex_ = lambda x: F.lower(F.hex(x["hash"]))
    met = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("level", "pos", "hash"))).alias("found"))
    out = rows.join(met, "row")
    is_own = lambda x: (x["level"] == TOP) & (x["pos"] == F.col("tree"))
    out = out.withColumn("subroot", hex_(F.filter("found", is_own)[0])).withColumn("proof", F.array_join(F.transform(F.filter("found", lambda x: ~is_own(x)), hex_), ""))

    def step(acc: Column, run: Column) -> Column:
        left, right = run["own"] - run["first"], run["last"] - run["own"]
        text = lambda skip, n: F.substring(F.col("proof"), (acc["used"] + skip) * 64 + 1, n * 64)
        return F.struct((acc["used"] + left + right).cast("long").alias("used"), F.sha2(F.concat(text(F.lit(0), left), acc["hash"], text(left, right)), 256).alias("hash"))

    start = F.struct(F.lit(0).cast("long").alias("used"), F.coalesce("tampered", "leaf").alias("hash"))
    folded = F.aggregate(runs, start, step)["hash"]
    result = out.select("stay.*", "leaf", "subroot", F.lit(root["hash"] if root else None).cast("string").alias("root"), F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root"))
    return result.withColumn("verified", F.col("folded_root") == F.col("root"))


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the number of their group and how many groups there are; joined by (part, group), as a group may have most rows and a part has few groups."""
    part = F.shiftright("row", 33)
    parts = rows.select(part.alias("part"), "grp").distinct().alias("p").join(groups.alias("g"), F.col("p.grp").eqNullSafe(F.col("g.grp"))).select("part", F.col("p.grp").alias("grp"), "tree", "trees")
    met = rows.withColumn("part", part).alias("r").join(parts.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.grp").eqNullSafe(F.col("p.grp")))
    return met.select(*[F.col(f"r.{c}") for c in rows.columns if c != "grp"], "tree", "trees")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    leaf = lambda text: digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = F.translate("text", _UPPER, _LOWER)
    leaves = d.select("doc_id", F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf(F.col("text")).alias("leaf"), F.when(changed & (low != F.col("text")), leaf(low)).alias("tampered"))
    return manifest(leaves).drop("id")


_CRC = """CAST(xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), CAST(4294967295 AS BIGINT)) AS BIGINT)"""
_F = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join([*map(_F, ("doc_id", "source", "lang", "n_chars")), _F(text)]) + ")"
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLE = {
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_LEAF("text")} END AS now FROM documents),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM documents)),
r AS (SELECT d.*, tree, trees, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS num FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
t(tree, level, pos, n, hash) AS (SELECT tree, 0, idx, n, leaf FROM r UNION ALL
  SELECT tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, level, pos // 8, n),
u(tree, level, pos, n, hash) AS (SELECT -1, 32, tree, (SELECT max(trees) FROM g), hash FROM t WHERE n = 1 UNION ALL
  SELECT -1, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, pos // 8, n),
nodes AS (SELECT * FROM t UNION ALL SELECT * FROM u),
path AS (SELECT num, r.tree, l AS level, idx // CAST(8 ** l AS BIGINT) AS own FROM r, generate_series(0, 20) x(l) WHERE 8 ** l < n
  UNION ALL SELECT num, -1, 32 + l, tree // CAST(8 ** l AS BIGINT) FROM r, generate_series(0, 20) x(l) WHERE 8 ** l < trees),
s AS (SELECT num, p.level, row_number() OVER (PARTITION BY num ORDER BY p.level) AS step, coalesce(string_agg(hash, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS "left", coalesce(string_agg(hash, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS "right"
  FROM path p JOIN nodes q ON q.tree = p.tree AND q.level = p.level AND q.pos // 8 = p.own // 8 GROUP BY num, p.level),
f(num, step, hash) AS (SELECT num, 0, now FROM r UNION ALL SELECT f.num, f.step + 1, sha256("left" || hash || "right") FROM f JOIN s ON s.num = f.num AND s.step = f.step + 1),
p AS (SELECT num, max(step) AS steps, string_agg("left" || "right", '' ORDER BY step) AS proof FROM s GROUP BY num)
SELECT doc_id, leaf, v.hash AS subroot, w.hash AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.hash AS folded_root, f.hash = w.hash AS verified
FROM r JOIN u v ON v.level = 32 AND v.pos = r.tree JOIN (SELECT hash FROM u WHERE n = 1) w ON true LEFT JOIN p USING (num) JOIN f ON f.num = r.num AND f.step = coalesce(steps, 0)"""
}
