"""Graph queries. Stand-ins: an order line is an edge from its order to its supplier; return flags are edge kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.operators import graph as op


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _edges(spark, d):
    """Edges between suppliers and parts' remainders, so that both ends share one range of numbers."""
    return _t(spark, d, "lineitem").select((F.col("l_partkey") % 100).alias("source"), (F.col("l_suppkey") % 100).alias("target"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("line"))


def graph_neighbors(spark, d):
    """Neighbours of all nodes."""
    e = _edges(spark, d)
    a = op.adjacent(e, e.select(F.col("source").alias("node")).union(e.select("target")).distinct())
    return a.groupBy("node", "other", "type").agg(F.count(F.lit(1)).alias("n"))


def graph_degree(spark, d):
    """Number of distinct opposite ends of every node, by kind."""
    e = _edges(spark, d)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return op.adjacent(e.select("source", "target", "type").distinct(), nodes).groupBy("node", "type").agg(F.countDistinct("other").alias("others"))


def graph_both_ends(spark, d):
    """Edges between two suppliers' numbers."""
    members = _t(spark, d, "supplier").where("s_nationkey < 12").select((F.col("s_suppkey") % 100).alias("node")).distinct()
    return op.both_ends(_edges(spark, d), members).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def node_kind(spark, d):
    """The kind of every node: families, processes and both ends of all edges."""
    e = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.lit("order").alias("source_kind"), (F.col("l_partkey") + 100000).alias("target"), F.lit("part").alias("target_kind"))
    families, processes = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("family")), _t(spark, d, "nation").select(F.col("n_nationkey").alias("process"))
    ids = e.select(F.col("source").cast("long").alias("node")).distinct().union(e.select(F.col("target").cast("long")).distinct()).union(families.select(F.col("family").cast("long"))).union(processes.select(F.col("process").cast("long"))).where("node IS NOT NULL").distinct()
    return op.node_kind(ids, families, processes, e)


def edge_first_wins(spark, d):
    e = _edges(spark, d)
    return op.first_wins(e, ["source", "target", "type"], [F.col("pos"), F.col("line")]).select("source", "target", "type", "status", "pos")


def edge_merge_keep_status(spark, d):
    """Derived edges (odd orders) over stored ones (even): score and place are overwritten, the stored status stays."""
    e = op.first_wins(_edges(spark, d).where("pos % 2 = 0"), ["source", "target", "type"], [F.col("pos"), F.col("line")]).select("source", "target", "type", "status", "pos")
    n = op.first_wins(_edges(spark, d).where("pos % 2 = 1"), ["source", "target", "type"], [F.col("pos"), F.col("line")]).select("source", "target", "type", "status", "pos")
    return op.merge(e, n, ["source", "target", "type"], ["status"])


def edge_merge_overwrite(spark, d):
    e = op.first_wins(_edges(spark, d).where("pos % 2 = 0"), ["source", "target", "type"], [F.col("pos"), F.col("line")]).select("source", "target", "type", "status", "pos")
    n = op.first_wins(_edges(spark, d).where("pos % 2 = 1"), ["source", "target", "type"], [F.col("pos"), F.col("line")]).select("source", "target", "type", "status", "pos")
    return op.merge(e, n, ["source", "target", "type"], [])


def edges_by_type(spark, d):
    e = _edges(spark, d)
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


def ref_extract(spark, d):
    """Words in front of an e-mail sign, first occurrence in each document."""
    docs = _t(spark, d, "documents").select("doc_id", F.posexplode(F.expr(r"regexp_extract_all(text, '([A-Za-z0-9._-]+)@([A-Za-z0-9.-]+)', 0)")).alias("pos", "ref"))
    return docs.groupBy("doc_id", "ref").agg(F.min("pos").alias("pos")).select("doc_id", "ref")


def ref_resolve_unique(spark, d):
    """Orders cite customers by (number, year); a third of the citations have no suffix."""
    o = _t(spark, d, "orders")
    suffix = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.substring("o_orderpriority", 1, 1))
    refs = o.select(F.col("o_custkey").alias("family"), (F.col("o_orderkey") % 997).alias("number"), F.year("o_orderdate").alias("year"), suffix.alias("suffix")).distinct()
    targets = o.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("target"), (F.col("o_orderkey") % 997).alias("number"), F.year("o_orderdate").alias("year"), suffix.alias("suffix")).distinct()
    return op.resolve_unique(refs, targets)


def related_reasons(spark, d):
    """Confirmed edges (status F) of related kinds, from either end; a self-loop once."""
    e = _edges(spark, d).where("status = 'F' AND type IN ('A', 'R')").select("source", "target", "type").distinct()
    nodes = spark.range(100).select(F.col("id").alias("node"))
    return op.adjacent(e, nodes).select("node", "other", "type").distinct()


_E = "SELECT l_partkey % 100 AS source, l_suppkey % 100 AS target, l_returnflag AS type, l_linestatus AS status, l_orderkey AS pos, l_linenumber AS line FROM lineitem"
_FIRST = "SELECT source, target, type, status, pos FROM e {} QUALIFY row_number() OVER (PARTITION BY source, target, type ORDER BY pos, line, status) = 1"
_ADJ = "SELECT source AS node, target AS other, * FROM e UNION ALL SELECT target, source, * FROM e WHERE source <> target"
_MERGE = f"WITH e AS ({_E}), o AS ({_FIRST.format('WHERE pos % 2 = 0')}), n AS ({_FIRST.format('WHERE pos % 2 = 1')}) SELECT source, target, type, {{}} AS status, coalesce(n.pos, o.pos) AS pos FROM o FULL JOIN n USING (source, target, type)"
_REF = "SELECT DISTINCT o_custkey AS family, o_orderkey % 997 AS number, year(o_orderdate) AS year, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE substr(o_orderpriority, 1, 1) END AS suffix FROM orders"

QUERIES = {f.__name__: f for f in (graph_neighbors, graph_degree, graph_both_ends, node_kind, edge_first_wins, edge_merge_keep_status, edge_merge_overwrite, edges_by_type, ref_extract, ref_resolve_unique, related_reasons)}
ORACLE = {
    "graph_neighbors": f"WITH e AS ({_E}) SELECT node, other, type, count(*) AS n FROM ({_ADJ}) GROUP BY ALL",
    "graph_degree": f"WITH e AS ({_E}) SELECT node, type, count(DISTINCT other) AS others FROM ({_ADJ}) GROUP BY ALL",
    "graph_both_ends": f"WITH e AS ({_E}), m AS (SELECT DISTINCT s_suppkey % 100 AS node FROM supplier WHERE s_nationkey < 12) SELECT source, target, count(*) AS n FROM e WHERE source IN (SELECT node FROM m) AND target IN (SELECT node FROM m) GROUP BY ALL",
    "node_kind": """WITH s AS (SELECT DISTINCT s_suppkey AS i FROM supplier), n AS (SELECT DISTINCT n_nationkey AS i FROM nation), o AS (SELECT DISTINCT l_orderkey AS i FROM lineitem), p AS (SELECT DISTINCT l_partkey + 100000 AS i FROM lineitem),
  x AS (SELECT i FROM s UNION SELECT i FROM n UNION SELECT i FROM o UNION SELECT i FROM p)
SELECT CAST(x.i AS BIGINT) AS node, CASE WHEN s.i IS NOT NULL THEN 'family' WHEN n.i IS NOT NULL THEN 'process' WHEN o.i IS NOT NULL THEN 'order' ELSE 'part' END AS kind
  FROM x LEFT JOIN s ON x.i = s.i LEFT JOIN n ON x.i = n.i LEFT JOIN o ON x.i = o.i LEFT JOIN p ON x.i = p.i WHERE x.i IS NOT NULL""",
    "edge_first_wins": f"WITH e AS ({_E}) " + _FIRST.format(""),
    "edge_merge_keep_status": _MERGE.format("coalesce(o.status, n.status)"),
    "edge_merge_overwrite": _MERGE.format("coalesce(n.status, o.status)"),
    "edges_by_type": f"WITH e AS ({_E}) SELECT type, count(*) AS n, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses FROM e GROUP BY 1",
    "ref_extract": "SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._-]+)@([A-Za-z0-9.-]+)', 0)) AS ref FROM documents",
    "ref_resolve_unique": f"""WITH r AS ({_REF}), t AS ({_REF} WHERE o_orderkey % 2 = 0)
SELECT r.family, r.number, r.year, r.suffix, min(t.family) AS target FROM r JOIN t ON r.number = t.number AND r.year = t.year AND (r.suffix IS NULL OR t.suffix IS NULL OR r.suffix = t.suffix)
GROUP BY ALL HAVING count(DISTINCT t.family) = 1 AND min(t.family) <> r.family""",
    "related_reasons": f"WITH e AS (SELECT DISTINCT source, target, type FROM ({_E}) WHERE status = 'F' AND type IN ('A', 'R')) SELECT DISTINCT node, other, type FROM ({_ADJ})",
}
#: An older name of the same.
QUERIES["node_kind_whole"], ORACLE["node_kind_whole"] = node_kind, ORACLE["node_kind"]
