"""Citations in chunks of text, edges that follow from them and from similar families, and the ingestion job that keeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import collapse_space
from tessel.operators import graph, notify, state

#: How a notice of infraction is cited, and the key that a citation or a document's identifier holds.
CITATION = r"(?U)(?iu:auto\s+de\s+infra[çc][ãa]o)(?:\s*[–-]\s*AI\s*[–-])?\s*n[º°o]\.?\s*\d{1,4}/\d{4}(?:-[A-Z]{2,4}(?![A-Za-z]))?"
NOTICE_KEY = r"(?U)(?:(?iu:auto\s+de\s+infra[çc][ãa]o)|\bAI\b)(?:\s*[–-]\s*AI\s*[–-])?\s*(?:n[º°o]\.?\s*)?(\d{1,4})/(\d{4})(?:-([A-Z]{2,4})(?![A-Za-z]))?"
#: The scores between which families are similar, and the kinds of relation that a citation may name.
SIMILAR, SAME = 0.80, 0.97
EXPLICIT = ("referencia", "revoga", "altera", "responde_a", "regula")
EDGE_KEY = ["source", "target", "type"]


def citations(chunks: DataFrame, version: str = "version", locator: str = "locator", text: str = "text") -> DataFrame:
    """version, locator, identifier and pos (its first place in the chunk): each identifier once for each chunk."""
    found = chunks.select(F.col(version).alias("version"), F.col(locator).alias("locator"), F.posexplode(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))).alias("pos", "raw"))
    return found.groupBy("version", "locator", collapse_space(F.col("raw")).alias("identifier")).agg(F.min("pos").alias("pos"))


def notice_key(text: Column) -> Column:
    """number, year and suffix (null if there is none) of the first notice in a text; null without one."""
    return F.when(text.rlike(NOTICE_KEY), _key_parts(text))


def _key_parts(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, NOTICE_KEY, n)
    return F.struct(part(1).try_cast("int").alias("number"), part(2).try_cast("int").alias("year"), F.when(part(3) != "", part(3)).alias("suffix"))


def with_key(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text holds a notice, with its number, year and suffix. The key is generated, so that no filter or join that follows repeats the patterns."""
    c = F.col(text)
    return rows.select("*", F.inline(F.when(c.rlike(NOTICE_KEY), F.array(_key_parts(c)))))


def reference_edges(cited: DataFrame, versions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cited: of citations, and kind if a citation names one; versions: version, family; catalogue: family, document_id.

    A citation leads to the one family of the catalogue whose identifier fits it; none if several do, or the family itself."""
    kind = F.col("kind") if "kind" in cited.columns else F.lit(None).cast("string")
    refs = cited.select("version", "locator", "identifier", "pos", kind.alias("kind")).withColumn("type", F.when(F.col("kind").isin(*EXPLICIT), F.col("kind")).otherwise("referencia"))
    refs = with_key(refs, "identifier").select("number", "year", "suffix", "version", "locator", "pos", "type")
    known = with_key(catalogue.select("family", "document_id"), "document_id").select(F.col("family").alias("target"), "number", "year", "suffix").distinct()
    found = graph.unique_targets(refs, known).join(versions.select("version", "family"), "version").where("target <> family")  # the family of what is found only
    edges = found.select(F.col("family").alias("source"), "target", "type", F.lit("explicit").alias("origin"), F.lit("confirmed").alias("status"), F.lit(None).cast("double").alias("score"), F.col("version").alias("evidence_version"), F.col("locator").alias("evidence_locator"), "pos")
    return graph.first_wins(edges, EDGE_KEY, [F.col("evidence_version"), F.col("evidence_locator"), F.col("pos")]).drop("pos")


def similarity_edges(neighbors: DataFrame, families: DataFrame, similar: float = SIMILAR, same: float = SAME) -> DataFrame:
    """neighbors: src, dst, score. Suggested edges between families within the band, if the candidate is in the catalogue; each pair once, the smaller id first."""
    kept = neighbors.where((F.col("score") >= similar) & (F.col("score") < same)).join(families.select(F.col("family").alias("dst")), "dst", "left_semi")
    edges = kept.select(F.least("src", "dst").alias("source"), F.greatest("src", "dst").alias("target"), "src", "score").groupBy("source", "target").agg(F.min_by("score", "src").alias("score"))
    version = families.sparkSession.createDataFrame([], "evidence_version string, evidence_locator string")
    return edges.select("source", "target", F.lit("similar_a").alias("type"), F.lit("similarity").alias("origin"), F.lit("suggested").alias("status"), "score").join(version, F.lit(False), "left")


def derived_edges(references: DataFrame, similar: DataFrame) -> DataFrame:
    """Edges of both kinds; of equal keys that of a citation stays."""
    ranked = references.withColumn("evidence_version", F.col("evidence_version").cast("string")).withColumn("_k", F.lit(0)).unionByName(similar.withColumn("_k", F.lit(1)))
    return graph.first_wins(ranked, EDGE_KEY, [F.col("_k")]).drop("_k")


def checked(rows: DataFrame, required: tuple[str, ...] = (), **allowed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows that have all required columns and only allowed values in others, and the refused ones with their reasons."""
    missing = [F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing: {c}")) for c in required]
    wrong = [F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.concat(F.lit(f"not allowed: {c} "), F.coalesce(F.col(c).cast("string"), F.lit("null")))) for c, v in allowed.items()]
    judged = rows.withColumn("reasons", F.array_compact(F.array(*missing, *wrong)))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def ingest(docs: DataFrame, tables: dict[str, DataFrame], declared: DataFrame, derived: DataFrame, preferences: DataFrame, job: str, at: str) -> dict[str, DataFrame]:
    """One job: families and versions are upserted, declared edges overwrite, derived ones leave a stored status, subscribers are notified once.

    docs: version, family, document_id; tables: families, versions, relations, notifications as before the job; preferences: user_id.
    All rows of the job have one time. Returns the tables after the job, its events, digests, and a row of counts (summary)."""
    families = docs.select("family").distinct()
    arrived = docs.select("version", "family", "document_id", F.lit(at).alias("ingested_at"))
    relations = graph.merge(graph.merge(tables["relations"], declared, EDGE_KEY, []), derived, EDGE_KEY, ["status"])
    wanted = notify.fan_out(preferences.select("user_id"), arrived.select("version"))
    new, old = notify.split_new(wanted, tables["notifications"], ["user_id", "version"])
    made = new.select("user_id", "version", F.lit(job).alias("job"))
    digests = notify.digests(made, "user_id", "job", F.concat(F.lit("- "), F.col("version").cast("string")), F.col("version"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = lambda df, name: count(df, name).select(F.lit(1).alias("_k"), name)
    summary = one(families, "families_count").join(one(arrived, "versions_count"), "_k").join(one(declared, "declared"), "_k").join(one(derived, "derived"), "_k")
    return {
        "families": state.upsert(tables["families"], families, ["family"]),
        "versions": state.upsert(tables["versions"], arrived, ["version"]),
        "relations": relations,
        "notifications": tables["notifications"].select("user_id", "version", "job").unionByName(made),
        "events": notify.events_of(new, old, "user_id", "version").unionByName(notify.digest_events(digests), allowMissingColumns=True),
        "digests": digests,
        "summary": summary.select("families_count", "versions_count", (F.col("declared") + F.col("derived")).alias("relations_count")),
    }
