"""The ingestion job over stored tables: all that a job changes is committed together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import notify, relations
from tessel.sources.shared import written
from tessel.sources.tables import Tables


def create(tables: Tables, family: str = "string", version: str = "string", user: str = "string", buckets: int = 16) -> None:
    """The catalogue's tables, empty; those that are there stay."""
    with tables.job() as job:
        job.create("families", f"family {family}", ["family"], buckets)
        job.create("versions", f"version {version}, family {family}, document_id string, ingested_at string", ["version"], buckets)
        edge = f"source {family}, target {family}, type string, origin string, status string, score double, evidence_version string, evidence_locator string"
        job.create("relations", edge, relations.EDGE_KEY, buckets)
        job.create("notifications", f"user_id {user}, version {version}, job string", ["user_id", "version"], buckets)
        job.create("events", f"job string, user_id {user}, version {version}, email_id string, event string")
        job.create("digests", f"user_id {user}, job string, email_id string, n long, body string")
        job.create("jobs", "job string, at string, families_count long, versions_count long, relations_count long")


def ingest_into(tables: Tables, docs: DataFrame, declared: DataFrame, derived: DataFrame, preferences: DataFrame, job: str, at: str) -> int:
    """``relations.ingest`` from and to the stored tables, in one commit, whose number is returned. Read and written are only the buckets of the
    families, versions, edges and notifications that arrive; events, digests and the job's counts are appended."""
    docs, declared, derived = (written(t, "job")[0] for t in (docs.select("version", "family", "document_id"), declared, derived))
    edges = declared.select(*relations.EDGE_KEY).unionByName(derived.select(*relations.EDGE_KEY))
    arriving = {"families": docs, "versions": docs, "relations": edges, "notifications": notify.fan_out(preferences.select("user_id"), docs.select("version"))}
    with tables.job() as tx:
        touched = {name: tx.touched(name, rows) for name, rows in arriving.items()}
        out = relations.ingest(docs, {name: tx.near(name, b) for name, b in touched.items()}, declared, derived, preferences, job, at)
        for name, b in touched.items():
            tx.put_near(name, out[name], b)
        tx.append("events", out["events"].withColumn("job", F.lit(job)))
        tx.append("digests", out["digests"])
        tx.append("jobs", out["summary"].withColumns({"job": F.lit(job), "at": F.lit(at)}))
    return tx.number
