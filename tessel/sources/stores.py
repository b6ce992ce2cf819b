"""Tables that jobs leave behind: manifests with their version, texts, dimensions, search executions; and manifests of several corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.operators.manifest import corpus_version
from tessel.operators.search import freeze
from tessel.sources.files import expand_zips


def corpus_manifest(*corpora: tuple[str, DataFrame]) -> DataFrame:
    """Rows of several corpora with their names, columns that one lacks null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows.withColumn("corpus_id", F.lit(name)) for name, rows in corpora])


def with_urls(index: DataFrame, urls: DataFrame) -> DataFrame:
    """Index rows with their process's address, where there is one."""
    return index.join(urls.select("processo", F.col("url").alias("processo_url")), "processo", "left")


def members_again(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: zip_caminho, zip_lineage, zip_membro. The contents of these members; only their archives are opened."""
    archives = files.join(wanted.select(F.col("zip_caminho").alias("path")).distinct(), "path", "left_semi")
    return expand_zips(archives).join(wanted.select("zip_caminho", "zip_lineage", "zip_membro").distinct(), ["zip_caminho", "zip_lineage", "zip_membro"], "left_semi")


def write_manifest(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Writes the rows and, beside them, one row with the corpus version and their number; returns that row."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    back = rows.sparkSession.read.parquet(f"{path}/rows")
    version = corpus_version(back, key).select("corpus_version").withColumn("rows", F.lit(back.count()))
    version.write.mode("overwrite").parquet(f"{path}/version")
    return rows.sparkSession.read.parquet(f"{path}/version")


def write_texts(texts: DataFrame, path: str, version: str = "version", parts: int = 16) -> None:
    """Texts in folders by a hash of their version. Written anew are only the folders of versions that arrive, together with what these hold of others."""
    at = F.pmod(F.xxhash64(version), F.lit(parts)).alias("part")
    new, spark = texts.select("*", at), texts.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        old = spark.read.parquet(path)
        new = old.join(new.select("part").distinct(), "part", "left_semi").join(new.select(version), version, "left_anti").select(*new.columns).unionByName(new)
        new = new.checkpoint()  # the folders that are read are written over
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def seed(rows: DataFrame, path: str) -> DataFrame:
    """A dimension, written over what was there."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def job_id(*parts: Column) -> Column:
    """An id that depends on a job's parts alone, so that a job that runs again has the same one."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def in_job(rows: DataFrame, job: str, at: str) -> DataFrame:
    """The rows with their job and its one time."""
    return rows.withColumns({"job": F.lit(job), "at": F.lit(at).cast("timestamp")})


def execution(results: DataFrame, size: int) -> DataFrame:
    """Frozen hits of each request, and its first page of ``size`` hits as JSON: what is kept of a search."""
    first = results.where(F.col("pos") < size).groupBy("request").agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", *[c for c in results.columns if c not in ("pos", "request")])))).alias("first_page"))
    return freeze(results).join(first, "request", "left")


def cost_usd(tokens: Column, model: Column, prices: dict[str, float]) -> Column:
    """What tokens cost, by a price for a million; null for models without a price."""
    price = F.try_element_at(F.create_map(*[F.lit(x) for kv in prices.items() for x in kv]), model)
    return tokens * price / 1e6
