"""Written intermediate tables in the folder that all machines share: they cut the lineage and survive the loss of executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset: on one machine (tests) a new local folder, on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessel-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The store of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses; what is there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        if spark.sparkContext._jsc is not None:  # the session still runs
            store, at = file_system(spark, path)
            store.delete(at, True)

    atexit.register(end)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, int]:
    """The table, written to a new folder and read back; and the bytes of its files."""
    spark, path, schema = df.sparkSession, new_folder(df.sparkSession, name), df.schema
    df.write.option("compression", codec).parquet(path)
    store, at = file_system(spark, path)
    return spark.read.schema(schema).parquet(path), store.getContentSummary(at).getLength()
