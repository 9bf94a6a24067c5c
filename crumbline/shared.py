"""Tables that steps of a computation hand on, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one (tests) gets a folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="crumbline-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table and read again: lineage ends there, and a lost executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.written_at = path
    return read


def removed(df: DataFrame | None) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    if df is not None:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
