"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session without one (tests) gets a folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="crumbline-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, and the loss of an executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def dropped(df: DataFrame | None) -> None:
    """Removes the files of a stored() table that nothing reads any more."""
    if df is not None:
        context = df.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. bytes.split() cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8").split() if text else []


def asset(name: str) -> str:
    """Path of a file that lies beside this module."""
    return os.path.join(os.path.dirname(os.path.abspath(__file__)), name)
