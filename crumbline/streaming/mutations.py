"""The mutation log as a stream: duplicates by id are dropped, the latest value of a key wins, late corrections count."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "mutation_id string, kind string, business_date date, item_id long, entry_type string, quantity double, received_at timestamp"


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def apply(stream: DataFrame, store: str, checkpoint: str, on_kind: dict[str, Callable[[DataFrame, int], None]] | None = None) -> StreamingQuery:
    """Writes each batch's new entries to store/batch=<n>; other kinds go to their own function. Which mutations were seen is state of the stream, keyed by
    id, so replays and duplicates have no effect, however late they come, and a batch reads nothing of what is stored. A batch that is repeated
    after a crash overwrites its own place."""
    once = stream.dropDuplicates(["mutation_id"])

    def batch(df: DataFrame, n: int) -> None:
        entries = df.where("kind = 'entry'").withColumn("month", F.date_format("business_date", "yyyy-MM"))
        entries.write.mode("overwrite").partitionBy("month").parquet(f"{store}/batch={n}")
        for kind, f in (on_kind or {}).items():
            f(df.where(F.col("kind") == kind), n)

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def latest(stored: DataFrame) -> DataFrame:
    """The latest value of each (business_date, item_id, entry_type), by server time, then id."""
    key = ["business_date", "item_id", "entry_type"]
    best = F.max_by(F.struct("quantity", "mutation_id"), F.struct("received_at", "mutation_id"))
    return stored.groupBy(*key).agg(best.alias("r")).select(*key, "r.quantity", "r.mutation_id")


def deduplicated(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Duplicates dropped inside the stream, where their delay is bounded: state is kept for that long."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["mutation_id"])


def windowed(stream: DataFrame, width: str = "6 hours", delay: str = "2 days") -> DataFrame:
    return stream.withWatermark("received_at", delay).groupBy(F.window("received_at", width), "entry_type").agg(F.count("*").alias("n"), F.sum("quantity").alias("total"))
