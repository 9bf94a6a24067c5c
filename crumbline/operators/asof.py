"""As-of joins: what was in force on a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_force(facts: DataFrame, changes: DataFrame, key: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """facts with the values of the last change of the key on or before at; null where there is none.

    Facts and changes are brought together and the last change is carried forward by a window: one shuffle by key, no pairs.
    Of changes of one key and day the last by their values is taken.
    """
    packed = F.struct(*[F.col(v) for v in values])
    last = changes.groupBy(*key, since).agg(F.max(packed).alias("v"))
    left = facts.select(*key, F.col(at).alias("__t"), F.lit(1).alias("__fact"), F.struct("*").alias("__row"), F.lit(None).cast(last.schema["v"].dataType).alias("__v"))
    right = last.select(*key, F.col(since).alias("__t"), F.lit(0).alias("__fact"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col("v").alias("__v"))
    w = Window.partitionBy(*key).orderBy("__t", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    carried = left.union(right).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__fact = 1")
    return carried.select("__row.*", *[F.col("__v")[v].alias(v) for v in values])


def intervals(changes: DataFrame, key: list[str], since: str) -> DataFrame:
    """changes with until, the day of the key's next change (null for the last): for range joins and inspection."""
    return changes.withColumn("until", F.lead(since).over(Window.partitionBy(*key).orderBy(since)))
