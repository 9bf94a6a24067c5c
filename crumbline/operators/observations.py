"""Item-day observations: what was supplied, what was left, and what that says about demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def isodow(d: Column | str) -> Column:
    """1 is Monday."""
    return (F.weekday(d) + 1).cast("int")


def derived(counts: DataFrame) -> DataFrame:
    """counts(d, item, made, refill, wasted) with supply, sold (never negative), censored and dow.

    Nothing left means that demand is known only to be at least what was sold.
    """
    supply = F.col("made") + F.col("refill")
    return counts.withColumns({"supply": supply, "sold": F.greatest(F.lit(0), supply - F.col("wasted")), "censored": F.col("wasted") <= 0, "dow": isodow("d")})


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the last by order: a pre-aggregated maximum, not a sort of the whole log."""
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*key).agg(best.alias("r")).select(*key, *[F.col("r")[c].alias(c) for c in rest])


def counted_days(cells: DataFrame) -> DataFrame:
    """From (d, item, supply, wasted, wasted null where blank): days with supply and any count of what was left."""
    return cells.where("supply > 0").groupBy("d").agg(F.max(F.col("wasted").isNotNull()).alias("counted"))


def with_day_rule(cells: DataFrame, outages: DataFrame) -> DataFrame:
    """Observations by the day rule: on a counted day a blank is 0, a day that is blank all the way down is dropped, and outages too."""
    days = counted_days(cells).where("counted").select("d")
    kept = cells.join(days, "d", "left_semi").join(outages, "d", "left_anti")
    return derived(kept.withColumn("wasted", F.coalesce("wasted", F.lit(0))))


def production(current: DataFrame) -> DataFrame:
    made = current.where(F.col("entry_type").isin("made", "refill"))
    q = F.col("quantity")
    return made.groupBy("business_date", "item_id").agg(
        F.sum(F.when(F.col("entry_type") == "made", q)).alias("quantity_made"), F.sum(F.when(F.col("entry_type") == "refill", q)).alias("quantity_refill")
    )


def waste(current: DataFrame) -> DataFrame:
    return current.where("entry_type = 'waste'").groupBy("business_date", "item_id").agg(F.sum("quantity").alias("quantity_wasted"))


def sales(current: DataFrame) -> DataFrame:
    """Production and waste side by side, whichever is there; sold may be negative here."""
    both = production(current).join(waste(current), ["business_date", "item_id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select(
        "business_date", "item_id", zero("quantity_made").alias("quantity_made"), zero("quantity_refill").alias("quantity_refill"), zero("quantity_wasted").alias("quantity_wasted"),
        (zero("quantity_made") + zero("quantity_refill") - zero("quantity_wasted")).alias("quantity_sold"), (zero("quantity_wasted") == 0).alias("demand_censored"),
    )


def by_item() -> Window:
    return Window.partitionBy("item").orderBy("d")


def by_weekday() -> Window:
    return Window.partitionBy("item", "dow").orderBy("d")
