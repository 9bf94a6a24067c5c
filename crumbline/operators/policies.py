"""Policies: quantities for every item and day, from strictly earlier days only; and their scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbline.functions.scalars import quantile_linear, round_half_up
from crumbline.shared import written

from . import ladder
from .economics import scored
from .observations import by_item, by_weekday

#: name -> function of observations with economics that adds a column q; null is "no opinion". Users add theirs.
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {}


def policy(name: str):
    def keep(f):
        POLICIES[name] = f
        return f

    return keep


def earlier(window: Window, n: int) -> Window:
    """The n rows before this one: what a decision for the day may see."""
    return window.rowsBetween(-n, -1)


@policy("operator_actual")
def operator_actual(obs: DataFrame) -> DataFrame:
    return obs.withColumn("q", F.col("supply").cast("double"))


def weekday_mean(window: int = 4, least: int = 2) -> Column:
    past = earlier(by_weekday(), window)
    return F.when(F.count("sold").over(past) >= least, F.greatest(F.lit(0), round_half_up(F.avg("sold").over(past))).cast("double"))


@policy("same_weekday_mean")
def same_weekday_mean(obs: DataFrame) -> DataFrame:
    return obs.withColumn("q", weekday_mean())


def weekday_quantile(window: int = 8, least: int = 4, floor: int = 1) -> Column:
    """The critical-ratio quantile of the last sales of the weekday; at least floor if anything was supplied then."""
    past = earlier(by_weekday(), window)
    values = F.array_sort(F.collect_list(F.col("sold").cast("double")).over(past))
    q = F.greatest(F.lit(0), round_half_up(quantile_linear(values, F.col("cr"))))
    q = F.when((q < floor) & (F.max("supply").over(past) > 0), floor).otherwise(q) if floor else q
    return F.when((F.count("sold").over(past) >= least) & F.col("cr").isNotNull(), q.cast("double"))


@policy("same_weekday_quantile")
def same_weekday_quantile(obs: DataFrame) -> DataFrame:
    return obs.withColumn("q", weekday_quantile())


@policy("fallback_quantile")
def fallback_quantile(obs: DataFrame) -> DataFrame:
    return obs.withColumn("q", weekday_quantile(8, 3, 0))


def roll_chance(level: int = 3) -> Callable[[DataFrame], DataFrame]:
    """The sell-chance ladder at an ambition level as a policy: every day of every item is a target that sees the days before it."""

    def decide(obs: DataFrame) -> DataFrame:
        made = ladder.decided(ladder.with_own_days(obs), level=level, by_unit=False)
        return made.select("own.*", F.col("quantity").cast("double").alias("q"))

    return decide


POLICIES["roll_chance"] = roll_chance()
for _level in range(1, 6):
    POLICIES[f"roll_chance_{_level}"] = roll_chance(_level)


def decisions(obs: DataFrame, names: list[str]) -> DataFrame:
    """obs with a column per policy: its quantity. Policies that join come first, so that what the others add isn't made twice."""
    for name in sorted(names, key=lambda n: not n.startswith("roll_chance")):
        obs = POLICIES[name](obs).withColumnRenamed("q", name)
    return obs


def evaluated(made: DataFrame, obs: DataFrame, warm_up: int = 28) -> DataFrame:
    """Rows of made from warm_up days after the first day of obs, which is one row. What made costs is paid once."""
    first = obs.agg(F.date_add(F.min("d"), warm_up).alias("from_day"))
    return made.join(F.broadcast(first), F.col("d") >= F.col("from_day")).drop("from_day")


def walk_forward(obs: DataFrame, names: list[str], factor: float = 1.0, warm_up: int = 28) -> DataFrame:
    """Scored decisions (policy, d, item, q, ...) of each policy for all days after the warm-up, in one pass: window frames that end the row
    before stand for the strictly earlier history. obs is made once and kept: its first day is asked, too."""
    obs = written(obs, "observations")
    made = evaluated(decisions(obs, names), obs, warm_up)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).cast("double").alias("q")) for n in names]))
    rows = made.withColumn("__p", each).drop(*names).select("*", "__p.*").drop("__p")
    return scored(rows, "q", factor)


def totals(rows: DataFrame) -> DataFrame:
    taken = F.col("q").isNotNull()
    return rows.groupBy("policy").agg(
        F.round(F.sum("cost_of_error"), 4).alias("total_cost"), F.round(F.sum("waste_cost"), 4).alias("waste_cost"), F.round(F.sum("stockout_cost"), 4).alias("stockout_cost"),
        F.count_if(taken).alias("decisions"), F.count_if(~taken).alias("skipped"), F.countDistinct(F.when(taken, F.col("d"))).alias("days"),
        F.round(F.sum("cost_of_error") / F.countDistinct(F.when(taken, F.col("d"))), 6).alias("cost_per_day"),
        F.round(F.count_if(taken & F.col("unidentified")) / F.count_if(taken), 6).alias("unidentified_share"), F.sum("q").alias("units"),
    )


def compared(rows: DataFrame, baseline: str) -> DataFrame:
    """Each policy against the baseline, on the decisions that both took."""
    # The baseline's row stands among those of its day and item, so the rows aren't made a second time to be joined.
    base = F.max(F.when(F.col("policy") == baseline, F.col("cost_of_error"))).over(Window.partitionBy("d", "item"))
    both = rows.where("q is not null").withColumn("base_cost", base).where((F.col("policy") != baseline) & F.col("base_cost").isNotNull())
    delta = F.sum(F.col("cost_of_error") - F.col("base_cost"))
    return both.groupBy("policy").agg(
        F.round(delta, 4).alias("delta"), F.round(delta / F.nullif(F.sum("base_cost"), F.lit(0.0)), 6).alias("pct"),
        F.round(delta / F.countDistinct("d"), 6).alias("per_day"), F.count("*").alias("n"), F.countDistinct("d").alias("days"),
    )


def features(obs: DataFrame, level_days: int = 14, least: int = 3) -> DataFrame:
    """The design matrix of the fitted models: trailing level, weekday dummies (Monday is the reference) and weeks since the first day."""
    n = F.row_number().over(by_item())
    level = F.coalesce(F.avg("sold").over(earlier(by_item(), level_days)), F.lit(0.0))
    first = F.min("d").over(Window.partitionBy("item"))
    out = obs.withColumns({"level": level, "trend": F.datediff("d", first) / 7.0, "nth": n, **{f"dow{k}": (F.col("dow") == k).cast("int") for k in range(2, 8)}})
    return out.where(F.col("nth") > least).drop("nth")
