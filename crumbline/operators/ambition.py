"""Whether an ambition level pays: the further units it suggested are settled by what was made and sold, and two periods are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbline.shared import written

from . import ladder as L

#: Days and further units before anything is concluded, share of sell-outs that leaves room, rise of waste that matters, days of the periods
#: (fixed values).
LEAST_DAYS, LEAST_EXTRA, ROOM, WORSE, RECENT, EARLIER = 7, 8, 0.45, 0.05, 14, 28


def settled(decisions: DataFrame) -> DataFrame:
    """decided() rows of own days as (item, d, suggested, made, sold, dollars): of the units above the base, how many were suggested, made
    as suggested and sold, and what that earned. Without a base nothing was suggested."""
    x = decisions.where("base is not null").select("item", F.col("t").alias("d"), "base", F.col("quantity") - F.col("base"), "own").toDF("item", "d", "base", "suggested", "own")
    made = F.greatest(F.lit(0), F.least(F.col("own.supply"), F.col("base") + F.col("suggested")) - F.col("base"))
    sold = F.greatest(F.lit(0), F.least(made, F.col("own.sold") - F.col("base")))
    return x.select("item", "d", "suggested", made.alias("made"), sold.alias("sold"), (sold * F.col("own.eff_price") - made * F.col("own.eff_cost")).alias("dollars"))


def periods(days: DataFrame, since: str | None = None) -> DataFrame:
    """days(d, made, left_over, items, sellouts, profit) as one row: figures of the last two weeks, or since a change of level up to four
    weeks ago, and of the four weeks before. The last day on record is the end of it."""
    today = F.date_add(F.max("d"), 1)
    start = F.date_sub(today, RECENT)
    if since:
        changed = F.lit(since).cast("date")
        start = F.when((changed > F.date_sub(today, 28)) & (changed < today), changed).otherwise(start)
    x = days.join(F.broadcast(days.agg(start.alias("start"))), F.col("d") >= F.date_sub("start", EARLIER))
    new = F.col("d") >= F.col("start")

    def figures(inside, name):
        total = lambda c: F.sum(F.when(inside, F.col(c)))
        share = lambda a, b: F.coalesce(total(a) / F.nullif(total(b), F.lit(0)), F.lit(0.0))
        return [
            F.count_if(inside).alias(f"{name}_days"), F.avg(F.when(inside, F.col("profit"))).alias(f"{name}_profit"), F.coalesce(F.var_samp(F.when(inside, F.col("profit"))), F.lit(0.0)).alias(f"{name}_var"),
            share("left_over", "made").alias(f"{name}_waste"), share("sellouts", "items").alias(f"{name}_sellouts"),
        ]

    return x.agg(F.max("start").alias("start"), *figures(new, "recent"), *figures(~new, "earlier"))


def judged(p: DataFrame, level: int = 3) -> DataFrame:
    """periods() with suggested, made and dollars of the recent days, and the verdict: early, too-high, paying, room or steady. A rise of
    profit counts beyond twice its standard error."""
    known = F.col("earlier_days") > 0
    noise = 2 * F.sqrt(F.col("recent_var") / F.nullif(F.col("recent_days"), F.lit(0)) + F.col("earlier_var") / F.nullif(F.col("earlier_days"), F.lit(0)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    profit_up, waste_up = yes(F.col("recent_profit") - F.col("earlier_profit") > noise), yes(known & (F.col("recent_waste") - F.col("earlier_waste") >= WORSE))
    enough, room = F.col("made") >= LEAST_EXTRA, F.col("recent_sellouts") >= ROOM
    if level == 1:
        return p.withColumn("verdict", F.when(room, "room").otherwise("steady"))
    unheeded = (F.col("suggested") >= LEAST_EXTRA) & (4 * F.col("made") < F.col("suggested"))
    verdict = F.when((F.col("recent_days") < LEAST_DAYS) | unheeded, "early").when((enough & (F.col("dollars") < 0)) | (waste_up & ~profit_up), "too-high")
    verdict = verdict.when((enough & (F.col("dollars") > 0)) | profit_up, "paying").when(F.lit(level < 5) & room & ~waste_up, "room")
    return p.withColumn("verdict", verdict.otherwise("steady"))


def verdicts(obs: DataFrame, days: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4, 5), since: str | None = None) -> DataFrame:
    """One row per level, as if it had been in force. obs has economics; the rule decides each recent morning anew, all of them in one pass."""
    p = periods(days, since)
    mornings = L.with_own_days(obs).join(F.broadcast(p.select("start")), (F.col("real") == 1) | (F.col("t") >= F.col("start"))).drop("start")
    made, out = written(L.ladders(mornings, by_unit=False), "ladders"), None  # one ladder for all levels
    for level in levels:
        sums = settled(L.budgeted(L.climb(made, level), level)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("suggested", "made", "sold", "dollars")])
        one = judged(p.join(F.broadcast(sums), F.lit(True)), level).select(F.lit(level).alias("level"), "verdict", "recent_days", "suggested", "made", "sold", "dollars", "recent_profit", "earlier_profit", "recent_waste", "earlier_waste", "recent_sellouts")
        out = one if out is None else out.union(one)
    return out
