"""What a rule's quantities would have sold, how far its chances can be believed, and whether it may replace the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chances that matter for the next unit: where calibration is looked at; by how much they may be too high (fixed values).
ZONE, OVERCONFIDENT = (0.1, 0.4), 0.10


def outcome(q: Column, continuation: Column) -> Column:
    """(low, est, high, unseen): what quantity q would have sold on a day with supply, sold and censored. A day with leftovers says it exactly; on
    one that sold out, units beyond the supply may have sold, each after the one before with the chance continuation."""
    seen, over = F.least(q, F.col("sold").cast("double")), F.round(q - F.col("supply"), 0)
    est = F.col("supply") + continuation * (1 - F.pow(continuation, over)) / (1 - continuation)
    known, within = ~F.col("censored"), q <= F.col("supply")
    supply = F.col("supply").cast("double")
    return F.struct(
        F.when(known, seen).when(within, q).otherwise(supply).alias("low"), F.when(known, seen).when(within, q).otherwise(F.when(continuation < 1, est).otherwise(q)).alias("est"),
        F.when(known, seen).otherwise(q).alias("high"), F.when(~known & ~within, over).otherwise(0.0).alias("unseen"),
    )


def extra_unit_rate(obs: DataFrame, usual: str, seen: str, by: list[str]) -> DataFrame:
    """(by..., tried, sold, rate): days that had more than usual after the usual amount sold, and how many sold one more."""
    tried = obs.where((F.col(seen) == 3) & (F.col("supply") > F.col(usual)) & (F.col("sold") >= F.col(usual)))
    g = tried.groupBy(*by).agg(F.count("*").alias("tried"), F.count_if(F.col("sold") >= F.col(usual) + 1).alias("sold"))
    return g.withColumn("rate", F.when(F.col("tried") > 0, F.col("sold") / F.col("tried")))


def compared(decisions: DataFrame, rules: list[str], continuation: DataFrame) -> DataFrame:
    """(rule, d, item, ...): decisions(d, item, supply, sold, censored, eff_price, eff_cost, one column per rule) with each rule's outcome and
    profits; a rule without an opinion takes what was supplied. continuation is one row (c). All rules are judged in one pass."""
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).cast("double").alias("q0")) for r in rules])
    x = decisions.join(F.broadcast(continuation.select(F.coalesce("c", F.lit(0.0)).alias("c"))), F.lit(True)).withColumn("r", F.explode(names))
    x = x.withColumns({"rule": F.col("r.rule"), "no_opinion": F.col("r.q0").isNull(), "q": F.coalesce("r.q0", F.col("supply").cast("double"))}).drop("r", *rules)
    x = x.withColumn("o", outcome(F.col("q"), F.col("c")))
    profit = lambda sold: F.col("eff_price") * sold - F.col("eff_cost") * F.col("q")
    return x.withColumns({f"profit_{k}": profit(F.col("o")[k]) for k in ("low", "est", "high")})


def tally(rows: DataFrame, by: list[str]) -> DataFrame:
    s = lambda c, name: F.round(F.sum(c), 4).alias(name)
    return rows.groupBy(*by).agg(
        s("profit_est", "profit_est"), s("profit_low", "profit_low"), s("profit_high", "profit_high"), s("q", "made"), s(F.col("q") - F.col("o.est"), "left_est"), s("o.unseen", "unseen"),
        F.count_if("no_opinion").alias("no_opinion"), F.countDistinct("d").alias("days"),
    )


def predicted_units(ladders: DataFrame) -> DataFrame:
    """(d, item, k, p, y): of every unit supplied on a day whose ladder (array chances) saw a week at least, the chance it had and whether it sold."""
    n = F.col("supply").cast("int")
    # Units past the ladder have no chance. What is exploded holds the chance itself, so that no unit's row carries the whole ladder.
    each = F.concat(F.slice("chances", F.lit(1), n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - F.size("chances"))))
    u = ladders.where((F.col("days") >= 7) & (F.col("supply") > 0)).select("d", "item", "sold", F.posexplode(each).alias("k", "p"))
    return u.select("d", "item", (F.col("k") + 1).alias("k"), "p", (F.col("sold") > F.col("k")).cast("int").alias("y"))


def calibration(units: DataFrame) -> DataFrame:
    """One row: how many units, those in the zone that decides, their mean chance and the share that sold, and the log loss of all."""
    zone = (F.col("p") >= ZONE[0]) & (F.col("p") < ZONE[1])
    clip = lambda p: F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    loss = F.col("y") * F.ln(clip(F.col("p"))) + (1 - F.col("y")) * F.ln(1 - clip(F.col("p")))
    return units.agg(
        F.count("*").alias("n"), F.count_if(zone).alias("zone_n"), F.round(F.avg(F.when(zone, F.col("p"))), 6).alias("zone_predicted"), F.round(F.avg(F.when(zone, F.col("y"))), 6).alias("zone_sold"), F.round(-F.avg(loss), 6).alias("log_loss")
    )


def calibration_bins(units: DataFrame) -> DataFrame:
    b = F.least(F.lit(9), F.floor(F.round(F.col("p") * 10, 9))).cast("int")
    return units.groupBy(b.alias("bin")).agg(F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("sold"), F.count("*").alias("n"))


def retrain_verdict(rows: DataFrame, units: DataFrame, rule: str, old: str) -> DataFrame:
    """One row: the rule is refused if it is estimated to earn less than the old one, or if its chances are too high where they decide."""
    p = rows.agg(F.sum(F.when(F.col("rule") == rule, F.col("profit_est"))).alias("rule_profit"), F.sum(F.when(F.col("rule") == old, F.col("profit_est"))).alias("old_profit"))
    x = p.join(F.broadcast(calibration(units).select("zone_n", "zone_predicted", "zone_sold")), F.lit(True))
    over = F.coalesce((F.col("zone_n") > 0) & (F.col("zone_predicted") - F.col("zone_sold") > OVERCONFIDENT), F.lit(False))
    verdict = F.when(F.col("rule_profit") < F.col("old_profit"), "refused: earns less").when(over, "refused: over-confident").otherwise("accepted")
    return x.select(F.round("rule_profit", 4).alias("rule_profit"), F.round("old_profit", 4).alias("old_profit"), "zone_n", "zone_predicted", "zone_sold", verdict.alias("verdict"))
