"""What the weather does to sales, and quantities scaled by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .observations import isodow

#: Bands that are rain; days that a figure needs; standard errors that endorse it and that make it credible; degrees beyond the record that
#: still count as seen (fixed values).
RAINY, LEAST, SURE, CREDIBLE, SLACK = ("wet", "heavy"), 8, 2.0, 1.2816, 5


def ratios(days: DataFrame, near: int = 28) -> DataFrame:
    """days(d, dow, sold, band) with r: sales relative to the mean of other dry days of the weekday, within near days if there are two,
    else all. One row per day; the near ones come from a range frame, the day itself is taken out of its sums."""
    no = F.datediff("d", F.lit("1970-01-01").cast("date"))
    dry = (F.col("band") == "dry").cast("int")
    x = days.withColumns({"no": no, "dry": dry, "dry_sold": dry * F.col("sold")})
    close = Window.partitionBy("dow").orderBy("no").rangeBetween(-near, near)
    every = Window.partitionBy("dow")
    x = x.withColumns({"n1": F.sum("dry").over(close) - F.col("dry"), "s1": F.sum("dry_sold").over(close) - F.col("dry_sold"), "n2": F.sum("dry").over(every) - F.col("dry"), "s2": F.sum("dry_sold").over(every) - F.col("dry_sold")})
    base = F.when(F.col("n1") >= 2, F.col("s1") / F.col("n1")).when(F.col("n2") >= 2, F.col("s2") / F.col("n2"))
    return x.withColumn("base", base).where("base > 0").withColumn("r", F.col("sold") / F.col("base")).select("d", "dow", "sold", "band", "base", "r")


def band_effects(r: DataFrame) -> DataFrame:
    e = r.where("band <> 'dry'").groupBy("band").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.sqrt(F.var_samp("r") / F.count("*")).alias("s"))
    t = F.abs(F.col("m") - 1) / F.col("s")
    return e.select("band", "n", F.round("m", 6).alias("ratio"), F.round("s", 6).alias("se"), F.round(t, 5).alias("t"), ((F.col("n") >= 8) & (t >= 2)).alias("usable"))


def rain(r: DataFrame) -> DataFrame:
    """Random effects by weekday: each weekday's mean is drawn to the common one, the more the noisier it is. Seven rows are summed."""
    g = r.where(F.col("band").isin(*RAINY)).groupBy("dow").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.coalesce(F.var_samp("r"), F.lit(0.0)).alias("s2"))
    one = Window.partitionBy()
    s2 = F.sum((F.col("n") - 1) * F.col("s2")).over(one) / F.sum(F.col("n") - 1).over(one)
    v = g.withColumn("v", F.greatest(s2 / F.col("n"), F.lit(1e-4)))
    v = v.withColumns({"w": F.sum(1 / F.col("v")).over(one), "w2": F.sum(1 / (F.col("v") * F.col("v"))).over(one), "k": F.count("*").over(one), "fixed": F.sum(F.col("m") / F.col("v")).over(one) / F.sum(1 / F.col("v")).over(one)})
    q = F.sum(F.pow(F.col("m") - F.col("fixed"), 2) / F.col("v")).over(one)
    v = v.withColumn("tau2", F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / (F.col("w") - F.col("w2") / F.col("w"))))
    whole = 1 / (F.col("v") + F.col("tau2"))
    v = v.withColumns({"mu": F.sum(F.col("m") * whole).over(one) / F.sum(whole).over(one), "se_mu": F.sqrt(1 / F.sum(whole).over(one))})
    precision = 1 / F.col("v") + 1 / F.col("tau2")
    some = F.col("tau2") > 0
    ratio = F.when(some, (F.col("m") / F.col("v") + F.col("mu") / F.col("tau2")) / precision).otherwise(F.col("mu"))
    se = F.when(some, F.sqrt(1 / precision)).otherwise(F.sqrt(F.col("se_mu") * F.col("se_mu") + F.col("tau2")))
    return v.select("dow", "n", ratio.alias("ratio"), se.alias("se"), "mu", F.sqrt(F.col("se_mu") * F.col("se_mu") + F.col("tau2")).alias("se_unseen"))


def rain_by_weekday(r: DataFrame) -> DataFrame:
    return rain(r).select("dow", "n", F.round("ratio", 6).alias("ratio"), F.round("se", 6).alias("se"), (F.col("n") >= LEAST).alias("usable"))


def advice(r: DataFrame) -> DataFrame:
    """Bands relative to a typical day, and how far to trust that."""
    e = r.groupBy("band").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.sqrt(F.var_samp("r") / F.count("*")).alias("s"))
    one = Window.partitionBy()
    counted = F.when(F.col("band") == "dry", F.col("n").cast("double")).otherwise(F.col("n") * F.col("m"))
    e = e.withColumn("typical", F.sum(counted).over(one) / F.sum("n").over(one)).where("band <> 'dry'")
    off = F.abs(F.col("m") - 1)
    said = F.when(F.col("n") < 8, "unseen").when(off >= 2 * F.col("s"), "endorsed").when(off >= 1.2816 * F.col("s"), "credible").otherwise("noisy")
    return e.select("band", F.round(F.col("m") / F.col("typical"), 6).alias("relative"), said.alias("advice"))


def effect(days: DataFrame) -> DataFrame:
    """days(d, dow, sold, band, temp_max) as one row: dry days, the range of temperatures, ratios by band, rain by weekday, and what a typical
    day is worth against a dry one."""
    r = ratios(days)
    whole = days.where("sold > 0").agg(F.count_if(F.col("band") == "dry").alias("dry_days"), F.min("temp_max").alias("lo"), F.max("temp_max").alias("hi"))
    bands = r.where("band <> 'dry'").groupBy("band").agg(F.struct(F.count("*").alias("n"), F.avg("r").alias("ratio"), F.coalesce(F.sqrt(F.var_samp("r") / F.count("*")), F.lit(0.0)).alias("se")).alias("v"))
    bands = bands.agg(F.map_from_entries(F.collect_list(F.struct("band", "v"))).alias("bands"), F.coalesce(F.sum("v.n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("v.n") * F.col("v.ratio")), F.lit(0.0)).alias("weighted"))
    wet = rain(r).agg(F.map_from_entries(F.collect_list(F.struct("dow", F.struct("n", "ratio", "se")))).alias("rain"), F.coalesce(F.sum("n"), F.lit(0)).alias("rain_n"), F.struct(F.lit(0).cast("long").alias("n"), F.max("mu").alias("ratio"), F.max("se_unseen").alias("se")).alias("unseen"))
    shares = days.where("sold > 0").groupBy("dow").agg(F.avg(F.col("band").isin(*RAINY).cast("int")).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("dow", "v"))).alias("shares"))
    one = whole.join(F.broadcast(bands), F.lit(True)).join(F.broadcast(wet), F.lit(True)).join(F.broadcast(shares), F.lit(True))
    typical = F.coalesce((F.col("dry_days") + F.col("weighted")) / F.nullif(F.col("dry_days") + F.col("n"), F.lit(0)), F.lit(1.0))
    return one.withColumn("typical", typical).drop("n", "weighted")


def advised(forecasts: DataFrame, e: DataFrame) -> DataFrame:
    """forecasts(d, band, temp_max, rain_chance; null: as the band says) with what effect() makes of them: reason, days it rests on, offered (sales
    against a dry day, null if there is no figure), endorsed, credible, and relative: against what such a weekday usually is, as
    plans made from past days have its rain in them."""
    x = forecasts.join(F.broadcast(e), F.lit(True))
    band, w = F.col("band"), F.coalesce(F.element_at("rain", isodow("d")), F.col("unseen"))
    chance = F.coalesce("rain_chance", band.isin(*RAINY).cast("double"))
    by_rain = (band != "snow") & (chance > 0) & (F.col("rain_n") >= LEAST)
    hit = F.when(by_rain, w).otherwise(F.element_at("bands", band))
    x = x.withColumns({"by_rain": by_rain, "hit": hit, "chance": chance, "w": w})
    beyond = lambda z: (F.col("hit.se") > 0) & (F.abs(F.col("hit.ratio") - 1) >= z * F.col("hit.se"))
    seen = F.col("by_rain") | (F.coalesce("hit.n", F.lit(0)) >= LEAST)
    sunny = (band == "dry") & ~F.col("by_rain")
    outside = F.coalesce((F.col("temp_max") < F.col("lo") - SLACK) | (F.col("temp_max") > F.col("hi") + SLACK), F.lit(False))
    some = lambda z: F.exists(F.map_values("bands"), lambda b: (b["n"] >= LEAST) & ((b["se"] > 0) & (F.abs(b["ratio"] - 1) >= z * b["se"]) if z else F.lit(True)))
    reason = F.when((F.col("dry_days") < LEAST) | ~some(0), "no-data").when(outside, "out-of-range").when(sunny, "ok").when(~seen, "unseen-band").when(beyond(SURE), "ok").otherwise("too-noisy")
    x = x.withColumn("reason", reason)
    figure = F.when(F.col("by_rain"), 1 + F.col("chance") * (F.col("hit.ratio") - 1)).when(sunny, 1.0).otherwise(F.col("hit.ratio"))
    offered = F.when(F.col("reason").isin("ok", "too-noisy"), figure)
    usual = F.when(F.col("rain_n") >= LEAST, 1 + F.coalesce(F.element_at("shares", isodow("d")), F.lit(0.0)) * (F.col("w.ratio") - 1)).otherwise(F.col("typical"))
    n = F.when(sunny, F.col("dry_days")).otherwise(F.coalesce("hit.n", F.lit(0)))
    # A dry day's gain is read off the bad days, so it is as sure as they are.
    dry_sure = F.when(some(SURE), "measured").when(some(0), "weak").otherwise("none")
    sure = F.when(offered.isNull(), "none").when(sunny, dry_sure).when(F.col("reason") == "ok", "measured").otherwise("weak")
    return x.select(
        *forecasts.columns, "reason", n.alias("n"), offered.alias("offered"), (offered.isNotNull() & (F.col("reason") == "ok")).alias("endorsed"),
        (offered.isNotNull() & F.coalesce(beyond(CREDIBLE), F.lit(False)) & ~sunny).alias("credible"), F.coalesce(offered / F.nullif(usual, F.lit(0.0)), offered).alias("relative"), sure.alias("confidence"),
    )


def outlook(advice: DataFrame, days: DataFrame) -> DataFrame:
    """advised() with baseline, the mean of the last eight days of the weekday before the first forecast (null with fewer than three), and projected:
    that, moved by the weather if there is a figure."""
    first = F.broadcast(advice.agg(F.min("d").alias("first")))
    last = days.join(first, F.col("d") < F.col("first")).withColumn("nth", F.row_number().over(Window.partitionBy("dow").orderBy(F.col("d").desc()))).where("nth <= 8")
    b = last.groupBy("dow").agg(F.count("*").alias("baseline_days"), F.when(F.count("*") >= 3, F.avg("sold")).alias("baseline"))
    x = advice.withColumn("dow", isodow("d")).join(F.broadcast(b), "dow", "left")
    return x.withColumns({"baseline_days": F.coalesce("baseline_days", F.lit(0)), "projected": F.floor(F.col("baseline") * F.coalesce("relative", F.lit(1.0)) + 0.5)})


def scaled(q: DataFrame, factor: float) -> DataFrame:
    """q(d, item, q) with scaled: whole numbers near q times factor that sum to the rounded total of the day, at least one each. What is
    missing goes to the largest remainders, what is too much comes from the smallest."""
    day = Window.partitionBy("d")
    exact = F.col("q") * factor
    x = q.withColumns({"floor_": F.greatest(F.lit(1), F.floor(exact)), "rest": exact - F.floor(exact), "target": F.greatest(F.count("*").over(day), F.floor(F.sum("q").over(day) * factor + 0.5))})
    x = x.withColumn("base", F.sum("floor_").over(day))
    may = (F.col("floor_") < F.col("q")) | F.lit(factor > 1)
    up = F.row_number().over(Window.partitionBy("d", "may").orderBy(F.col("rest").desc(), "item"))
    down = F.row_number().over(Window.partitionBy("d", "big").orderBy(exact - F.col("floor_"), "item"))
    x = x.withColumns({"may": may, "big": F.col("floor_") > 1}).withColumns({"up": up, "down": down})
    more = (F.col("target") > F.col("base")) & F.col("may") & (F.col("up") <= F.col("target") - F.col("base"))
    less = (F.col("target") < F.col("base")) & F.col("big") & (F.col("down") <= F.col("base") - F.col("target"))
    return x.select("d", "item", "q", (F.col("floor_") + F.when(more, 1).when(less, -1).otherwise(0)).alias("scaled"))
