"""The sell-chance ladder: how likely the k-th unit of an item sells on a day, and how many units pay.

It is made for any number of target days in one pass. A target (item, t, c) is a decision for day t that sees days before c; it takes its
place among the item's days, and everything it needs is a running sum or a frame of the rows before that place. No target is ever
joined with its history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from crumbline.functions.scalars import beta_tail, round_half_up

from .economics import Costs, effective, is_promo, with_economics
from .observations import isodow

#: Ambition levels 2 to 5: how sure further units must be to pay, most of them per item, most of them in a day (fixed values).
AMBITION = {2: (0.90, 1, 4), 3: (0.75, 2, 8), 4: (0.60, 3, 12), 5: (0.50, 3, 16)}
HALF_LIFE, OTHER, LEAST_DAYS = 21.0, 0.3, 7
KEY = ["item", "t", "c"]
#: Units of a block, see chances().
BLOCK = 128


def next_days(obs: DataFrame, days: int = 1) -> DataFrame:
    """Targets: the days after each item's last one, seen from the first of them."""
    ends = obs.groupBy("item").agg(F.date_add(F.max("d"), 1).alias("c"))
    return ends.select("item", F.explode(F.sequence("c", F.date_add("c", days - 1))).alias("t"), "c")


def _before(n: int, *by: str, at: str) -> Window:
    """The n rows on record before a target's place; 0 for all. Rows on record stand at even places, targets at odd ones."""
    return Window.partitionBy(*by).orderBy(at).rangeBetween(-2 * n if n else Window.unboundedPreceding, -1)


def with_targets(obs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows on record (real = 1) and targets(item, t, c) (real = 0) together."""
    rows = obs.select("item", F.col("d").alias("t"), F.col("d").alias("c"), F.lit(1).alias("real"), "supply", "sold", "censored", "wasted")
    return rows.unionByName(targets.withColumn("real", F.lit(0)), allowMissingColumns=True)


def with_next_days(obs: DataFrame, days: int = 1) -> DataFrame:
    """Rows on record and next_days() of them as with_targets() has them, from one pass: an item's last row carries its targets, so obs is not made twice."""
    row = lambda t, c, real: F.struct(t.alias("t"), c.alias("c"), F.lit(real).alias("real"))
    after = F.transform(F.sequence(F.date_add("d", 1), F.date_add("d", days)), lambda t: row(t, F.date_add("d", 1), 0))
    own = F.array(row(F.col("d"), F.col("d"), 1))
    last = F.max("d").over(Window.partitionBy("item"))
    x = obs.withColumn("last", last).withColumn("r", F.explode(F.when(F.col("d") == F.col("last"), F.concat(own, after)).otherwise(own)))
    return x.select("item", "r.*", *[F.when(F.col("r.real") == 1, F.col(c)).alias(c) for c in ("supply", "sold", "censored", "wasted")])


def with_own_days(obs: DataFrame, leads: tuple[int, ...] = (0,)) -> DataFrame:
    """Rows on record, each also as a target for its own day, seen from its morning or from lead days earlier. Targets carry the row as
    own, with its price and cost, so nothing is read or joined again."""
    each = F.array(F.struct(F.lit(1).alias("real"), F.lit(0).alias("lead")), *[F.struct(F.lit(0).alias("real"), F.lit(n).alias("lead")) for n in leads])
    x = obs.select(F.struct("*").alias("own"), F.explode(each).alias("r"))
    real = F.col("r.real") == 1
    seen = [F.when(real, F.col("own")[c]).alias(c) for c in ("supply", "sold", "censored", "wasted")]
    return x.select("own.item", F.col("own.d").alias("t"), F.date_sub("own.d", F.col("r.lead")).alias("c"), "r.real", *seen, "own.price", "own.cost", F.when(~real, F.col("own")).alias("own"))


def placed(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """rows with the places at, at_dow and at_kind among all of the item, the weekday's and the days with or without promotion, and e: what
    a row weighs, twice as much every HALF_LIFE days, measured from the item's last row."""
    x = rows.withColumn("dow", isodow("t")).withColumn("promo", is_promo("dow", costs))
    # A target comes before the row of its own day.
    place = lambda *by: 2 * F.sum("real").over(Window.partitionBy(*by).orderBy("c", "real", "t").rowsBetween(Window.unboundedPreceding, 0)) + 1 - F.col("real")
    x = x.withColumns({"at": place("item"), "at_dow": place("item", "dow"), "at_kind": place("item", "promo")})
    x = x.withColumn("last", F.max(F.when(F.col("real") == 1, F.col("t"))).over(Window.partitionBy("item")))
    return x.withColumn("e", F.when(F.col("real") == 1, F.pow(F.lit(2.0), F.datediff("t", "last") / HALF_LIFE)))


def _weighted(all_rows: Column, weekday: Column) -> Column:
    """The sum of weights seen from a target: other weekdays count OTHER."""
    seen = F.pow(F.lit(0.5), F.datediff("t", "last") / HALF_LIFE)
    return seen * (OTHER * F.coalesce(all_rows, F.lit(0.0)) + (1 - OTHER) * F.coalesce(weekday, F.lit(0.0)))


def recent(x: DataFrame) -> DataFrame:
    """x with, for targets: days on record, most supplied recently (7 rows and 2 of the weekday), whether that ceiling was hit, whether any of
    the last 10 rows was supplied, popularity (mean sales of the last 28 rows), what the last rows were like, and kind: the last
    8 rows with or without promotion, as the target has it."""
    i = lambda n: _before(n, "item", at="at")
    w = lambda n: _before(n, "item", "dow", at="at_dow")
    out = F.when(F.col("censored"), F.col("supply"))
    x = x.withColumns({
        "days": F.count("supply").over(i(0)), "cap": F.greatest(F.max("supply").over(i(7)), F.max("supply").over(w(2))), "most": F.max("supply").over(i(0)),
        "cap_sold_out": F.greatest(F.max(out).over(i(7)), F.max(out).over(w(2))), "supplied10": F.coalesce(F.max("supply").over(i(10)), F.lit(0)),
        "popularity": F.avg("sold").over(i(28)), "weight": _weighted(F.sum("e").over(i(0)), F.sum("e").over(w(0))),
        "n_weekday": F.count("supply").over(w(8)), "n_recent": F.count("supply").over(i(10)), "so10": F.count_if("censored").over(i(10)), "w10": F.sum("wasted").over(i(10)),
        "naive": round_half_up(F.avg("sold").over(w(4))), "n_naive": F.count("sold").over(w(4)),
        "kind": F.collect_list(F.when(F.col("real") == 1, F.struct("supply", "censored"))).over(_before(8, "item", "promo", at="at_kind")),
    })
    ceiling = F.coalesce((F.col("cap_sold_out") >= F.col("cap")) & (F.col("cap_sold_out") > 0), F.lit(False))
    return x.withColumn("ceiling", ceiling).drop("cap_sold_out", "at_dow", "at_kind", "censored", "wasted")


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """The targets of one item and block of units, from the item's rows that reach it: g of each unit, and upto, the sum of their logarithms so far
    within the block. Memory holds one number per row and unit of the block."""
    at, real, dow, units, sold, e, seen, weight = (rows[c].to_numpy() for c in ("at", "real", "dow", "units", "sold", "e", "seen", "weight"))
    own = np.flatnonzero(real == 0)
    past = np.flatnonzero(real == 1)
    past = past[np.argsort(at[past])]
    first = key[1].as_py() * BLOCK
    j = first + np.arange(BLOCK)

    def total(counts: np.ndarray) -> np.ndarray:
        """What the targets see of counts, a row per past row: other weekdays count OTHER."""
        out = np.zeros((len(own), BLOCK))
        for day in (None, *np.unique(dow[own])):
            of, to = (past, own) if day is None else (past[dow[past] == day], own[dow[own] == day])
            mine = counts if day is None else counts[dow[past] == day]
            sums = np.vstack([np.zeros(BLOCK), np.cumsum(mine, axis=0)])[np.searchsorted(at[of], at[to])]
            out[slice(None) if day is None else dow[own] == day] += (OTHER if day is None else 1 - OTHER) * sums
        return out * seen[own, None]

    had, got = units[past, None] > j, sold[past, None]
    weighed = lambda there: np.where(there, e[past, None], 0.0)
    m = np.where(total(weighed(had)) >= 0.9 * weight[own, None], 1.0, 5.0)
    g = (total(weighed(had & (got > j))) + 0.5 * m) / (total(weighed(had & (got >= j))) + m)
    upto = np.cumsum(np.log(g), axis=1)
    n = np.minimum(units[own] - first, BLOCK)
    asked, ends = np.arange(BLOCK) < n[:, None], np.r_[0, np.cumsum(n)].astype(np.int32)
    each = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v[asked]))
    return rows.select([*KEY, "block", "rest"]).take(pa.array(own)).append_column("g", each(g)).append_column("upto", each(upto)).append_column("sum", pa.array(upto[np.arange(len(own)), n - 1]))


def chances(r: DataFrame, by_unit: bool = True) -> DataFrame:
    """The targets of r with paying, how many units have a chance of the break-even be or more, and steps_g and chances, arrays by unit: the chance that it sells
    if those before did, shrunk to a half, and that it sells at all. Without by_unit there are no arrays: units that pay are counted block by block.

    A row on record speaks for the units it had; a target asks for each unit up to what was ever supplied. Units are dealt in blocks, so that an item's rows
    travel once per BLOCK units; running sums by block answer all targets, and a target's blocks meet again.
    """
    real = F.col("real") == 1
    units = F.when(real, F.col("supply")).otherwise(F.coalesce(F.greatest(F.col("cap") + 2, F.col("most") + 1), F.lit(1))).cast("long")
    kept = [c for c in r.columns if c not in (*KEY, "real", "e", "supply", "sold", "at", "last", "weight")]
    zero = lambda c, v=0.0: F.coalesce(c, F.lit(v))
    x = r.where(units > 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((units - 1) / BLOCK).cast("int"))))
    # The rest of a target is the same in all its blocks; that of its first one stands for them.
    rest = F.when(~real & (F.col("block") == 0), F.struct(*kept))
    seen = zero(F.pow(F.lit(0.5), F.datediff("t", "last") / HALF_LIFE), 1.0)
    x = x.select(*KEY, "block", "at", "real", "dow", units.alias("units"), zero("sold", 0).alias("sold"), zero("e").alias("e"), seen.alias("seen"), zero("weight").alias("weight"), rest.alias("rest"))
    kinds = {f.name: f.dataType for f in x.schema}
    made = StructType([StructField(c, kinds[c]) for c in (*KEY, "block", "rest")])
    made = (made.add("g", ArrayType(DoubleType())) if by_unit else made).add("upto", ArrayType(DoubleType())).add("sum", "double")
    run = _block if by_unit else lambda key, rows: _block(key, rows).drop_columns("g")
    # Rows are few bytes for the work on them, so that their blocks keep the session's number of partitions instead of being merged by size.
    n = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = x.repartition(n, "item", "block").groupBy("item", "block").applyInArrow(run, made)
    # The product up to each unit is a running sum of logarithms, so that it takes time in proportion to the units.
    by_block = Window.partitionBy(*KEY).orderBy("block")
    before = zero(F.sum("sum").over(by_block.rowsBetween(Window.unboundedPreceding, -1)))
    one = one.withColumns({"before": before, "be": F.first("rest.be").over(by_block)}).withColumn("s", F.transform("upto", lambda v: F.exp(F.col("before") + v)))
    paying, rest = F.sum(F.size(F.filter("s", lambda v: v >= F.col("be")))).cast("int").alias("paying"), F.first("rest", ignorenulls=True).alias("rest")
    if not by_unit:
        return one.groupBy(*KEY).agg(paying, rest).select(*KEY, "rest.*", "paying")
    one = one.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "g", "s"))).alias("x"), paying, rest)
    return one.select(*KEY, "rest.*", "paying", F.flatten("x.g").alias("steps_g"), F.flatten("x.s").alias("chances"))


def continuation(popularity: Column) -> Column:
    """Chance that one more unit sells after the usual amount did, by sales per day (fixed values)."""
    return F.when(popularity < 1, 0.42).when(popularity < 2, 0.62).otherwise(0.70)


def base(s: DataFrame) -> DataFrame:
    """chances() with base and testing: the units whose chance pays, up to one above the recent most if that sold out; at least one of what was
    supplied lately. Null with under a week on record or without economics; the chances stay."""
    q = F.least("paying", F.col("cap") + F.col("ceiling").cast("int"))
    q = F.when((q < 1) & (F.col("supplied10") > 0), 1).otherwise(q)
    known = (F.col("days") >= LEAST_DAYS) & F.col("be").isNotNull()
    out = s.withColumns({"base": F.when(known, q.cast("long")), "cont": continuation(F.col("popularity"))})
    return out.withColumn("testing", F.coalesce(F.col("base") > F.col("cap"), F.lit(False))).drop("paying")


def climb(b: DataFrame, level: int = 3) -> DataFrame:
    """b with n, sold_out, steps, confidence and mean: how many further units are sure enough to pay, by a Beta posterior of how often
    days of the same kind sold out at the base or above."""
    tries = F.filter("kind", lambda k: k["supply"] >= F.greatest(F.lit(1), F.coalesce("base", F.lit(1 << 30))))
    out = b.withColumns({"n": F.size(tries).cast("long"), "sold_out": F.size(F.filter(tries, lambda k: k["censored"])).cast("long")})
    a, z = 1 + F.col("sold_out"), 1 + F.col("n") - F.col("sold_out")
    enough = (F.col("n") >= 3) & F.col("base").isNotNull()
    tail = lambda k: beta_tail(a, z, F.col("be") / F.pow("cont", F.lit(float(k))))
    mean = a / (a + z)
    if level == 1:
        return out.withColumns({"steps": F.lit(0), "confidence": F.lit(0.0), "mean": mean})
    sure, most, _ = AMBITION[level]
    steps = F.lit(0)
    for k in range(most, 0, -1):
        steps = F.when(tail(k) >= sure, 1 + steps).otherwise(0)
    return out.withColumns({"steps": F.when(enough, steps).otherwise(0), "confidence": F.when(enough, tail(1)).otherwise(0.0), "mean": mean})


def budgeted(q: DataFrame, level: int = 3) -> DataFrame:
    """q with quantity: the further units of all items of a day, the best edges first, as far as the day's budget goes; an item keeps a gapless
    run of them."""
    if level == 1:
        return q.withColumn("quantity", F.col("base"))
    # Unit 0 carries the row; the others compete for the day's budget.
    each = q.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    each = each.withColumn("edge", F.when(F.col("k") > 0, F.col("mean") * F.pow("cont", F.col("k").cast("double")) - F.col("be")))
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("t", "c").orderBy(F.col("edge").desc_nulls_last(), "item", "k")))
    taken = F.array_sort(F.collect_list(F.when((F.col("k") > 0) & (F.col("place") <= AMBITION[level][2]), F.col("k"))))
    rest = F.first(F.when(F.col("k") == 0, F.struct(*[c for c in q.columns if c not in KEY])), ignorenulls=True)
    one = each.groupBy(*KEY).agg(taken.alias("taken"), rest.alias("rest"))
    # Of the taken units those that equal their rank make the gapless run.
    extra = F.size(F.filter("taken", lambda k, i: k == i + 1))
    return one.select(*KEY, "rest.*", extra.alias("extra")).withColumn("quantity", F.col("base") + F.col("extra"))


def ladders(rows: DataFrame, econ: DataFrame | None = None, costs: Costs = Costs(), by_unit: bool = True) -> DataFrame:
    """One row per target of with_targets() or with_own_days(): its ladder and base quantity. There is one row per item and day. Without econ, rows have price and
    cost. Without by_unit there are no arrays steps_g and chances."""
    r = recent(placed(rows, costs))
    return base(chances(effective(r, costs) if econ is None else with_economics(r, econ, costs, "left"), by_unit))


def decided(rows: DataFrame, econ: DataFrame | None = None, level: int = 3, costs: Costs = Costs(), by_unit: bool = True) -> DataFrame:
    """ladders() with the further units that the ambition level takes and the day's budget allows."""
    return budgeted(climb(ladders(rows, econ, costs, by_unit), level), level)


def _thinned(chances: np.ndarray, share: float, k: int) -> float:
    """Chance that the k-th unit sells when each buyer comes with the chance share: the k-th of those that come is the d-th that would have, and
    d of them would have. Past the ladder chances halve; twelve such units are enough. Binomials are taken as logarithms, as powers of the share are zero
    among hundreds of units."""
    far = np.r_[chances, chances[-1] * 0.5 ** np.arange(1, 13)]
    if k > len(far) or share <= 0:
        return 0.0
    if share >= 1:
        return float(far[k - 1])
    logs, d = np.r_[0.0, np.cumsum(np.log(np.arange(1, len(far) + 1)))], np.arange(k, len(far) + 1)
    return float(np.exp(logs[d - 1] - logs[k - 1] - logs[d - k] + k * np.log(share) + (d - k) * np.log1p(-share)) @ far[k - 1 :])


def thinned(chances: Column, share: Column, k: Column) -> Column:
    """_thinned() on columns."""

    def run(c: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([_thinned(np.asarray(x, float), y, int(z)) for x, y, z in zip(c, s, k)], dtype=float)

    return F.pandas_udf(run, DoubleType())(chances, share, k)


def paying_in_rain(chances: Column, share: Column, chance: Column, be: Column, top: Column) -> Column:
    """How many of the first top units pay if it rains with that chance. Chances fall from unit to unit, and so do those in rain, so the last that pays is found by halving:
    time grows with the units, not with their square."""

    def run(c: pd.Series, s: pd.Series, r: pd.Series, b: pd.Series, t: pd.Series) -> pd.Series:
        out = []
        for own, share, rain, be, top in zip(c, s, r, b, t):
            low, high = 0, 0 if pd.isna(top) or pd.isna(be) or own is None else int(top)
            while low < high:
                k = (low + high + 1) // 2
                dry = own[k - 1] if k <= len(own) else np.nan
                low, high = (k, high) if rain * _thinned(own, share, k) + (1 - rain) * dry >= be else (low, k - 1)
            out.append(low)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(run, LongType())(chances, share, chance, be, top)


def rained(decisions: DataFrame, share: Column, chance: Column) -> DataFrame:
    """decided() for days on which it rains with that chance and then that share of buyers comes: rainy_base is what still pays, at least the one
    unit that was given, and there are no trials (above the recent most, or further units) if rain is as likely as not. Weather that
    keeps nobody away changes nothing; quantity and cut say what is made in the end and how many units rain took."""
    wet = (share < 1) & (chance > 0) & F.col("base").isNotNull()
    off = wet & (chance >= 0.5)
    top = F.when(off, F.greatest(F.least("base", "cap"), F.least("base", F.lit(1)))).otherwise(F.col("base")).cast("int")
    paying = paying_in_rain(F.col("chances"), share, chance, F.col("be"), top)
    rainy = F.when(wet, F.greatest(paying, F.least("base", F.lit(1)))).otherwise(F.col("base"))
    made = rainy + F.when(off, 0).otherwise(F.col("quantity") - F.col("base"))
    return decisions.withColumns({"rainy_base": rainy, "cut": F.col("quantity") - made, "quantity": made})
