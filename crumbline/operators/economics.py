"""Prices, costs and what a wrong quantity costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Costs:
    """Running costs that are assumptions: a promotion's weekdays (1 is Monday) and price, and the like."""

    promo_weekdays: tuple[int, ...] = (3,)
    promo_multiplier: float = 2.0 / 3.0
    markdown_share: float = 0.0
    markdown_fraction: float = 0.30
    labour: float = 0.0
    sale_share: float = 1.0
    salvage: float = 0.0


def is_promo(dow: Column | str, costs: Costs = Costs()) -> Column:
    return F.col(dow).isin(*costs.promo_weekdays) if isinstance(dow, str) else dow.isin(*costs.promo_weekdays)


def with_economics(df: DataFrame, econ: DataFrame, costs: Costs = Costs(), how: str = "inner") -> DataFrame:
    """effective() of df(item, dow) with the prices and costs of econ(item, price, cost). Items without economics go, or have nulls with how = "left"."""
    return effective(df.join(econ, "item", how), costs)


def effective(df: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """df(dow, price, cost) with eff_price, eff_cost, cu, co, cr and be: the price after promotion, markdown and the store's share, the cost with
    labour, the cost of a unit short and of one too many, the critical ratio (null if co is not positive, 0 if cu is not) and the
    break-even chance.
    """
    price = F.when(is_promo("dow", costs), F.col("price") * costs.promo_multiplier).otherwise(F.col("price"))
    price = price * (1.0 - costs.markdown_fraction * costs.markdown_share) * costs.sale_share
    out = df.withColumns({"eff_price": price, "eff_cost": F.col("cost") + costs.labour})
    out = out.withColumns({"cu": F.greatest(F.lit(0.0), F.col("eff_price") - F.col("eff_cost")), "co": F.greatest(F.lit(0.0), F.col("eff_cost") - costs.salvage)})
    cr = F.when(F.col("co") <= 0, F.lit(None)).when(F.col("cu") <= 0, 0.0).otherwise(F.col("cu") / (F.col("cu") + F.col("co")))
    return out.withColumn("cr", cr.cast("double")).withColumn("be", 1.0 - F.col("cr"))


def waste_cost(q: Column, demand: Column, co: Column) -> Column:
    return F.when(q >= demand, co * (q - demand)).otherwise(0.0)


def stockout_cost(q: Column, demand: Column, cu: Column) -> Column:
    return F.when(q >= demand, 0.0).otherwise(cu * (demand - q))


def scored(df: DataFrame, q: str = "q", factor: float | Column = 1.0) -> DataFrame:
    """df(q, supply, sold, censored, cu, co) with demand, waste_cost, stockout_cost, cost and unidentified.

    Demand is what was sold, times factor on days that sold out: with a factor of 1 a lower bound there.
    """
    factor = F.lit(factor) if isinstance(factor, (int, float)) else factor
    demand = F.when(F.col("censored"), F.col("sold") * factor).otherwise(F.col("sold").cast("double"))
    out = df.withColumn("demand", demand.cast("double"))
    out = out.withColumns({"waste_cost": waste_cost(F.col(q), F.col("demand"), F.col("co")), "stockout_cost": stockout_cost(F.col(q), F.col("demand"), F.col("cu"))})
    return out.withColumns({"cost_of_error": F.col("waste_cost") + F.col("stockout_cost"), "unidentified": F.col("censored") & (F.col(q) > F.col("supply"))})
