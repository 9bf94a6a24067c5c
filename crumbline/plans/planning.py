"""Queries: observations, policies and their scores, the ladder and what is built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crumbline.functions import scalars as S
from crumbline.operators import ladder as L
from crumbline.operators import policies as P
from crumbline.operators.economics import Costs, scored, with_economics
from crumbline.operators.observations import by_item, by_weekday, isodow, with_day_rule
from crumbline.shared import written
from crumbline.sources.adapter import OBS, counts, economics, observations, table

from .registry import twin

#: obs with economics, in SQL.
EOBS = (
    OBS
    + """, eo AS (
  SELECT obs.*, price, cost, CASE WHEN dow = 3 THEN price * (2e0 / 3e0) ELSE price END AS p, cost AS c FROM obs JOIN econ USING (item)
), x AS (
  SELECT *, greatest(0e0, p - c) AS cu, greatest(0e0, c) AS co, CASE WHEN c <= 0 THEN NULL WHEN p - c <= 0 THEN 0e0 ELSE (p - c) / ((p - c) + c) END AS cr FROM eo
)"""
)


def eobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_economics(observations(spark, sf_dir), economics(spark))


@twin("src_prj1_observations", f"WITH {OBS} SELECT d, item, made, refill, wasted, supply, sold, censored, dow FROM obs")
def _(spark, d):
    return observations(spark, d).select("d", "item", "made", "refill", "wasted", "supply", "sold", "censored", "dow")


#: Waste is counted for every tenth supplier's lines only, so there are days on which nothing was counted.
THIN = """cells AS (
  SELECT l_shipdate::DATE AS d, p_type AS item, count(*) FILTER (WHERE l_returnflag <> 'A') AS made, count(*) FILTER (WHERE l_returnflag = 'A') AS refill,
    nullif(count(*) FILTER (WHERE l_returnflag = 'R' AND l_suppkey % 10 = 0), 0) AS wasted
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), day AS (SELECT d, bool_or(wasted IS NOT NULL) AS counted FROM cells WHERE made + refill > 0 GROUP BY 1)"""


def thin_cells(spark, d):
    """All lines by item and day; what was left is known for every tenth supplier only, and blank means not counted."""
    lines = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_partkey", F.col("l_returnflag").alias("f"), (F.col("l_suppkey") % 10 == 0).alias("told"))
    joined = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_type").alias("item")).hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    f = F.col("f")
    cells = joined.groupBy("d", "item").agg(F.count_if(f != "A").alias("made"), F.count_if(f == "A").alias("refill"), F.nullif(F.count_if((f == "R") & F.col("told")), F.lit(0)).alias("wasted"))
    return cells.withColumn("supply", F.col("made") + F.col("refill"))


@twin("src1_day_rule", f"WITH {THIN} SELECT c.d, item, made, refill, coalesce(wasted, 0) AS wasted, greatest(0, made + refill - coalesce(wasted, 0)) AS sold FROM cells c JOIN day ON day.d = c.d AND counted WHERE day(c.d) <> 13")
def _(spark, d):
    cells = thin_cells(spark, d)
    outages = cells.where("day(d) = 13").select("d").distinct()
    return with_day_rule(cells, outages).select("d", "item", "made", "refill", "wasted", "sold")


@twin("src2_set1_uncounted_days", f"WITH {THIN} SELECT d FROM day WHERE NOT counted EXCEPT SELECT d FROM day WHERE day(d) = 13")
def _(spark, d):
    cells = thin_cells(spark, d)
    produced = cells.where("supply > 0").select("d").distinct()
    counted = cells.where("wasted is not null").select("d").distinct()
    return produced.subtract(counted).subtract(cells.where("day(d) = 13").select("d").distinct())


@twin("src3_outage_days", "SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem WHERE lower(trim(CASE WHEN day(l_shipdate) = 13 THEN ' TRUE ' ELSE 'no' END)) = 'true'")
def _(spark, d):
    days = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    flag = F.when(F.dayofmonth("d") == 13, " TRUE ").otherwise("no")
    return days.where(F.lower(F.trim(flag)) == "true")


@twin("prj3_6_critical_ratio", f"WITH {EOBS} SELECT DISTINCT item, dow, round(p, 6) AS eff_price, c AS eff_cost, round(cu, 6) AS cu, round(co, 6) AS co, round(cr, 6) AS cr FROM x")
def _(spark, d):
    return eobs(spark, d).select("item", "dow", F.round("eff_price", 6).alias("eff_price"), "eff_cost", F.round("cu", 6).alias("cu"), F.round("co", 6).alias("co"), F.round("cr", 6).alias("cr")).distinct()


@twin("prj3_5_what_if_economics", f"""WITH {OBS}, s AS (SELECT * FROM (VALUES (0e0, 1e0, 0e0), (0.5e0, 0.75e0, 0.3e0), (1e0, 0.9e0, 0e0)) AS t(labour, share, md)),
y AS (SELECT DISTINCT item, dow, labour, share, md, CASE WHEN dow = 3 THEN price * (2e0 / 3e0) ELSE price END * (1e0 - 0.3e0 * md) * share AS p, cost + labour AS c FROM obs JOIN econ USING (item), s)
SELECT item, dow, labour, share, round(p, 6) AS eff_price, round(c, 6) AS eff_cost, round(CASE WHEN p - c <= 0 THEN 0e0 ELSE (p - c) / (greatest(0e0, p - c) + c) END, 6) AS cr FROM y""")
def _(spark, d):
    keys = observations(spark, d).select("item", "dow").distinct()
    out = None
    for labour, share, md in ((0.0, 1.0, 0.0), (0.5, 0.75, 0.3), (1.0, 0.9, 0.0)):
        one = with_economics(keys, economics(spark), Costs(labour=labour, sale_share=share, markdown_share=md))
        one = one.select("item", "dow", F.lit(labour).alias("labour"), F.lit(share).alias("share"), F.round("eff_price", 6).alias("eff_price"), F.round("eff_cost", 6).alias("eff_cost"), F.round("cr", 6).alias("cr"))
        out = one if out is None else out.union(one)
    return out


@twin("prj4_7_item_promo_ratio", f"""WITH {OBS}, y AS (SELECT DISTINCT item, dow, cost, CASE WHEN item IN ('PROMO', 'SMALL') AND dow IN (2, 5) THEN price * 0.8e0 WHEN dow = 3 THEN price * (2e0 / 3e0) ELSE price END AS p FROM obs JOIN econ USING (item))
SELECT item, dow, round(p, 6) AS price, round(CASE WHEN p - cost > 0 AND cost > 0 THEN (p - cost) / p END, 6) AS cr FROM y""")
def _(spark, d):
    keys = observations(spark, d).select("item", "dow").distinct().join(economics(spark), "item")
    own = F.when(F.col("item").isin("PROMO", "SMALL"), F.array(F.lit(2), F.lit(5))).otherwise(F.array().cast("array<int>"))
    p = F.when(F.array_contains(own, F.col("dow")), F.col("price") * 0.8).when(F.col("dow") == 3, F.col("price") * (2.0 / 3.0)).otherwise(F.col("price"))
    cr = F.when((p - F.col("cost") > 0) & (F.col("cost") > 0), (p - F.col("cost")) / p)
    return keys.select("item", "dow", F.round(p, 6).alias("price"), F.round(cr, 6).alias("cr"))


MEAN = "CASE WHEN count(sold) OVER w4 >= 2 THEN greatest(0, floor(avg(sold) OVER w4 + 0.5e0))::DOUBLE END"
QUANT = """s AS (SELECT *, list_sort(list(sold::DOUBLE) OVER w8) AS v, coalesce(max(supply) OVER w8, 0) AS ms FROM x WINDOW w8 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
qq AS (SELECT *, cr * (len(v) - 1) AS pos, greatest(0, floor(v[floor(cr * (len(v) - 1))::INT + 1] + (cr * (len(v) - 1) - floor(cr * (len(v) - 1))) * (v[least(floor(cr * (len(v) - 1))::INT + 1, len(v) - 1) + 1] - v[floor(cr * (len(v) - 1))::INT + 1]) + 0.5e0)) AS q0 FROM s)"""


@twin("win1_dom2_same_weekday_mean", f"WITH {OBS} SELECT d, item, {MEAN} AS q FROM obs WINDOW w4 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return P.same_weekday_mean(observations(spark, d)).select("d", "item", "q")


@twin("win2_dom3_same_weekday_quantile", f"WITH {EOBS}, {QUANT} SELECT d, item, CASE WHEN len(v) >= 4 THEN CASE WHEN q0 < 1 AND ms > 0 THEN 1e0 ELSE q0::DOUBLE END END AS q FROM qq")
def _(spark, d):
    return P.same_weekday_quantile(eobs(spark, d)).select("d", "item", "q")


@twin("dom4_fallback_quantile", f"WITH {EOBS}, {QUANT} SELECT d, item, CASE WHEN len(v) >= 3 THEN q0::DOUBLE END AS q FROM qq")
def _(spark, d):
    return P.fallback_quantile(eobs(spark, d)).select("d", "item", "q")


#: The ladder at every day on record, level by level, from running sums over a dense grid of items, days and units; rc(level, item, d, q).
ALL_LADDERS = """em AS (SELECT *, power(2e0, date_diff('day', max(d) OVER (PARTITION BY item), d) / 21e0) AS e, power(0.5e0, date_diff('day', max(d) OVER (PARTITION BY item), d) / 21e0) AS back, dow = 3 AS promo, CASE WHEN censored THEN supply END AS cs FROM x
), rr AS (
  SELECT *, row_number() OVER i - 1 AS days, greatest(max(supply) OVER w7, max(supply) OVER d2) AS cap, max(supply) OVER bf AS most, greatest(max(cs) OVER w7, max(cs) OVER d2) AS cso, coalesce(max(supply) OVER w10, 0) AS s10,
    avg(sold) OVER w28 AS popularity, back * (0.3e0 * sum(e) OVER bf + 0.7e0 * coalesce(sum(e) OVER db, 0)) AS weight, list({'s': supply, 'o': censored}) OVER k8 AS kind
  FROM em WINDOW i AS (PARTITION BY item ORDER BY d), bf AS (PARTITION BY item ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), db AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    w7 AS (PARTITION BY item ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY item ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), w28 AS (PARTITION BY item ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
    d2 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), k8 AS (PARTITION BY item, promo ORDER BY d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
), gr AS (SELECT item, d, dow, supply, sold, e, back, weight, cap, most, unnest(range(0, (max(supply) OVER (PARTITION BY item) + 3)::BIGINT)) AS j FROM rr
), gs AS (
  SELECT item, d, j, weight, cap, most, back * (0.3e0 * coalesce(sum(CASE WHEN supply > j THEN e END) OVER u, 0) + 0.7e0 * coalesce(sum(CASE WHEN supply > j THEN e END) OVER v, 0)) AS mw,
    back * (0.3e0 * coalesce(sum(CASE WHEN supply > j AND sold >= j THEN e END) OVER u, 0) + 0.7e0 * coalesce(sum(CASE WHEN supply > j AND sold >= j THEN e END) OVER v, 0)) AS tw,
    back * (0.3e0 * coalesce(sum(CASE WHEN supply > j AND sold > j THEN e END) OVER u, 0) + 0.7e0 * coalesce(sum(CASE WHEN supply > j AND sold > j THEN e END) OVER v, 0)) AS sw
  FROM gr WINDOW u AS (PARTITION BY item, j ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY item, j, dow ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), gg AS (SELECT item, d, j + 1 AS k, (sw + 0.5e0 * m) / (tw + m) AS g FROM (SELECT *, CASE WHEN mw >= 0.9e0 * weight THEN 1e0 ELSE 5e0 END AS m FROM gs WHERE j < greatest(cap + 2, most + 1))
), ss AS (SELECT item, d, k, exp(sum(ln(g)) OVER (PARTITION BY item, d ORDER BY k)) AS s FROM gg
), bs AS (
  SELECT rr.*, 1e0 - cr AS be, CASE WHEN days >= 7 AND cr IS NOT NULL THEN CASE WHEN least(paying, cap + coalesce(cso >= cap AND cso > 0, false)::INT) < 1 AND s10 > 0 THEN 1 ELSE least(paying, cap + coalesce(cso >= cap AND cso > 0, false)::INT) END END AS base,
    CASE WHEN popularity < 1 THEN 0.42e0 WHEN popularity < 2 THEN 0.62e0 ELSE 0.70e0 END AS cont
  FROM rr LEFT JOIN (SELECT ss.item, ss.d, count(*) FILTER (WHERE s >= 1e0 - cr) AS paying FROM ss JOIN x ON x.item = ss.item AND x.d = ss.d GROUP BY 1, 2) USING (item, d)
), ks AS (SELECT *, len(list_filter(kind, lambda z: z.s >= greatest(1, base))) AS n, len(list_filter(kind, lambda z: z.s >= greatest(1, base) AND z.o)) AS so FROM bs
), lv AS (SELECT * FROM (VALUES (1, 2e0, 0, 0), (2, 0.90e0, 1, 4), (3, 0.75e0, 2, 8), (4, 0.60e0, 3, 12), (5, 0.50e0, 3, 16)) AS t(level, sure, step_most, budget)
), tl AS (SELECT ks.*, kk, be / power(cont, kk) AS y, 1 + so AS a, 1 + n - so AS b FROM ks, (SELECT unnest([1, 2, 3]) AS kk) WHERE n >= 3 AND base IS NOT NULL
), tv AS (SELECT item, d, be, cont, a, b, kk, CASE WHEN y <= 0 THEN 1e0 WHEN y >= 1 THEN 0e0 ELSE list_sum(list_transform(range(0, a), lambda i: exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i)) * power(y, i) * power(1 - y, a + b - 1 - i))) END AS tail FROM tl
), pt AS (SELECT level, budget, item, d, kk, a::DOUBLE / (a + b) * power(cont, kk) - be AS edge, min(tail) OVER (PARTITION BY level, item, d ORDER BY kk) AS worst, sure, step_most FROM tv, lv
), kp AS (SELECT *, row_number() OVER (PARTITION BY level, d ORDER BY edge DESC, item, kk) AS place FROM pt WHERE worst >= sure AND kk <= step_most
), xt AS (SELECT level, item, d, max(kk) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY level, item, d ORDER BY kk) AS rk FROM kp WHERE place <= budget) WHERE kk = rk GROUP BY 1, 2, 3
), rc AS (SELECT lv.level, ks.item, ks.d, ks.supply, ks.sold, ks.days, (base + coalesce(extra, 0))::DOUBLE AS q FROM ks CROSS JOIN lv LEFT JOIN xt ON xt.level = lv.level AND xt.item = ks.item AND xt.d = ks.d
)"""
BACK = f"""{EOBS}, {QUANT}, {ALL_LADDERS}, ends AS (SELECT min(d) AS lo FROM obs), pol AS (
  SELECT 'operator_actual' AS policy, x.*, supply::DOUBLE AS q FROM x
  UNION ALL SELECT 'same_weekday_mean', x.*, {MEAN} FROM x WINDOW w4 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT 'same_weekday_quantile', d, item, made, refill, wasted, supply, sold, censored, dow, price, cost, p, c, cu, co, cr, CASE WHEN len(v) >= 4 THEN CASE WHEN q0 < 1 AND ms > 0 THEN 1e0 ELSE q0::DOUBLE END END FROM qq
  UNION ALL SELECT 'roll_chance', x.*, rc.q FROM x LEFT JOIN rc ON rc.item = x.item AND rc.d = x.d AND rc.level = 3
), f AS (SELECT pol.*, factor, CASE WHEN censored THEN sold * factor ELSE sold::DOUBLE END AS demand FROM pol, ends, (SELECT unnest([1e0, 1.1e0, 1.25e0, 1.5e0]) AS factor) WHERE d >= lo + 28),
sc AS (SELECT *, CASE WHEN q >= demand THEN co * (q - demand) ELSE CASE WHEN q IS NULL THEN NULL ELSE 0e0 END END AS w, CASE WHEN q >= demand THEN 0e0 ELSE cu * (demand - q) END AS so FROM f)"""
NAMES = ["operator_actual", "same_weekday_mean", "same_weekday_quantile", "roll_chance"]


@twin("dom17_agg6_backtest_totals", f"""WITH {BACK} SELECT policy, round(sum(w + so), 4) AS total_cost, round(sum(w), 4) AS waste_cost, round(sum(so), 4) AS stockout_cost, count(q) AS decisions,
count(*) - count(q) AS skipped, count(DISTINCT d) FILTER (WHERE q IS NOT NULL) AS days, round(sum(w + so) / count(DISTINCT d) FILTER (WHERE q IS NOT NULL), 6) AS cost_per_day,
round(count(*) FILTER (WHERE censored AND q > supply) / count(q), 6) AS unidentified_share, sum(q) AS units FROM sc WHERE factor = 1e0 GROUP BY 1""")
def backtest_totals(spark, d):
    return P.totals(P.walk_forward(eobs(spark, d), NAMES))


@twin("agg8_j8_compare_to_baseline", f"""WITH {BACK}, m AS (SELECT d, item, w + so AS bc FROM sc WHERE factor = 1e0 AND policy = 'same_weekday_mean' AND q IS NOT NULL)
SELECT policy, round(sum(w + so - bc), 4) AS delta, round(sum(w + so - bc) / nullif(sum(bc), 0), 6) AS pct, round(sum(w + so - bc) / count(DISTINCT d), 6) AS per_day, count(*) AS n, count(DISTINCT d) AS days
FROM sc JOIN m USING (d, item) WHERE factor = 1e0 AND policy <> 'same_weekday_mean' AND q IS NOT NULL GROUP BY 1""")
def _(spark, d):
    return P.compared(P.walk_forward(eobs(spark, d), NAMES), "same_weekday_mean")


@twin("dom18_sensitivity", f"WITH {BACK} SELECT factor, policy, round(sum(w + so), 4) AS total_cost FROM sc WHERE q IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    rows = P.walk_forward(eobs(spark, d), NAMES).drop("demand", "waste_cost", "stockout_cost", "cost_of_error", "unidentified")
    rows = rows.where("q is not null").withColumn("factor", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.1, 1.25, 1.5)])))
    return scored(rows, "q", F.col("factor")).groupBy("factor", "policy").agg(F.round(F.sum("cost_of_error"), 4).alias("total_cost"))


@twin("agg9_cost_by_weekday", f"WITH {BACK} SELECT dow, round(sum(w + so) FILTER (WHERE policy = 'operator_actual'), 4) AS operator_actual, round(sum(w + so) FILTER (WHERE policy = 'same_weekday_mean'), 4) AS same_weekday_mean, round(sum(w + so) FILTER (WHERE policy = 'same_weekday_quantile'), 4) AS same_weekday_quantile, round(sum(w + so) FILTER (WHERE policy = 'roll_chance'), 4) AS roll_chance FROM sc WHERE factor = 1e0 GROUP BY 1")
def _(spark, d):
    rows = P.walk_forward(eobs(spark, d), NAMES)
    pivoted = rows.groupBy("dow").pivot("policy", NAMES).agg(F.sum("cost_of_error"))
    return pivoted.select("dow", *[F.round(n, 4).alias(n) for n in NAMES])


@twin("agg9_srt4_worst_items", f"WITH {BACK} SELECT item, round(sum(w + so), 4) AS cost FROM sc WHERE factor = 1e0 AND policy = 'same_weekday_mean' GROUP BY 1 ORDER BY 2 DESC LIMIT 5")
def _(spark, d):
    rows = P.walk_forward(eobs(spark, d), ["same_weekday_mean"])
    return rows.groupBy("item").agg(F.round(F.sum("cost_of_error"), 4).alias("cost")).orderBy(F.col("cost").desc()).limit(5)


@twin("prj8_9_score_decisions", f"WITH {BACK} SELECT policy, d, item, q, demand, round(w, 6) AS waste_cost, round(so, 6) AS stockout_cost, censored AND q > supply AS unidentified FROM sc WHERE factor = 1.25e0 AND q IS NOT NULL")
def _(spark, d):
    rows = P.walk_forward(eobs(spark, d), NAMES, factor=1.25).where("q is not null")
    return rows.select("policy", "d", "item", "q", "demand", F.round("waste_cost", 6).alias("waste_cost"), F.round("stockout_cost", 6).alias("stockout_cost"), "unidentified")


@twin("dom16_roll_chance_levels", f"WITH {EOBS}, {ALL_LADDERS} SELECT level, item, d, q FROM rc")
def _(spark, d):
    """The rule at each ambition level for every day on record: ladders are made once, levels differ in the climb."""
    obs = eobs(spark, d)
    made = written(L.ladders(L.with_own_days(obs), by_unit=False), "ladders")
    one = lambda level: L.budgeted(L.climb(made, level), level).select(F.lit(level).alias("level"), "item", F.col("t").alias("d"), F.col("quantity").cast("double").alias("q"))
    return one(1).union(one(2)).union(one(3)).union(one(4)).union(one(5))


@twin("win3_4_dom11_features", f"""WITH {OBS}, f AS (SELECT *, coalesce(avg(sold) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 0e0) AS level, date_diff('day', min(d) OVER (PARTITION BY item), d) / 7e0 AS trend, row_number() OVER (PARTITION BY item ORDER BY d) AS nth FROM obs)
SELECT d, item, sold, round(level, 6) AS level, round(trend, 6) AS trend, (dow = 2)::INT AS dow2, (dow = 3)::INT AS dow3, (dow = 4)::INT AS dow4, (dow = 5)::INT AS dow5, (dow = 6)::INT AS dow6, (dow = 7)::INT AS dow7 FROM f WHERE nth > 3""")
def _(spark, d):
    f = P.features(observations(spark, d))
    return f.select("d", "item", "sold", F.round("level", 6).alias("level"), F.round("trend", 6).alias("trend"), *[f"dow{k}" for k in range(2, 8)])


@twin("win5_6_8_trailing_measures", f"""WITH {OBS} SELECT d, item, greatest(max(supply) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), max(supply) OVER (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)) AS recent_max,
round(avg(sold) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING), 6) AS popularity, round(avg(censored::INT) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS sellout_rate FROM obs""")
def _(spark, d):
    i, w = by_item(), by_weekday()
    return observations(spark, d).select(
        "d", "item", F.greatest(F.max("supply").over(P.earlier(i, 7)), F.max("supply").over(P.earlier(w, 2))).alias("recent_max"),
        F.round(F.avg("sold").over(P.earlier(i, 28)), 6).alias("popularity"), F.round(F.avg(F.col("censored").cast("int")).over(P.earlier(i, 10)), 6).alias("sellout_rate"),
    )


@twin("win9_agg12_extra_roll_rate", f"""WITH {OBS}, w AS (SELECT *, max(supply) OVER p3 AS usual, count(*) OVER p3 AS n FROM obs WINDOW p3 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT item, count(*) AS tried, count(*) FILTER (WHERE sold >= usual + 1) AS sold FROM w WHERE n = 3 AND supply > usual AND sold >= usual GROUP BY 1""")
def _(spark, d):
    past = P.earlier(by_weekday(), 3)
    rows = observations(spark, d).withColumns({"usual": F.max("supply").over(past), "n": F.count("*").over(past)}).where("n = 3 and supply > usual and sold >= usual")
    return rows.groupBy("item").agg(F.count("*").alias("tried"), F.count_if(F.col("sold") >= F.col("usual") + 1).alias("sold"))


@twin("win16_previous_day_record", f"""WITH {OBS} SELECT d, item, max(d) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_day, lag(supply) OVER (PARTITION BY item ORDER BY d) AS previous_supply, count(*) FILTER (WHERE censored) OVER (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sold_out_of_last_6 FROM obs""")
def _(spark, d):
    return observations(spark, d).select(
        "d", "item", F.lag("d").over(by_item()).alias("previous_day"), F.lag("supply").over(by_item()).alias("previous_supply"),
        F.count_if("censored").over(P.earlier(by_weekday(), 6)).alias("sold_out_of_last_6"),
    )


@twin("win17_range_frame_28_days", f"WITH {OBS} SELECT d, item, count(*) OVER r AS days, round(avg(sold) OVER r, 6) AS mean_sold FROM obs WINDOW r AS (PARTITION BY item ORDER BY d RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)")
def _(spark, d):
    days = F.datediff("d", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("item").orderBy("day_no").rangeBetween(-28, -1)
    return observations(spark, d).withColumn("day_no", days).select("d", "item", F.count("*").over(frame).alias("days"), F.round(F.avg("sold").over(frame), 6).alias("mean_sold"))


# ------------------------------------------------------------------ ladder --

LADDER = f"""{EOBS}, tg AS (SELECT item, max(d) + 1 AS t FROM obs GROUP BY 1), h AS (
  SELECT obs.*, t, dow = isodow(t) AS same, power(0.5e0, date_diff('day', d, t) / 21e0) * CASE WHEN dow = isodow(t) THEN 1e0 ELSE 0.3e0 END AS w,
    row_number() OVER (PARTITION BY item ORDER BY d DESC) AS nth, CASE WHEN dow = isodow(t) THEN row_number() OVER (PARTITION BY item, dow ORDER BY d DESC) END AS nth_same
  FROM obs JOIN tg USING (item) WHERE d < t
), r AS (
  SELECT item, t, count(*) AS days, max(supply) FILTER (WHERE nth <= 7 OR nth_same <= 2) AS cap, max(supply) AS most, max(supply) FILTER (WHERE (nth <= 7 OR nth_same <= 2) AND censored) AS cso,
    coalesce(max(supply) FILTER (WHERE nth <= 10), 0) AS s10, avg(sold) FILTER (WHERE nth <= 28) AS popularity, sum(w) AS weight FROM h GROUP BY 1, 2
), j AS (SELECT item, t, weight, unnest(range(0, greatest(cap + 2, most + 1)::BIGINT)) AS j FROM r
), sm AS (
  SELECT j.item, j.t, j, weight, coalesce(sum(w) FILTER (WHERE supply >= j + 1), 0) AS mw, coalesce(sum(w) FILTER (WHERE supply >= j + 1 AND sold >= j), 0) AS tw, coalesce(sum(w) FILTER (WHERE supply >= j + 1 AND sold >= j + 1), 0) AS sw
  FROM j JOIN h ON h.item = j.item GROUP BY 1, 2, 3, 4
), g AS (SELECT *, (sw + 0.5e0 * CASE WHEN mw >= 0.9e0 * weight THEN 1e0 ELSE 5e0 END) / (tw + CASE WHEN mw >= 0.9e0 * weight THEN 1e0 ELSE 5e0 END) AS g FROM sm
), s AS (SELECT item, t, j + 1 AS k, g, exp(sum(ln(g)) OVER (PARTITION BY item ORDER BY j)) AS s FROM g
), ec AS (SELECT item, t, price, cost, p, 1e0 - CASE WHEN p - cost <= 0 THEN 0e0 ELSE (p - cost) / p END AS be FROM (SELECT tg.item, t, price, cost, CASE WHEN isodow(t) = 3 THEN price * (2e0 / 3e0) ELSE price END AS p FROM tg JOIN econ USING (item))
), ba AS (
  SELECT r.*, be, p, cost, coalesce(cso >= cap AND cso > 0, false) AS ceiling, least(paying, cap + coalesce(cso >= cap AND cso > 0, false)::INT) AS q0
  FROM r JOIN ec USING (item, t) JOIN (SELECT item, t, count(*) FILTER (WHERE s >= be) AS paying FROM s JOIN ec USING (item, t) GROUP BY 1, 2) USING (item, t)
), bb AS (SELECT *, CASE WHEN days >= 7 THEN CASE WHEN q0 < 1 AND s10 > 0 THEN 1 ELSE q0 END END AS base, CASE WHEN popularity < 1 THEN 0.42e0 WHEN popularity < 2 THEN 0.62e0 ELSE 0.70e0 END AS cont FROM ba
), kn AS (
  SELECT item, count(*) AS n, count(*) FILTER (WHERE censored) AS so FROM (SELECT h.*, base, row_number() OVER (PARTITION BY h.item ORDER BY d DESC) AS nk FROM h JOIN bb USING (item, t) WHERE (dow = 3) = (isodow(t) = 3)) WHERE nk <= 8 AND supply >= greatest(1, base) GROUP BY 1
), cl AS (SELECT bb.*, coalesce(n, 0) AS n, coalesce(so, 0) AS so, 1 + coalesce(so, 0) AS a, 1 + coalesce(n, 0) - coalesce(so, 0) AS b FROM bb LEFT JOIN kn USING (item)
), ks AS (SELECT *, be / power(cont, k) AS y FROM cl, (SELECT unnest([1, 2, 3]) AS k)
), tails AS (
  SELECT item, k, CASE WHEN y <= 0 THEN 1e0 WHEN y >= 1 THEN 0e0 ELSE list_sum(list_transform(range(0, a), lambda i: exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i)) * power(y, i) * power(1 - y, a + b - 1 - i))) END AS tail FROM ks
), st AS (
  SELECT cl.*, t1.tail AS t1, CASE WHEN n < 3 OR base IS NULL THEN 0 WHEN t1.tail < 0.75e0 THEN 0 WHEN t2.tail < 0.75e0 THEN 1 ELSE 2 END AS steps
  FROM cl JOIN tails t1 ON t1.item = cl.item AND t1.k = 1 JOIN tails t2 ON t2.item = cl.item AND t2.k = 2
), un AS (SELECT item, t, k, a::DOUBLE / (a + b) * power(cont, k) - be AS edge FROM (SELECT *, unnest(range(1, steps + 1)) AS k FROM st WHERE steps > 0)
), kp AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY edge DESC, item, k) AS place FROM un
), ex AS (SELECT item, max(k) AS extra FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY k) AS rk FROM kp WHERE place <= 8) WHERE k = rk GROUP BY 1)"""


def ladder(spark, d, level: int = 3, by_unit: bool = False) -> DataFrame:
    """Each item's day after the last one."""
    obs = observations(spark, d)
    return L.decided(L.with_next_days(obs), economics(spark), level, by_unit=by_unit)


@twin("dom12_win13_roll_ladder", f"WITH {LADDER} SELECT item, t, k, round(g, 6) AS g, round(s, 6) AS s FROM s")
def _(spark, d):
    one = ladder(spark, d, by_unit=True).select("item", "t", F.posexplode(F.arrays_zip(F.col("steps_g").alias("g"), F.col("chances").alias("s"))).alias("k", "x"))
    return one.select("item", "t", (F.col("k") + 1).alias("k"), F.round("x.g", 6).alias("g"), F.round("x.s", 6).alias("s"))


@twin("dom13_win5_base_quantity", f"WITH {LADDER} SELECT item, t, days, cap AS recent_max, ceiling, round(be, 6) AS be, base, coalesce(base > cap, false) AS testing, round(popularity, 6) AS popularity FROM bb")
def _(spark, d):
    return ladder(spark, d).select("item", "t", "days", F.col("cap").alias("recent_max"), "ceiling", F.round("be", 6).alias("be"), "base", "testing", F.round("popularity", 6).alias("popularity"))


@twin("dom14_mth3_climb", f"WITH {LADDER} SELECT item, t, n, so AS sold_out, steps, round(CASE WHEN n < 3 OR base IS NULL THEN 0e0 ELSE t1 END, 6) AS confidence FROM st")
def _(spark, d):
    return ladder(spark, d).select("item", "t", "n", "sold_out", "steps", F.round("confidence", 6).alias("confidence"))


@twin("dom15_16_srt3_budgeted_quantity", f"WITH {LADDER} SELECT st.item, t, base, base + coalesce(extra, 0) AS quantity FROM st LEFT JOIN ex USING (item)")
def _(spark, d):
    return ladder(spark, d).select("item", "t", "base", "quantity")


@twin("hlp5_ladder_tail", f"WITH {LADDER}, m AS (SELECT item, max(k) AS n, max_by(s, k) AS last FROM s GROUP BY 1) SELECT item, round(last * power(0.5e0, 2), 6) AS halved_two_past, 0e0 AS zero_past_end FROM m")
def _(spark, d):
    s = ladder(spark, d, by_unit=True).select("item", "chances")
    return s.select("item", F.round(F.element_at("chances", -1) * F.pow(F.lit(0.5), F.lit(2.0)), 6).alias("halved_two_past"), F.coalesce(F.get("chances", F.size("chances") + 1), F.lit(0.0)).alias("zero_past_end"))


@twin("dom24_prj15_16_prep_sheet", f"""WITH {LADDER}, pr AS (
  SELECT item, count(*) FILTER (WHERE nth_same <= 8) AS n_weekday, count(*) FILTER (WHERE nth <= 10) AS n_recent, count(*) FILTER (WHERE nth <= 10 AND censored) AS so10, sum(wasted) FILTER (WHERE nth <= 10) AS w10 FROM h GROUP BY 1
), ch AS (SELECT item, list(s ORDER BY k) AS c FROM s GROUP BY 1)
SELECT st.item, t, base + coalesce(extra, 0) AS quantity, CASE WHEN base IS NULL OR n_weekday < 3 THEN 'low' WHEN so10::DOUBLE / n_recent >= 0.6e0 THEN 'low' WHEN n_weekday >= 6 AND so10::DOUBLE / n_recent < 0.4e0 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN base IS NULL THEN 'too little history yet' WHEN steps > 0 THEN 'sold out ' || so || ' of last ' || n || ' - climbing +' || steps
    WHEN base > cap THEN 'sold out ' || so10 || ' of last ' || n_recent || ' - testing one more'
    WHEN n_recent - so10 >= greatest(3, floor(0.7e0 * n_recent)) THEN 'left over ' || w10::BIGINT || ' across last ' || n_recent ELSE 'needs ' || round_even(100 * be, 0)::BIGINT || '%' END AS reason
FROM st LEFT JOIN ex USING (item) JOIN pr USING (item) JOIN ch USING (item)""")
def _(spark, d):
    x = ladder(spark, d)
    rate = F.col("so10") / F.col("n_recent")
    low = F.col("base").isNull() | (F.col("n_weekday") < 3) | (rate >= 0.6)
    confidence = F.when(low, "low").when((F.col("n_weekday") >= 6) & (rate < 0.4), "high").otherwise("medium")
    reason = (
        F.when(F.col("base").isNull(), "too little history yet")
        .when(F.col("steps") > 0, F.format_string("sold out %d of last %d - climbing +%d", "sold_out", "n", "steps"))
        .when(F.col("testing"), F.format_string("sold out %d of last %d - testing one more", "so10", "n_recent"))
        .when(F.col("n_recent") - F.col("so10") >= F.greatest(F.lit(3), F.floor(0.7 * F.col("n_recent"))), F.format_string("left over %d across last %d", "w10", "n_recent"))
        .otherwise(F.concat(F.lit("needs "), S.pct(F.col("be"))))
    )
    return x.select("item", "t", "quantity", confidence.alias("confidence"), reason.alias("reason"))


RAINY = [(share, chance) for share in (0.7, 0.9) for chance in (0.3, 0.6)]
RAINED = f"""WITH {LADDER}, sl AS (SELECT item, list(s ORDER BY k) AS c FROM s GROUP BY 1), fa AS (SELECT item, list_concat(c, list_transform(range(1, 13), lambda i: c[len(c)] * power(0.5e0, i))) AS c FROM sl),
wx AS (SELECT * FROM (VALUES {', '.join(f'({s}e0, {c}e0)' for s, c in RAINY)}) AS v(share, chance)),
bs AS (SELECT st.*, base + coalesce(extra, 0) AS dry, share, chance, CASE WHEN chance >= 0.5e0 THEN greatest(least(base, cap), least(base, 1)) ELSE base END AS top FROM st LEFT JOIN ex USING (item), wx),
ku AS (SELECT item, share, chance, be, unnest(range(1, top::BIGINT + 1)) AS k FROM bs WHERE base IS NOT NULL), du AS (SELECT ku.*, c, unnest(range(k, len(c) + 1)) AS dd FROM ku JOIN fa USING (item)),
mx AS (SELECT item, share, chance, k, any_value(be) AS be, chance * sum((c[dd] - coalesce(c[dd + 1], 0)) * list_sum(list_transform(range(k, dd + 1), lambda j: exp(lgamma(dd + 1) - lgamma(j + 1) - lgamma(dd - j + 1)) * power(share, j) * power(1 - share, dd - j)))) + (1 - chance) * any_value(c[k]) AS mixed FROM du GROUP BY 1, 2, 3, 4),
py AS (SELECT item, share, chance, count(*) FILTER (WHERE mixed >= be) AS paying FROM mx GROUP BY 1, 2, 3)"""


@twin("dom37_rain_in_the_rule", f"{RAINED} SELECT item, t, share, chance, base, CASE WHEN base IS NULL THEN NULL ELSE greatest(coalesce(paying, 0), least(base, 1))::BIGINT END AS rainy_base, CASE WHEN base IS NULL THEN NULL ELSE greatest(coalesce(paying, 0), least(base, 1))::BIGINT + CASE WHEN chance >= 0.5e0 THEN 0 ELSE dry - base END END AS quantity FROM bs LEFT JOIN py USING (item, share, chance)")
def _(spark, d):
    weather = F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(c).alias("chance")) for s, c in RAINY]))
    x = ladder(spark, d, by_unit=True).withColumn("w", weather).select("*", "w.*")
    return L.rained(x, F.col("share"), F.col("chance")).select("item", "t", "share", "chance", "base", "rainy_base", "quantity")
