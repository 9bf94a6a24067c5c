"""Queries: evidence, scorecard, prediction, health, money, plan, ambition and weather."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crumbline.functions import scalars as S
from crumbline.operators import ambition as A
from crumbline.operators import evidence as E
from crumbline.operators import health as H
from crumbline.operators import ladder as L
from crumbline.operators import policies as P
from crumbline.operators import weather as W
from crumbline.operators.economics import Costs, with_economics
from crumbline.operators.observations import by_item, by_weekday, isodow
from crumbline.shared import written
from crumbline.sources.adapter import OBS, economics, observations, table

from .planning import ALL_LADDERS, BACK, EOBS, LADDER, QUANT, eobs, ladder
from .registry import twin

# ---------------------------------------------------------------- evidence --

RULES = ["roll_chance", "same_weekday_quantile"]
#: Both rules on every day after the warm-up, and what each would have sold; cn has how often one more unit sold after the usual amount did.
OUT = f"""{EOBS}, {QUANT}, {ALL_LADDERS}, ends AS (SELECT min(d) AS lo FROM obs),
cn AS (SELECT coalesce(count(*) FILTER (WHERE sold >= usual + 1) / count(*), 0) AS cont FROM (SELECT *, max(supply) OVER p3 AS usual, count(*) OVER p3 AS seen FROM obs WINDOW p3 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE seen = 3 AND supply > usual AND sold >= usual),
rl AS (SELECT 'roll_chance' AS rule, x.*, rc.q AS q0 FROM x LEFT JOIN rc ON rc.item = x.item AND rc.d = x.d AND rc.level = 3
  UNION ALL SELECT 'same_weekday_quantile', d, item, made, refill, wasted, supply, sold, censored, dow, price, cost, p, c, cu, co, cr, CASE WHEN len(v) >= 4 THEN CASE WHEN q0 < 1 AND ms > 0 THEN 1e0 ELSE q0::DOUBLE END END FROM qq),
ju AS (SELECT *, coalesce(q0, supply::DOUBLE) AS q, q0 IS NULL AS no_opinion FROM rl, ends, cn WHERE d >= lo + 28),
oc AS (SELECT *, CASE WHEN NOT censored THEN least(q, sold) WHEN q <= supply THEN q ELSE supply END AS low, CASE WHEN NOT censored THEN least(q, sold) ELSE q END AS high,
  CASE WHEN NOT censored THEN least(q, sold) WHEN q <= supply THEN q WHEN cont < 1 THEN supply + cont * (1 - power(cont, round(q - supply))) / (1 - cont) ELSE q END AS est, CASE WHEN censored AND q > supply THEN round(q - supply) ELSE 0 END AS unseen FROM ju)"""
TALLY = "round(sum(p * est - c * q), 4) AS profit_est, round(sum(p * low - c * q), 4) AS profit_low, round(sum(p * high - c * q), 4) AS profit_high, round(sum(q), 4) AS made, round(sum(q - est), 4) AS left_est, round(sum(unseen), 4) AS unseen, count(*) FILTER (WHERE no_opinion) AS no_opinion, count(DISTINCT d) AS days"


def judged(spark, d):
    """Both rules on every day after the warm-up, with what each would have sold and earned."""
    past = P.earlier(by_weekday(), 3)
    o = written(observations(spark, d), "observations")
    usual = o.withColumns({"usual": F.max("supply").over(past), "seen": F.count("*").over(past)})
    rate = E.extra_unit_rate(usual, "usual", "seen", []).select(F.col("rate").alias("c"))
    obs = with_economics(o, economics(spark))
    return E.compared(P.evaluated(P.decisions(obs, RULES), obs), RULES, rate)


@twin("prj10_evidence_outcome", f"WITH {OUT} SELECT rule, d, item, q, low::DOUBLE AS low, high::DOUBLE AS high, round(est, 6) AS est, unseen::DOUBLE AS unseen FROM oc")
def _(spark, d):
    return judged(spark, d).select("rule", "d", "item", "q", "o.low", "o.high", F.round("o.est", 6).alias("est"), "o.unseen")


@twin("agg11_dom20_evidence_tally", f"WITH {OUT} SELECT rule, item, {TALLY} FROM oc GROUP BY 1, 2")
def _(spark, d):
    return E.tally(judged(spark, d), ["rule", "item"])


@twin("dom20_compare_rules", f"WITH {OUT} SELECT rule, {TALLY} FROM oc GROUP BY 1")
def _(spark, d):
    return E.tally(judged(spark, d), ["rule"])


CAL = """un AS (SELECT item, d, sold, days, unnest(range(1, supply::BIGINT + 1)) AS k FROM rr WHERE days >= 7 AND supply > 0),
pr AS (SELECT un.item, un.d, un.k, coalesce(s, 0e0) AS pred, (sold >= un.k)::INT AS y FROM un LEFT JOIN ss ON ss.item = un.item AND ss.d = un.d AND ss.k = un.k),
zn AS (SELECT count(*) AS n, count(*) FILTER (WHERE pred >= 0.1e0 AND pred < 0.4e0) AS zone_n, round(avg(pred) FILTER (WHERE pred >= 0.1e0 AND pred < 0.4e0), 6) AS zone_predicted, round(avg(y) FILTER (WHERE pred >= 0.1e0 AND pred < 0.4e0), 6) AS zone_sold,
  round(-avg(y * ln(least(greatest(pred, 1e-4), 1 - 1e-4)) + (1 - y) * ln(1 - least(greatest(pred, 1e-4), 1 - 1e-4))), 6) AS log_loss FROM pr)"""


def unit_chances(spark, d):
    """Every unit made, with the chance that the ladder of its morning gave it, and whether it sold."""
    made = L.ladders(L.with_own_days(eobs(spark, d)))
    return E.predicted_units(made.select("own.d", "item", "days", "own.supply", "own.sold", "chances"))


@twin("dom21_retrain_verdict", f"""WITH {OUT}, {CAL}, sp AS (SELECT sum(p * est - c * q) FILTER (WHERE rule = 'roll_chance') AS rule_profit, sum(p * est - c * q) FILTER (WHERE rule = 'same_weekday_quantile') AS old_profit FROM oc)
SELECT round(rule_profit, 4) AS rule_profit, round(old_profit, 4) AS old_profit, zone_n, zone_predicted, zone_sold,
  CASE WHEN rule_profit < old_profit THEN 'refused: earns less' WHEN zone_n > 0 AND zone_predicted - zone_sold > 0.1e0 THEN 'refused: over-confident' ELSE 'accepted' END AS verdict FROM sp, zn""")
def _(spark, d):
    return E.retrain_verdict(judged(spark, d), unit_chances(spark, d), *RULES)


@twin("agg13_calibration_zone", f"WITH {EOBS}, {ALL_LADDERS}, {CAL} SELECT * FROM zn")
def _(spark, d):
    return E.calibration(unit_chances(spark, d))


@twin("agg14_calibration_bins", f"WITH {EOBS}, {ALL_LADDERS}, {CAL} SELECT least(9, floor(round(pred * 10, 9)))::INT AS bin, round(avg(pred), 6) AS predicted, round(avg(y), 6) AS sold, count(*) AS n FROM pr GROUP BY 1")
def _(spark, d):
    return E.calibration_bins(unit_chances(spark, d))


# --------------------------------------------------------------- scorecard --

CARD = f"""{BACK}, ends2 AS (SELECT max(d) AS as_of FROM obs), st AS (SELECT d, item, max(q) FILTER (WHERE policy = 'same_weekday_quantile') AS model, max(q) FILTER (WHERE policy = 'same_weekday_mean') AS baseline FROM sc WHERE factor = 1e0 GROUP BY 1, 2),
iss AS (SELECT d, item, model, baseline, model IS NULL AS is_fallback FROM st WHERE (day(d) + length(item)) % 5 <> 0),
js AS (SELECT iss.*, x.supply, x.sold, x.cu, x.co FROM iss LEFT JOIN x ON x.d = iss.d AND x.item = iss.item AND day(x.d) % 7 <> 0, ends2 WHERE iss.d BETWEEN as_of - 29 AND as_of)"""


@twin("dom25_agg10_scorecard", f"""WITH {CARD}, u AS (SELECT d, item, supply, sold, cu, co, unnest(['model', 'operator', 'baseline']) AS label, unnest([model, supply::DOUBLE, baseline]) AS q FROM js WHERE supply IS NOT NULL)
SELECT label, count(*) AS scored, round(sum(CASE WHEN q >= sold THEN co * (q - sold) ELSE 0e0 END), 4) AS waste_cost, round(sum(CASE WHEN q >= sold THEN 0e0 ELSE cu * (sold - q) END), 4) AS stockout_cost, count(DISTINCT item) AS items FROM u WHERE q IS NOT NULL GROUP BY 1""")
def _(spark, d):
    s = issued(spark, d).where("supply is not null")
    u = s.selectExpr("item", "sold", "cu", "co", "stack(3, 'model', model, 'operator', cast(supply as double), 'baseline', baseline) as (label, q)").where("q is not null")
    over = F.col("q") >= F.col("sold")
    return u.groupBy("label").agg(
        F.count("*").alias("scored"), F.round(F.sum(F.when(over, F.col("co") * (F.col("q") - F.col("sold"))).otherwise(0.0)), 4).alias("waste_cost"),
        F.round(F.sum(F.when(over, 0.0).otherwise(F.col("cu") * (F.col("sold") - F.col("q")))), 4).alias("stockout_cost"), F.countDistinct("item").alias("items"),
    )


def issued(spark, d):
    """Decisions as they were issued in the last 30 days, with what happened; quantities are never computed anew from outcomes."""
    obs = eobs(spark, d)
    q = obs.withColumns({"model": P.weekday_quantile(), "baseline": P.weekday_mean()}).where((F.dayofmonth("d") + F.length("item")) % 5 != 0).select("d", "item", "model", "baseline", F.col("model").isNull().alias("is_fallback"))
    as_of = obs.agg(F.max("d").alias("as_of"))
    stored = q.join(F.broadcast(as_of), F.col("d").between(F.date_sub("as_of", 29), F.col("as_of")))
    seen = obs.where("day(d) % 7 <> 0").select("d", "item", "supply", "sold", "cu", "co")
    return stored.join(seen, ["d", "item"], "left")


@twin("dom25_j7_scorecard_coverage", f"WITH {CARD} SELECT count(*) AS issued, count(supply) AS scored, round(count(supply) / count(*), 6) AS coverage, round(avg(is_fallback::INT), 6) AS fallback_share, round(avg((abs(supply - model) < 0.5)::INT) FILTER (WHERE supply IS NOT NULL AND model IS NOT NULL), 6) AS adherence, count(DISTINCT d) AS days FROM js")
def _(spark, d):
    s = issued(spark, d)
    kept = F.col("supply").isNotNull() & F.col("model").isNotNull()
    return s.agg(
        F.count("*").alias("issued"), F.count("supply").alias("scored"), F.round(F.count("supply") / F.count("*"), 6).alias("coverage"), F.round(F.avg(F.col("is_fallback").cast("int")), 6).alias("fallback_share"),
        F.round(F.avg(F.when(kept, (F.abs(F.col("supply") - F.col("model")) < 0.5).cast("int"))), 6).alias("adherence"), F.countDistinct("d").alias("days"),
    )


# -------------------------------------------------------------- prediction --

PRED = f"""{EOBS}, tg AS (SELECT max(d) + 1 AS t FROM obs), pl AS (SELECT item, 3 + length(item) % 4 AS plan FROM econ), bd AS (SELECT DISTINCT d FROM obs, tg WHERE d < t AND dow = isodow(t) ORDER BY d DESC LIMIT 8),
dy AS (SELECT bd.d, sum(least(plan, coalesce(sold, 0)))::DOUBLE AS sold, sum(least(plan, coalesce(sold, 0)) * CASE WHEN isodow(t) = 3 THEN price * (2e0 / 3e0) ELSE price END) AS revenue, count(*) FILTER (WHERE o.sold >= plan)::DOUBLE AS sellouts FROM bd CROSS JOIN pl CROSS JOIN tg JOIN econ USING (item) LEFT JOIN obs o ON o.d = bd.d AND o.item = pl.item GROUP BY 1),
st AS (SELECT count(*) AS n, avg(sold) AS m, coalesce(stddev_samp(sold), 0) AS s, avg(revenue) AS mr, coalesce(stddev_samp(revenue), 0) AS sr, avg(sellouts) AS ms, (SELECT sum(plan) FROM pl) AS total FROM dy)"""


@twin("dom22_win10_mth5_predict_day", f"""WITH {PRED} SELECT n, round(m, 6) AS sold, round(greatest(0, m - [1.197e0, 1.142e0, 1.111e0, 1.091e0, 1.077e0][(least(greatest(n - 1, 3), 7) - 2)::INT] * s * sqrt(1 + 1e0 / n)), 6) AS sold_lo68, round(least(total, m + [1.197e0, 1.142e0, 1.111e0, 1.091e0, 1.077e0][(least(greatest(n - 1, 3), 7) - 2)::INT] * s * sqrt(1 + 1e0 / n)), 6) AS sold_hi68,
round(greatest(0, mr - [3.182e0, 2.776e0, 2.571e0, 2.447e0, 2.365e0][(least(greatest(n - 1, 3), 7) - 2)::INT] * sr * sqrt(1 + 1e0 / n)), 6) AS revenue_lo95, round(mr, 6) AS revenue, round(ms, 6) AS sellouts, round(100 * (total - m) / total, 6) AS waste_pct FROM st WHERE n >= 4""")
def _(spark, d):
    days = predicted_days(spark, d)
    plan_total = economics(spark).select(F.sum(3 + F.length("item") % 4).alias("total"))
    st = days.agg(F.count("*").alias("n"), F.avg("sold").alias("m"), F.coalesce(F.stddev_samp("sold"), F.lit(0.0)).alias("s"), F.avg("revenue").alias("mr"), F.coalesce(F.stddev_samp("revenue"), F.lit(0.0)).alias("sr"), F.avg("sellouts").alias("ms")).join(F.broadcast(plan_total), F.lit(True))
    half = lambda t, s: t(F.col("n")) * F.col(s) * F.sqrt(1 + 1.0 / F.col("n"))
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return st.where("n >= 4").select(
        "n", r6("m", "sold"), r6(F.greatest(F.lit(0.0), F.col("m") - half(S.t68, "s")), "sold_lo68"), r6(F.least(F.col("total").cast("double"), F.col("m") + half(S.t68, "s")), "sold_hi68"),
        r6(F.greatest(F.lit(0.0), F.col("mr") - half(S.t95, "sr")), "revenue_lo95"), r6("mr", "revenue"), r6("ms", "sellouts"), r6(100 * (F.col("total") - F.col("m")) / F.col("total"), "waste_pct"),
    )


def predicted_days(spark, d):
    """What a plan would have sold on the last days of the target's weekday: one row per day."""
    obs = observations(spark, d)
    t = obs.agg(F.date_add(F.max("d"), 1).alias("t"))
    basis = obs.select("d", "dow").distinct().join(F.broadcast(t), F.col("d") < F.col("t")).where(F.col("dow") == isodow("t")).orderBy(F.col("d").desc()).limit(8).select("d", "t")
    plan = economics(spark).select("item", "price", (3 + F.length("item") % 4).alias("plan"))
    grid = basis.join(F.broadcast(plan), F.lit(True)).join(obs.select("d", "item", "sold"), ["d", "item"], "left")
    sold = F.least("plan", F.coalesce("sold", F.lit(0)))
    price = F.when(isodow("t") == 3, F.col("price") * (2.0 / 3.0)).otherwise(F.col("price"))
    return grid.groupBy("d").agg(F.sum(sold).cast("double").alias("sold"), F.sum(sold * price).alias("revenue"), F.count_if(F.col("sold") >= F.col("plan")).cast("double").alias("sellouts"))


@twin("dom23_score_day", f"WITH {PRED} SELECT dy.d, round((dy.sold - m) / nullif(s, 0), 6) AS z, abs(dy.sold - m) <= [1.197e0, 1.142e0, 1.111e0, 1.091e0, 1.077e0][(least(greatest(n - 1, 3), 7) - 2)::INT] * s * sqrt(1 + 1e0 / n) AS in68, abs(dy.sold - m) <= [3.182e0, 2.776e0, 2.571e0, 2.447e0, 2.365e0][(least(greatest(n - 1, 3), 7) - 2)::INT] * s * sqrt(1 + 1e0 / n) AS in95 FROM dy, st")
def _(spark, d):
    days = predicted_days(spark, d)
    st = days.agg(F.count("*").alias("n"), F.avg("sold").alias("m"), F.stddev_samp("sold").alias("s"))
    both = days.join(F.broadcast(st), F.lit(True))
    off, wide = F.abs(F.col("sold") - F.col("m")), F.col("s") * F.sqrt(1 + 1.0 / F.col("n"))
    return both.select("d", F.round((F.col("sold") - F.col("m")) / F.nullif("s", F.lit(0.0)), 6).alias("z"), (off <= S.t68(F.col("n")) * wide).alias("in68"), (off <= S.t95(F.col("n")) * wide).alias("in95"))


# ------------------------------------------------------------------ health --


@twin("dom26_srt5_health_findings", """WITH i AS (SELECT user_id % 30 AS shop, TIMESTAMP '2024-01-31 12:00:00' AS now_, max(ts) FILTER (WHERE event_type = 'view' AND user_id % 30 <> 4) AS ingest_ok, max(ts) FILTER (WHERE event_type = 'error' AND user_id % 7 = 0) AS ingest_error,
  max(ts) FILTER (WHERE event_type = 'purchase') - INTERVAL 1 DAY * (user_id % 30) AS retrain_ok, max(ts) FILTER (WHERE event_type = 'signup' AND user_id % 5 = 0) AS retrain_error, max(ts) FILTER (WHERE event_type = 'click')::DATE - (user_id % 30 % 3)::INT AS latest_day, DATE '2024-01-30' AS expected_day,
  avg(value) / 4 - 3 AS score_pct, user_id % 30 <> 9 AS has_model FROM events GROUP BY user_id % 30),
l AS (SELECT *, date_diff('second', ingest_ok, now_) / 3600e0 AS age, date_diff('second', retrain_ok, now_) / 86400e0 AS old, date_diff('day', latest_day, expected_day) AS gap FROM i),
f AS (SELECT shop, 3 AS lv, 'ingest-never' AS code FROM l WHERE ingest_ok IS NULL UNION ALL SELECT shop, 3, 'ingest-failed' FROM l WHERE age >= 54 UNION ALL SELECT shop, 1, 'ingest-stale' FROM l WHERE age >= 30 AND age < 54
  UNION ALL SELECT shop, 2, 'ingest-error' FROM l WHERE ingest_error IS NOT NULL AND (ingest_ok IS NULL OR ingest_error > ingest_ok) UNION ALL SELECT shop, CASE WHEN gap >= 2 THEN 2 ELSE 1 END, 'data-gap' FROM l WHERE gap >= 1 UNION ALL SELECT shop, 2, 'no-model' FROM l WHERE NOT has_model
  UNION ALL SELECT shop, 2, 'retrain-error' FROM l WHERE retrain_error IS NOT NULL AND (retrain_ok IS NULL OR retrain_error > retrain_ok) UNION ALL SELECT shop, 1, 'retrain-stale' FROM l WHERE NOT coalesce(retrain_error > retrain_ok, retrain_error IS NOT NULL) AND old >= 10 UNION ALL SELECT shop, 2, 'score-worse' FROM l WHERE score_pct > 10)
SELECT l.shop, coalesce(max(lv), 0)::INT AS worst, coalesce(array_to_string(list(code ORDER BY lv DESC, code) FILTER (WHERE code IS NOT NULL), ','), '') AS codes FROM l LEFT JOIN f USING (shop) GROUP BY 1""")
def _(spark, d):
    e, k = table(spark, d, "events").withColumn("shop", F.col("user_id") % 30), F.col("event_type")
    newest = lambda when: F.max(F.when(when, F.col("ts")))
    i = e.groupBy("shop").agg(
        newest((k == "view") & (F.col("shop") != 4)).alias("ingest_ok"), newest((k == "error") & (F.col("user_id") % 7 == 0)).alias("ingest_error"), newest(k == "purchase").alias("p"),
        newest((k == "signup") & (F.col("user_id") % 5 == 0)).alias("retrain_error"), F.to_date(newest(k == "click")).alias("c"), (F.avg("value") / 4 - 3).alias("score_pct"),
    )
    i = i.withColumns({"at": F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), "retrain_ok": F.col("p") - F.make_dt_interval(F.col("shop").cast("int")), "latest_day": F.date_sub("c", (F.col("shop") % 3).cast("int")), "expected_day": F.lit("2024-01-30").cast("date"), "has_model": F.col("shop") != 9})
    return H.assessed(i).select("shop", "worst", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes"))


@twin("dom27_str8_alert_cooldown", """WITH RECURSIVE e AS (SELECT event_type AS code, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT code, ts, n, ts AS last, true AS sent FROM e WHERE n = 1 UNION ALL SELECT e.code, e.ts, e.n, CASE WHEN e.ts - r.last >= INTERVAL 12 HOUR THEN e.ts ELSE r.last END, e.ts - r.last >= INTERVAL 12 HOUR FROM r JOIN e ON e.code = r.code AND e.n = r.n + 1)
SELECT code, count(*) AS findings, count(*) FILTER (WHERE sent) AS sent, max(last) AS last_sent FROM r GROUP BY 1""")
def _(spark, d):
    """A code's findings in order of time: one is sent if 12 hours have passed since the last that was. A fold over each code's times."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("code")).agg(F.array_sort(F.collect_list(F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id"))).alias("x"))
    first = F.lit("1970-01-01").cast("timestamp")
    zero = F.struct(first.alias("last"), F.lit(0).alias("sent"))

    def step(acc, x):
        due = F.unix_micros(x["ts"]) - F.unix_micros(acc["last"]) >= 12 * 3_600_000_000
        return F.struct(F.when(due, x["ts"]).otherwise(acc["last"]).alias("last"), (acc["sent"] + due.cast("int")).alias("sent"))

    r = F.aggregate("x", zero, step)
    return e.select("code", F.size("x").cast("long").alias("findings"), r["sent"].cast("long").alias("sent"), r["last"].cast("timestamp_ntz").alias("last_sent"))


# ------------------------------------------------------------------- money --


@twin("prj11_dom51_item_money", f"WITH {EOBS} SELECT d, item, round(p * sold, 4) AS sales, round(p * sold * 0.25e0, 4) AS fee, round(c * supply, 4) AS cost, round(c * least(wasted, supply), 4) AS waste_cost, round(p * sold * 0.75e0 - c * supply, 4) AS profit, round(100 * c * supply / nullif(p * sold, 0), 4) AS cost_share FROM x")
def _(spark, d):
    o = eobs(spark, d)
    sales, cost = F.col("eff_price") * F.col("sold"), F.col("eff_cost") * F.col("supply")
    r4 = lambda c, n: F.round(c, 4).alias(n)
    return o.select("d", "item", r4(sales, "sales"), r4(sales * 0.25, "fee"), r4(cost, "cost"), r4(F.col("eff_cost") * F.least("wasted", "supply"), "waste_cost"), r4(sales * 0.75 - cost, "profit"), r4(100 * cost / F.nullif(sales, F.lit(0.0)), "cost_share"))


DAYS = f"""{EOBS}, dst AS (SELECT d, sum(made) AS made, sum(supply) AS supply, sum(sold) AS sold, sum(greatest(0, supply - sold)) AS left_over, count(*) FILTER (WHERE censored AND supply > 0) AS sellouts, round(sum(p * sold), 6) AS sales, round(sum(p * sold * 0.8e0 - c * supply), 6) AS profit, dow FROM x GROUP BY d, dow)"""


def day_stats(spark, d):
    o = eobs(spark, d)
    return o.groupBy("d", "dow").agg(
        F.sum("made").alias("made"), F.sum("supply").alias("supply"), F.sum("sold").alias("sold"), F.sum(F.greatest(F.lit(0), F.col("supply") - F.col("sold"))).alias("left_over"),
        F.count_if(F.col("censored") & (F.col("supply") > 0)).alias("sellouts"), F.round(F.sum(F.col("eff_price") * F.col("sold")), 6).alias("sales"),
        F.round(F.sum(F.col("eff_price") * F.col("sold") * 0.8 - F.col("eff_cost") * F.col("supply")), 6).alias("profit"),
    )


@twin("dom30_agg15_day_stats", f"""WITH {DAYS}, sp AS (SELECT unnest(range((SELECT min(d) FROM dst)::TIMESTAMP, (SELECT max(d) FROM dst) + INTERVAL 3 DAY, INTERVAL 1 DAY))::DATE AS day)
SELECT day, CASE WHEN day > (SELECT max(d) FROM dst) THEN 'future' WHEN day(day) = 13 THEN 'outage' WHEN d IS NULL THEN 'empty' WHEN day(day) % 9 = 0 THEN 'open' ELSE 'closed' END AS phase, made, CASE WHEN day(day) % 9 <> 0 AND day(day) <> 13 THEN sold END AS sold, CASE WHEN day(day) % 9 <> 0 AND day(day) <> 13 THEN left_over END AS left_over FROM sp LEFT JOIN dst ON d = day""")
def _(spark, d):
    s = day_stats(spark, d)
    ends = s.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spine = ends.select("hi", F.explode(F.sequence(F.col("lo"), F.date_add("hi", 2))).alias("day")).join(s, F.col("day") == F.col("d"), "left")
    n = F.dayofmonth("day")
    phase = F.when(F.col("day") > F.col("hi"), "future").when(n == 13, "outage").when(F.col("d").isNull(), "empty").when(n % 9 == 0, "open").otherwise("closed")
    known = (n % 9 != 0) & (n != 13)
    return spine.select("day", phase.alias("phase"), "made", F.when(known, F.col("sold")).alias("sold"), F.when(known, F.col("left_over")).alias("left_over"))


@twin("agg16_item_insights", f"WITH {EOBS} SELECT item, sum(made) AS made, sum(wasted) AS wasted, sum(sold) AS sold, count(*) AS days, count(*) FILTER (WHERE censored) AS sellouts, round(sum(p * sold), 4) AS sales, round(sum(p * sold * 0.8e0 - c * supply), 4) AS profit, round(sum(wasted) / nullif(sum(supply), 0), 6) AS waste_rate, round(count(*) FILTER (WHERE censored) / count(*), 6) AS sellout_rate FROM x WHERE d > (SELECT max(d) - 90 FROM obs) GROUP BY 1")
def _(spark, d):
    o = eobs(spark, d)
    o = o.join(F.broadcast(o.agg(F.max("d").alias("hi"))), F.col("d") > F.date_sub("hi", 90))
    return o.groupBy("item").agg(
        F.sum("made").alias("made"), F.sum("wasted").alias("wasted"), F.sum("sold").alias("sold"), F.count("*").alias("days"), F.count_if("censored").alias("sellouts"),
        F.round(F.sum(F.col("eff_price") * F.col("sold")), 4).alias("sales"), F.round(F.sum(F.col("eff_price") * F.col("sold") * 0.8 - F.col("eff_cost") * F.col("supply")), 4).alias("profit"),
        F.round(F.sum("wasted") / F.nullif(F.sum("supply"), F.lit(0)), 6).alias("waste_rate"), F.round(F.count_if("censored") / F.count("*"), 6).alias("sellout_rate"),
    )


@twin("agg17_range_totals", f"WITH {DAYS} SELECT sum(sold) AS sold, max(d) AS latest, date_diff('day', max(d), DATE '2001-12-01') AS stale_by, round(avg(sales), 6) AS daily_sales, round(avg(profit), 6) AS daily_profit FROM dst")
def _(spark, d):
    return day_stats(spark, d).agg(F.sum("sold").alias("sold"), F.max("d").alias("latest"), F.datediff(F.lit("2001-12-01").cast("date"), F.max("d")).cast("long").alias("stale_by"), F.round(F.avg("sales"), 6).alias("daily_sales"), F.round(F.avg("profit"), 6).alias("daily_profit"))


@twin("agg18_mean_sold_per_weekday", f"WITH {OBS} SELECT dow, round(sum(sold) / count(DISTINCT d), 6) AS mean_sold FROM obs GROUP BY 1")
def _(spark, d):
    # Days first, so distinct days need no second shuffle of item rows.
    days = observations(spark, d).groupBy("d", "dow").agg(F.sum("sold").alias("sold"))
    return days.groupBy("dow").agg(F.round(F.sum("sold") / F.count("*"), 6).alias("mean_sold"))


@twin("agg27_window_stats", f"WITH {DAYS} SELECT year(d) AS y, count(*) AS days, round(avg(profit), 6) AS mean_profit, round(coalesce(stddev_samp(profit), 0), 6) AS sd_profit, round(sum(left_over) / sum(supply), 6) AS waste_share, round(sum(sellouts) / (6 * count(*)), 6) AS sellout_share FROM dst GROUP BY 1")
def _(spark, d):
    return day_stats(spark, d).groupBy(F.year("d").cast("long").alias("y")).agg(
        F.count("*").alias("days"), F.round(F.avg("profit"), 6).alias("mean_profit"), F.round(F.coalesce(F.stddev_samp("profit"), F.lit(0.0)), 6).alias("sd_profit"),
        F.round(F.sum("left_over") / F.sum("supply"), 6).alias("waste_share"), F.round(F.sum("sellouts") / (6 * F.count("*")), 6).alias("sellout_share"),
    )


@twin("dom31_win11_period_projection", f"""WITH {DAYS}, m AS (SELECT max(d) AS today FROM dst), sp AS (SELECT unnest(range((SELECT today - 10 FROM m)::TIMESTAMP, (SELECT today FROM m) + INTERVAL 15 DAY, INTERVAL 1 DAY))::DATE AS day),
bs AS (SELECT dow, profit, row_number() OVER (PARTITION BY dow ORDER BY d DESC) AS n FROM dst, m WHERE d < today), e AS (SELECT dow, avg(profit) AS est, coalesce(var_samp(profit), 0) AS v FROM bs WHERE n <= 6 GROUP BY 1)
SELECT count(d) AS actual_days, round(sum(profit), 4) AS actual, count(*) FILTER (WHERE d IS NULL) AS estimated_days, round(sum(est) FILTER (WHERE d IS NULL), 4) AS estimated, round(sqrt(sum(v) FILTER (WHERE d IS NULL)), 4) AS spread FROM sp LEFT JOIN dst ON d = day JOIN e ON e.dow = isodow(day)""")
def _(spark, d):
    s = day_stats(spark, d)
    m = F.broadcast(s.agg(F.max("d").alias("today")))
    spine = m.select(F.explode(F.sequence(F.date_sub("today", 10), F.date_add("today", 14))).alias("day"))
    past = s.join(m, F.col("d") < F.col("today")).withColumn("n", F.row_number().over(Window.partitionBy("dow").orderBy(F.col("d").desc()))).where("n <= 6")
    est = past.groupBy(F.col("dow").alias("edow")).agg(F.avg("profit").alias("est"), F.coalesce(F.var_samp("profit"), F.lit(0.0)).alias("v"))
    x = spine.join(s, F.col("day") == F.col("d"), "left").join(F.broadcast(est), F.col("edow") == isodow("day"))
    no = F.col("d").isNull()
    return x.agg(F.count("d").alias("actual_days"), F.round(F.sum("profit"), 4).alias("actual"), F.count_if(no).alias("estimated_days"), F.round(F.sum(F.when(no, F.col("est"))), 4).alias("estimated"), F.round(F.sqrt(F.sum(F.when(no, F.col("v")))), 4).alias("spread"))


@twin("win12_dom39_today_outlook", f"WITH {DAYS}, m AS (SELECT max(d) + 1 AS today FROM dst), bs AS (SELECT sold, row_number() OVER (ORDER BY d DESC) AS n FROM dst, m WHERE dow = isodow(today)) SELECT count(*) AS days, round(avg(sold), 6) AS mean_sold, floor(avg(sold) * 0.9e0 + 0.5e0)::BIGINT AS projected FROM bs WHERE n <= 8 HAVING count(*) >= 3")
def _(spark, d):
    s = day_stats(spark, d)
    m = F.broadcast(s.agg(F.date_add(F.max("d"), 1).alias("today")))
    last = s.join(m, F.col("dow") == isodow("today")).orderBy(F.col("d").desc()).limit(8)
    return last.agg(F.count("*").alias("days"), F.round(F.avg("sold"), 6).alias("mean_sold"), S.round_half_up(F.avg("sold") * 0.9).alias("projected")).where("days >= 3")


@twin("dom40_52_plan_ahead_pivot", f"""WITH {EOBS}, m AS (SELECT max(d) AS hi FROM obs), dd AS (SELECT hi + k::INT AS day, k FROM m, (SELECT unnest(range(1, 8)) AS k)), r AS (SELECT item, dow, sold, row_number() OVER (PARTITION BY item, dow ORDER BY d DESC) AS n FROM obs),
q AS (SELECT item, dow, floor(avg(sold) + 0.5e0)::BIGINT AS qty FROM r WHERE n <= 4 GROUP BY 1, 2)
SELECT item, sum(qty) FILTER (WHERE k = 1) AS d1, sum(qty) FILTER (WHERE k = 2) AS d2, sum(qty) FILTER (WHERE k = 3) AS d3, sum(qty) FILTER (WHERE k = 4) AS d4, sum(qty) FILTER (WHERE k = 5) AS d5, sum(qty) FILTER (WHERE k = 6) AS d6, sum(qty) FILTER (WHERE k = 7) AS d7, sum(qty) AS week FROM dd JOIN q ON dow = isodow(day) GROUP BY 1""")
def _(spark, d):
    o = observations(spark, d)
    days = o.agg(F.max("d").alias("hi")).select(F.posexplode(F.sequence(F.date_add("hi", 1), F.date_add("hi", 7))).alias("k", "day"))
    last = o.withColumn("n", F.row_number().over(Window.partitionBy("item", "dow").orderBy(F.col("d").desc()))).where("n <= 4")
    q = last.groupBy("item", "dow").agg(S.round_half_up(F.avg("sold")).alias("qty"))
    x = q.join(F.broadcast(days), F.col("dow") == isodow("day")).withColumn("k", F.concat(F.lit("d"), F.col("k") + 1))
    names = [f"d{i}" for i in range(1, 8)]
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in names[1:]), F.coalesce(F.col("d1"), F.lit(0)))
    return x.groupBy("item").pivot("k", names).agg(F.sum("qty")).withColumn("week", total)


PLAN = " UNION ALL ".join(f"SELECT * FROM (WITH {LADDER.replace('max(d) + 1 AS t', f'max(d) + {k} AS t')}, nb AS (SELECT item, floor(avg(sold) + 0.5e0)::BIGINT AS naive FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d DESC) AS nn FROM h WHERE same) WHERE nn <= 4 GROUP BY 1) SELECT st.item, t, {k} AS k, coalesce(base + coalesce(extra, 0), naive, 0)::BIGINT AS quantity, (base IS NULL) AS usual, cost FROM st LEFT JOIN ex USING (item) LEFT JOIN nb USING (item))" for k in range(1, 15))


def plan_ahead(spark, d):
    """What to make on each of the next 14 days, as seen today: the rule, else the usual amount."""
    obs = observations(spark, d)
    q = L.decided(L.with_next_days(obs, 14), economics(spark), by_unit=False)
    return q.select("item", "t", (F.datediff("t", "c") + 1).alias("k"), F.coalesce("quantity", "naive", F.lit(0)).cast("long").alias("quantity"), F.col("base").isNull().alias("usual"), "cost")


@twin("dom40_plan_ahead_14_days", f"SELECT item, t, quantity, usual, round(quantity * cost, 4) AS ingredients FROM ({PLAN}) WHERE quantity > 0")
def _(spark, d):
    return plan_ahead(spark, d).where("quantity > 0").select("item", "t", "quantity", "usual", F.round(F.col("quantity") * F.col("cost"), 4).alias("ingredients"))


@twin("dom52_coming_up_pivot", f"SELECT item, {', '.join(f'sum(quantity) FILTER (WHERE k = {k})::BIGINT AS d{k}' for k in range(1, 8))} FROM ({PLAN}) GROUP BY 1")
def _(spark, d):
    names = [f"d{k}" for k in range(1, 8)]
    return plan_ahead(spark, d).withColumn("name", F.concat(F.lit("d"), F.col("k"))).groupBy("item").pivot("name", names).agg(F.sum("quantity"))


@twin("dom41_ladder_drift")
def _(spark, d):
    """How often the rule's plan a day and a week ahead is that of the morning, over the last 28 days on record. Tests hold it against loops."""
    obs = written(eobs(spark, d), "observations")
    # Rows on record all count; only the targets of the last 28 days are asked.
    last = F.broadcast(obs.agg(F.date_sub(F.max("d"), 28).alias("after")))
    rows = L.with_own_days(obs, (0, 1, 7)).join(last, (F.col("real") == 1) | (F.col("t") > F.col("after"))).drop("after")
    q = L.decided(rows, by_unit=False).withColumn("lead", F.datediff("t", "c"))
    by_day = q.groupBy("item", "t").pivot("lead", [0, 1, 7]).agg(F.max("quantity"))
    x = by_day.withColumn("l", F.explode(F.array(F.struct(F.lit(1).alias("lead"), F.col("1").alias("early")), F.struct(F.lit(7).alias("lead"), F.col("7").alias("early")))))
    gap = F.abs(F.col("0") - F.col("l.early"))
    g = x.where(gap.isNotNull()).groupBy("l.lead").agg(F.count("*").alias("item_days"), F.round(F.avg((gap == 0).cast("int")), 6).alias("exact"), F.round(F.avg((gap <= 1).cast("int")), 6).alias("within_one"))
    return g.where("item_days >= 40")


@twin("dom41_j18_plan_drift", f"""WITH {OBS}, r AS (SELECT d, item, avg(sold) OVER (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS now, avg(sold) OVER (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS early FROM obs),
g AS (SELECT abs(floor(now + 0.5e0) - floor(early + 0.5e0)) AS gap FROM r WHERE d > (SELECT max(d) - 28 FROM obs) AND early IS NOT NULL) SELECT count(*) AS item_days, round(avg((gap = 0)::INT), 6) AS exact, round(avg((gap <= 1)::INT), 6) AS within_one FROM g HAVING count(*) >= 40""")
def _(spark, d):
    o = observations(spark, d)
    w = by_weekday()
    now, early = F.avg("sold").over(w.rowsBetween(-4, -1)), F.avg("sold").over(w.rowsBetween(-5, -2))
    x = o.withColumns({"now": now, "early": early}).join(F.broadcast(o.agg(F.max("d").alias("hi"))), F.col("d") > F.date_sub("hi", 28)).where("early is not null")
    gap = F.abs(S.round_half_up(F.col("now")) - S.round_half_up(F.col("early")))
    return x.agg(F.count("*").alias("item_days"), F.round(F.avg((gap == 0).cast("int")), 6).alias("exact"), F.round(F.avg((gap <= 1).cast("int")), 6).alias("within_one")).where("item_days >= 40")


@twin("dom42_extra_rolls", f"""WITH {BACK}, k AS (SELECT *, greatest(0, least(supply, q + 2) - q) AS extra FROM sc WHERE factor = 1e0 AND policy = 'same_weekday_mean' AND q IS NOT NULL), y AS (SELECT *, greatest(0, least(sold - q, extra)) AS xs FROM k)
SELECT item, sum(extra) AS made, sum(xs) AS sold, round(sum(xs * p * 0.8e0 - extra * c), 4) AS dollars, CASE WHEN sum(extra) >= 8 AND sum(xs * p * 0.8e0 - extra * c) < 0 THEN 'too-high' WHEN sum(xs * p * 0.8e0 - extra * c) > 0 THEN 'paying' ELSE 'steady' END AS verdict FROM y GROUP BY 1""")
def _(spark, d):
    k = P.walk_forward(eobs(spark, d), ["same_weekday_mean"]).where("q is not null")
    extra = F.greatest(F.lit(0.0), F.least(F.col("supply").cast("double"), F.col("q") + 2) - F.col("q"))
    k = k.withColumn("extra", extra).withColumn("xs", F.greatest(F.lit(0.0), F.least(F.col("sold") - F.col("q"), "extra")))
    dollars = F.sum(F.col("xs") * F.col("eff_price") * 0.8 - F.col("extra") * F.col("eff_cost"))
    verdict = F.when((F.sum("extra") >= 8) & (dollars < 0), "too-high").when(dollars > 0, "paying").otherwise("steady")
    return k.groupBy("item").agg(F.sum("extra").alias("made"), F.sum("xs").alias("sold"), F.round(dollars, 4).alias("dollars"), verdict.alias("verdict"))


@twin("dom42_ambition_verdicts")
def _(spark, d):
    """Each level, as if it had been in force for the last two weeks. Tests hold its parts, not the whole, against loops and cases."""
    obs = written(eobs(spark, d), "observations")  # days, periods and the rule all read it
    days = obs.groupBy("d").agg(
        F.sum("supply").alias("made"), F.sum(F.least("wasted", "supply")).alias("left_over"), F.count_if(F.col("supply") > 0).alias("items"), F.count_if(F.col("censored") & (F.col("supply") > 0)).alias("sellouts"),
        F.sum(F.col("eff_price") * F.col("sold") - F.col("eff_cost") * F.col("supply")).alias("profit"),
    )
    x = A.verdicts(obs, days)
    return x.select("level", "verdict", "recent_days", "suggested", "made", "sold", *[F.round(c, 4).alias(c) for c in ("dollars", "recent_profit", "earlier_profit", "recent_waste", "earlier_waste", "recent_sellouts")])


@twin("dom43_srt8_outstanding_tasks", f"""WITH {OBS}, dd AS (SELECT DISTINCT d FROM obs), m AS (SELECT max(d) AS today FROM dd), sp AS (SELECT today - i::INT AS day, i, today FROM m, (SELECT unnest(range(0, 15)) AS i)),
t AS (SELECT day, i, 'waste' AS kind FROM sp WHERE EXISTS (SELECT 1 FROM dd WHERE d = day) AND day(day) % 4 = 0 AND day(day) <> 13 AND i > 0 UNION ALL SELECT day, i, 'production' FROM sp WHERE day(day) % 3 <> 0 AND day(day) <> 13 AND (i = 0 OR (i = 1 AND EXISTS (SELECT 1 FROM dd WHERE d = day))))
SELECT day, kind, CASE WHEN kind = 'waste' THEN i > 1 ELSE i > 0 END AS is_backfill, row_number() OVER (ORDER BY day, kind DESC) AS place FROM t""")
def _(spark, d):
    days = observations(spark, d).select("d").distinct()
    spine = days.agg(F.max("d").alias("today")).select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.date_sub("today", i))).alias("i", "day"))
    x = spine.join(days, F.col("day") == F.col("d"), "left").where(F.dayofmonth("day") != 13)
    there, n = F.col("d").isNotNull(), F.dayofmonth("day")
    waste = F.when(there & (n % 4 == 0) & (F.col("i") > 0), F.struct(F.lit("waste").alias("kind"), (F.col("i") > 1).alias("is_backfill")))
    prod = F.when((n % 3 != 0) & ((F.col("i") == 0) | ((F.col("i") == 1) & there)), F.struct(F.lit("production").alias("kind"), (F.col("i") > 0).alias("is_backfill")))
    t = x.select("day", F.explode(F.array_compact(F.array(waste, prod))).alias("t")).select("day", "t.*")
    return t.withColumn("place", F.row_number().over(Window.orderBy("day", F.col("kind").desc())))


@twin("dom50_waste_validation", f"WITH {OBS} SELECT d, item, wasted + length(item) % 3 AS typed, supply, wasted + length(item) % 3 > supply AS over_count, wasted = 0 AS rest_sold_out FROM obs")
def _(spark, d):
    typed = F.col("wasted") + F.length("item") % 3
    return observations(spark, d).select("d", "item", typed.alias("typed"), "supply", (typed > F.col("supply")).alias("over_count"), (F.col("wasted") == 0).alias("rest_sold_out"))


@twin("hlp22_plan_week_totals", f"WITH {LADDER} SELECT date_trunc('week', t)::DATE AS week, sum(base + coalesce(extra, 0)) AS rolls, round(sum((base + coalesce(extra, 0)) * cost), 4) AS ingredients, sum(coalesce(extra, 0)) AS trial_rolls FROM st LEFT JOIN ex USING (item) GROUP BY 1")
def _(spark, d):
    q = ladder(spark, d)
    return q.groupBy(F.to_date(F.date_trunc("week", "t")).alias("week")).agg(F.sum("quantity").alias("rolls"), F.round(F.sum(F.col("quantity") * F.col("eff_cost")), 4).alias("ingredients"), F.sum(F.col("quantity") - F.col("base")).alias("trial_rolls"))


@twin("hlp11_rate_by_halves", f"""WITH {OBS}, dd AS (SELECT d, ntile(2) OVER (ORDER BY d) AS half FROM (SELECT DISTINCT d FROM obs)), w AS (SELECT *, max(supply) OVER p3 AS usual, count(*) OVER p3 AS n FROM obs WINDOW p3 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT half, count(*) AS tried, round(avg((sold >= usual + 1)::INT), 6) AS rate FROM w JOIN dd USING (d) WHERE n = 3 AND supply > usual AND sold >= usual GROUP BY 1""")
def _(spark, d):
    past = P.earlier(by_weekday(), 3)
    o = observations(spark, d)
    halves = o.select("d").distinct().withColumn("half", F.ntile(2).over(Window.orderBy("d")))
    x = o.withColumns({"usual": F.max("supply").over(past), "n": F.count("*").over(past)}).where("n = 3 and supply > usual and sold >= usual").join(F.broadcast(halves), "d")
    return x.groupBy(F.col("half").cast("long").alias("half")).agg(F.count("*").alias("tried"), F.round(F.avg((F.col("sold") >= F.col("usual") + 1).cast("int")), 6).alias("rate"))


# ----------------------------------------------------------------- weather --

WX = f"""{OBS}, wd AS (SELECT d, dow, sum(sold)::DOUBLE AS sold, CASE WHEN (date_diff('day', DATE '1995-01-01', d) * 7919) % 10 < 3 THEN 'wet' WHEN (date_diff('day', DATE '1995-01-01', d) * 7919) % 10 = 3 THEN 'snow' ELSE 'dry' END AS band FROM obs GROUP BY 1, 2 HAVING sum(sold) > 0),
bl AS (SELECT a.d, a.dow, a.sold, a.band, CASE WHEN count(b.sold) FILTER (WHERE abs(date_diff('day', a.d, b.d)) <= 28) >= 2 THEN avg(b.sold) FILTER (WHERE abs(date_diff('day', a.d, b.d)) <= 28) WHEN count(b.sold) >= 2 THEN avg(b.sold) END AS base FROM wd a LEFT JOIN wd b ON b.dow = a.dow AND b.d <> a.d AND b.band = 'dry' GROUP BY 1, 2, 3, 4),
ra AS (SELECT *, sold / base AS r FROM bl WHERE base > 0)"""


def weather_days(spark, d):
    o = observations(spark, d).groupBy("d", "dow").agg(F.sum("sold").cast("double").alias("sold")).where("sold > 0")
    n = (F.datediff("d", F.lit("1995-01-01").cast("date")) * 7919) % 10
    return o.withColumn("band", F.when(n < 3, "wet").when(n == 3, "snow").otherwise("dry"))


@twin("dom32_j11_weather_effect", f"WITH {WX} SELECT band, count(*) AS n, round(avg(r), 6) AS ratio, round(sqrt(var_samp(r) / count(*)), 6) AS se, round(abs(avg(r) - 1) / sqrt(var_samp(r) / count(*)), 5) AS t, count(*) >= 8 AND abs(avg(r) - 1) / sqrt(var_samp(r) / count(*)) >= 2 AS usable FROM ra WHERE band <> 'dry' GROUP BY 1")
def _(spark, d):
    return W.band_effects(W.ratios(weather_days(spark, d)))


@twin("dom33_rain_by_weekday", f"""WITH {WX}, g AS (SELECT dow, count(*) AS n, avg(r) AS m, coalesce(var_samp(r), 0) AS s2 FROM ra WHERE band = 'wet' GROUP BY 1), po AS (SELECT sum((n - 1) * s2) / sum(n - 1) AS s2p FROM g),
v AS (SELECT g.*, greatest(s2p / n, 1e-4) AS v FROM g, po), fx AS (SELECT sum(m / v) / sum(1 / v) AS fixed, sum(1 / v) AS w, sum(1 / (v * v)) AS w2, count(*) AS k FROM v),
q AS (SELECT sum(power(m - fixed, 2) / v) AS q, any_value(w) AS w, any_value(w2) AS w2, any_value(k) AS k FROM v, fx), t AS (SELECT greatest(0, (q - (k - 1)) / (w - w2 / w)) AS tau2 FROM q),
mu AS (SELECT sum(m / (v + tau2)) / sum(1 / (v + tau2)) AS mu, sqrt(1 / sum(1 / (v + tau2))) AS se_mu, any_value(tau2) AS tau2 FROM v, t)
SELECT dow, n, round(CASE WHEN tau2 > 0 THEN (m / v + mu / tau2) / (1 / v + 1 / tau2) ELSE mu END, 6) AS ratio, round(CASE WHEN tau2 > 0 THEN sqrt(1 / (1 / v + 1 / tau2)) ELSE sqrt(se_mu * se_mu + tau2) END, 6) AS se, n >= 8 AS usable FROM v, mu""")
def _(spark, d):
    return W.rain_by_weekday(W.ratios(weather_days(spark, d)))


@twin("dom34_35_weather_advice", f"""WITH {WX}, e AS (SELECT band, count(*) AS n, avg(r) AS ratio, sqrt(var_samp(r) / count(*)) AS se FROM ra WHERE band <> 'dry' GROUP BY 1), dr AS (SELECT count(*) FILTER (WHERE band = 'dry') AS dry FROM ra), ty AS (SELECT (any_value(dry) + sum(n * ratio)) / (any_value(dry) + sum(n)) AS typical FROM e, dr)
SELECT band, round(ratio / typical, 6) AS relative, CASE WHEN n < 8 THEN 'unseen' WHEN abs(ratio - 1) >= 2 * se THEN 'endorsed' WHEN abs(ratio - 1) >= 1.2816e0 * se THEN 'credible' ELSE 'noisy' END AS advice FROM e, ty""")
def _(spark, d):
    return W.advice(W.ratios(weather_days(spark, d)))


@twin("dom34_35_39_weather_outlook")
def _(spark, d):
    """The 14 days after the last on record, some warmer than any. Temperatures and forecasts follow from day numbers. Tests hold its parts, not the whole, against loops and cases."""
    no = F.datediff("d", F.lit("1995-01-01").cast("date"))
    days = weather_days(spark, d).withColumn("temp_max", 40 + no * 31 % 45)
    ahead = days.agg(F.max("d").alias("hi")).select(F.posexplode(F.sequence(F.date_add("hi", 1), F.date_add("hi", 14))).alias("i", "d"))
    i = F.col("i")
    band = F.when(i % 4 == 1, "wet").when(i % 4 == 2, "snow").when(i % 4 == 3, "heavy").otherwise("dry")
    f = ahead.select("d", band.alias("band"), F.when(i == 12, 120).otherwise(60).alias("temp_max"), F.when(i % 3 > 0, i / 13.0).alias("rain_chance"))
    x = W.outlook(W.advised(f, W.effect(days)), days)
    return x.select("d", "band", "reason", "n", "endorsed", "credible", "confidence", "baseline_days", *[F.round(c, 6).alias(c) for c in ("offered", "relative", "baseline")], "projected")


@twin("agg22_reduce_to_days", """SELECT ts::DATE AS d, round(coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0) / 100, 3) AS precip, round(max(value), 3) AS temp_max, round(min(value), 3) AS temp_min, max(user_id % 97) AS code FROM events WHERE hour(ts) >= 8 AND hour(ts) < 20 GROUP BY 1 HAVING count(value) > 0""")
def _(spark, d):
    e = table(spark, d, "events").where("hour(ts) >= 8 and hour(ts) < 20")
    return e.groupBy(F.to_date("ts").alias("d")).agg(
        F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("value"))), F.lit(0.0)) / 100, 3).alias("precip"), F.round(F.max("value"), 3).alias("temp_max"),
        F.round(F.min("value"), 3).alias("temp_min"), F.max(F.col("user_id") % 97).alias("code"),
    )


@twin("prj13_14_weather_words", "WITH w AS (SELECT event_id, user_id % 97 AS code, value / 200 AS precip, CASE WHEN event_id % 9 = 0 THEN 0.2e0 ELSE 0e0 END AS snow FROM events) SELECT event_id, CASE WHEN snow >= 0.1e0 THEN 'snow' WHEN precip >= 0.4e0 THEN 'heavy' WHEN precip >= 0.05e0 THEN 'wet' ELSE 'dry' END AS band, CASE WHEN snow >= 0.1e0 OR code BETWEEN 71 AND 77 OR code IN (85, 86) THEN 'snow' WHEN code >= 95 THEN 'thunderstorms' WHEN precip >= 0.4e0 THEN 'heavy rain' WHEN code BETWEEN 80 AND 82 THEN 'showers' WHEN code BETWEEN 61 AND 65 THEN 'rain' WHEN code BETWEEN 51 AND 57 THEN 'drizzle' WHEN code BETWEEN 45 AND 48 THEN 'fog' WHEN code = 3 THEN 'overcast' WHEN code IN (1, 2) THEN 'partly cloudy' ELSE 'clear' END AS words FROM w")
def _(spark, d):
    code, precip, snow = F.col("user_id") % 97, F.col("value") / 200, F.when(F.col("event_id") % 9 == 0, 0.2).otherwise(0.0)
    return table(spark, d, "events").select("event_id", S.weather_band(precip, snow).alias("band"), S.weather_words(code, precip, snow).alias("words"))


@twin("dom36_mth10_scale_quantities", f"""WITH {OBS}, q AS (SELECT d, item, supply AS q FROM obs WHERE supply > 0), t AS (SELECT d, count(*) AS n, sum(q) AS total, greatest(count(*), floor(sum(q) * 0.8e0 + 0.5e0))::BIGINT AS target FROM q GROUP BY 1),
f AS (SELECT q.*, target, greatest(1, floor(q * 0.8e0))::BIGINT AS fl, q * 0.8e0 - floor(q * 0.8e0) AS rem FROM q JOIN t USING (d)), s AS (SELECT *, sum(fl) OVER (PARTITION BY d) AS base FROM f),
u AS (SELECT *, CASE WHEN fl < q THEN row_number() OVER (PARTITION BY d, fl < q ORDER BY rem DESC, item) END AS up, CASE WHEN fl > 1 THEN row_number() OVER (PARTITION BY d, fl > 1 ORDER BY q * 0.8e0 - fl, item) END AS down FROM s)
SELECT d, item, q, fl + CASE WHEN target > base AND up <= target - base THEN 1 WHEN target < base AND down <= base - target THEN -1 ELSE 0 END AS scaled FROM u""")
def _(spark, d):
    o = observations(spark, d)
    q = o.where("supply > 0").select("d", "item", F.col("supply").alias("q"))
    return W.scaled(q, 0.8)
