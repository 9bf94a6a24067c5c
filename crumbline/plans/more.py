"""Queries: what is left of rules, rollups and housekeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crumbline.functions import scalars as S
from crumbline.operators import jobs as J
from crumbline.operators import ladder as L
from crumbline.operators import observations as O
from crumbline.operators import policies as P
from crumbline.operators.economics import scored
from crumbline.operators.observations import by_item, by_weekday
from crumbline.shared import written
from crumbline.sources.adapter import LOG, OBS, economics, log, observations, table

from .planning import ALL_LADDERS, BACK, EOBS, LADDER, MEAN, NAMES, eobs, ladder
from .registry import twin
from .shop import DAYS, day_stats
from .warehouse import SALES, current


@twin("dom1_operator_actual", f"WITH {OBS} SELECT d, item, supply::DOUBLE AS q FROM obs")
def _(spark, d):
    return P.operator_actual(observations(spark, d)).select("d", "item", "q")


@twin("dom19_overfit_check", f"""WITH {EOBS}, p AS (SELECT x.*, {MEAN} AS honest, CASE WHEN count(sold) OVER l4 >= 2 THEN greatest(0, floor(avg(sold) OVER l4 + 0.5e0))::DOUBLE END AS leaky FROM x WINDOW w4 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), l4 AS (PARTITION BY item, dow ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
SELECT round(sum(CASE WHEN honest >= sold THEN co * (honest - sold) ELSE cu * (sold - honest) END), 4) AS honest_cost, round(sum(CASE WHEN leaky >= sold THEN co * (leaky - sold) ELSE cu * (sold - leaky) END), 4) AS leaky_cost FROM p WHERE honest IS NOT NULL""")
def _(spark, d):
    """The same rule with and without sight of the day itself: a large gap says how much a leak would flatter."""
    seen = by_weekday().rowsBetween(-3, 0)
    leaky = F.when(F.count("sold").over(seen) >= 2, F.greatest(F.lit(0), S.round_half_up(F.avg("sold").over(seen))).cast("double"))
    x = eobs(spark, d).withColumns({"honest": P.weekday_mean(), "leaky": leaky}).where("honest is not null")
    cost = lambda q: F.sum(F.when(F.col(q) >= F.col("sold"), F.col("co") * (F.col(q) - F.col("sold"))).otherwise(F.col("cu") * (F.col("sold") - F.col(q))))
    return x.agg(F.round(cost("honest"), 4).alias("honest_cost"), F.round(cost("leaky"), 4).alias("leaky_cost"))


@twin("agg7_skipped_decisions", f"WITH {BACK} SELECT policy, item, count(*) FILTER (WHERE q IS NULL) AS skipped, count(*) AS asked FROM sc WHERE factor = 1e0 GROUP BY 1, 2")
def _(spark, d):
    rows = P.walk_forward(eobs(spark, d), NAMES)
    return rows.groupBy("policy", "item").agg(F.count_if(F.col("q").isNull()).alias("skipped"), F.count("*").alias("asked"))


@twin("agg26_sample_moments", f"WITH {OBS} SELECT item, dow, round(avg(sold), 6) AS mean_sold, round(coalesce(var_samp(sold), 0), 6) AS var_sold, round(coalesce(stddev_samp(sold), 0), 6) AS sd_sold FROM obs GROUP BY 1, 2")
def _(spark, d):
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return observations(spark, d).groupBy("item", "dow").agg(F.round(F.avg("sold"), 6).alias("mean_sold"), zero(F.var_samp("sold")).alias("var_sold"), zero(F.stddev_samp("sold")).alias("sd_sold"))


@twin("agg28_prediction_tally", f"WITH {DAYS}, p AS (SELECT d, sold, avg(sold) OVER w AS m, stddev_samp(sold) OVER w AS s FROM dst WINDOW w AS (PARTITION BY dow ORDER BY d ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT count(*) AS days, count(*) FILTER (WHERE abs(sold - m) <= 1.077e0 * s) AS in68, round(count(*) FILTER (WHERE abs(sold - m) <= 1.077e0 * s) / count(*), 6) AS rate FROM p WHERE s > 0")
def _(spark, d):
    w = Window.partitionBy("dow").orderBy("d").rowsBetween(-8, -1)
    p = day_stats(spark, d).withColumns({"m": F.avg("sold").over(w), "s": F.stddev_samp("sold").over(w)}).where("s > 0")
    hit = F.abs(F.col("sold") - F.col("m")) <= 1.077 * F.col("s")
    return p.agg(F.count("*").alias("days"), F.count_if(hit).alias("in68"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"))


@twin("agg30_distinct_sets", f"WITH {LOG} SELECT entry_type, count(DISTINCT item_id) AS items, count(DISTINCT business_date) AS days, list_sort(list(DISTINCT item_id)) AS item_ids FROM log GROUP BY 1")
def _(spark, d):
    return log(spark, d).groupBy("entry_type").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("business_date").alias("days"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


@twin("win7_same_kind_evidence", f"WITH {OBS}, n AS (SELECT item, dow = 3 AS promo, supply, censored, row_number() OVER (PARTITION BY item, dow = 3 ORDER BY d DESC) AS nth FROM obs) SELECT item, promo, count(*) AS kept, count(*) FILTER (WHERE censored) AS sold_out FROM n WHERE nth <= 8 AND supply >= 2 GROUP BY 1, 2")
def _(spark, d):
    o = observations(spark, d).withColumn("promo", F.col("dow") == 3)
    n = o.withColumn("nth", F.row_number().over(Window.partitionBy("item", "promo").orderBy(F.col("d").desc()))).where("nth <= 8 and supply >= 2")
    return n.groupBy("item", "promo").agg(F.count("*").alias("kept"), F.count_if("censored").alias("sold_out"))


@twin("win14_uncrossed_quantiles", f"WITH {OBS}, q AS (SELECT item, unnest([0.55e0, 0.65e0, 0.75e0, 0.85e0]) AS tau, unnest([quantile_cont(sold, 0.55), quantile_cont(sold, 0.65) - 0.5e0, quantile_cont(sold, 0.75) - 1, quantile_cont(sold, 0.85)]) AS v FROM obs GROUP BY 1) SELECT item, tau, round(max(v) OVER (PARTITION BY item ORDER BY tau), 6) AS q FROM q")
def _(spark, d):
    taus = (0.55, 0.65, 0.75, 0.85)
    g = observations(spark, d).groupBy("item").agg(F.expr(f"percentile(sold, array{taus})").alias("p"))
    off = F.array(*[F.lit(x) for x in (0.0, 0.5, 1.0, 0.0)])
    q = g.select("item", F.posexplode(F.zip_with("p", off, lambda v, o: v - o)).alias("i", "v")).withColumn("tau", F.element_at(F.array(*[F.lit(t) for t in taus]), F.col("i") + 1))
    return q.select("item", "tau", F.round(F.max("v").over(Window.partitionBy("item").orderBy("tau")), 6).alias("q"))


@twin("win11_estimate_fallback", f"WITH {DAYS}, n AS (SELECT dow, profit, row_number() OVER (PARTITION BY dow ORDER BY d DESC) AS a, row_number() OVER (ORDER BY d DESC) AS b FROM dst WHERE dow <> 6 OR day(d) = 1), s AS (SELECT dow, count(*) AS n, avg(profit) AS m FROM n WHERE a <= 6 AND b <= 60 GROUP BY 1), p AS (SELECT avg(profit) AS pm FROM n WHERE b <= 14) SELECT w AS dow, coalesce(s.n, 0) AS n, round(CASE WHEN coalesce(s.n, 0) < 2 THEN pm ELSE m END, 6) AS estimate FROM (SELECT unnest(range(1, 8))::INT AS w) LEFT JOIN s ON s.dow = w, p")
def _(spark, d):
    s = day_stats(spark, d).where("dow <> 6 or day(d) = 1").select("d", "dow", "profit")
    last = s.orderBy(F.col("d").desc()).limit(60).withColumn("b", F.row_number().over(Window.orderBy(F.col("d").desc())))
    last = last.withColumn("a", F.row_number().over(Window.partitionBy("dow").orderBy(F.col("d").desc())))
    by_dow = last.where("a <= 6").groupBy("dow").agg(F.count("*").alias("n"), F.avg("profit").alias("m"))
    pooled = last.where("b <= 14").agg(F.avg("profit").alias("pm"))
    week = spark.range(1, 8).select(F.col("id").cast("int").alias("dow"))
    x = week.join(by_dow, "dow", "left").join(F.broadcast(pooled), F.lit(True))
    n = F.coalesce("n", F.lit(0))
    return x.select("dow", n.cast("long").alias("n"), F.round(F.when(n < 2, F.col("pm")).otherwise(F.col("m")), 6).alias("estimate"))


@twin("hlp3_4_continuation_break_even", f"WITH {LADDER} SELECT item, cont AS continuation, round(be, 6) AS break_even FROM cl")
def _(spark, d):
    q = ladder(spark, d)
    return q.select("item", L.continuation(F.col("popularity")).alias("continuation"), F.round("be", 6).alias("break_even"))


@twin("dom38_full_rule", f"WITH {LADDER}, nb AS (SELECT item, floor(avg(sold) + 0.5e0)::BIGINT AS naive FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d DESC) AS nn FROM h WHERE same) WHERE nn <= 4 GROUP BY 1) SELECT st.item, t, base + coalesce(extra, 0) AS quantity, naive, base + coalesce(extra, 0) - naive AS against_naive FROM st LEFT JOIN ex USING (item) LEFT JOIN nb USING (item)")
def _(spark, d):
    return ladder(spark, d).select("item", "t", "quantity", "naive", (F.col("quantity") - F.col("naive")).alias("against_naive"))


LEVEL = " UNION ALL ".join(f"SELECT * FROM (WITH {LADDER} SELECT st.item, t, {level} AS level, base + {extra} AS quantity FROM st LEFT JOIN ex USING (item))" for level, extra in ((1, "0"), (3, "coalesce(extra, 0)")))


@twin("dom16_ambition_levels", LEVEL)
def _(spark, d):
    """The levels share one ladder; each has its own climb and budget."""
    obs = observations(spark, d)
    made = written(L.ladders(L.with_next_days(obs), economics(spark), by_unit=False), "ladders")
    one = lambda level: L.budgeted(L.climb(made, level), level).select("item", "t", F.lit(level).alias("level"), "quantity")
    return one(1).union(one(3))


@twin("hlp10_batch_digest", """WITH a AS (SELECT event_type, event_id // 4096 AS b, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS h, count(*) AS n FROM events GROUP BY 1, 2),
b AS (SELECT event_type, b // 4096 AS c, sha256(string_agg(h, ',' ORDER BY b)) AS h, sum(n) AS n FROM a GROUP BY 1, 2) SELECT event_type, sha256(string_agg(h, ',' ORDER BY c)) AS digest, sum(n)::BIGINT AS row_count FROM b GROUP BY 1""")
def _(spark, d):
    """The digest of a batch is that of its blocks' digests, in two levels, so that no row holds more than 4,096 of them."""
    e = table(spark, d, "events").select("event_type", "event_id", F.floor(F.col("event_id") / 4096).alias("b"))
    ordered = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), ","), 256)
    blocks = e.groupBy("event_type", "b").agg(ordered("event_id", "event_id").alias("h"), F.count("*").alias("n"))
    above = blocks.groupBy("event_type", F.floor(F.col("b") / 4096).alias("c")).agg(ordered("b", "h").alias("h"), F.sum("n").alias("n"))
    return above.groupBy("event_type").agg(ordered("c", "h").alias("digest"), F.sum("n").alias("row_count"))


@twin("hlp14_waste_rate", f"{SALES} SELECT business_date, item_id, round(CASE WHEN quantity_made > 0 AND NOT demand_censored THEN quantity_wasted / quantity_made END, 6) AS waste_rate FROM sales")
def _(spark, d):
    rate = F.when((F.col("quantity_made") > 0) & ~F.col("demand_censored"), F.col("quantity_wasted") / F.col("quantity_made"))
    return O.sales(current(spark, d)).select("business_date", "item_id", F.round(rate, 6).alias("waste_rate"))


@twin("hlp15_next_ids", "SELECT p_type AS item, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY p_type) AS new_id FROM (SELECT DISTINCT p_type FROM part)")
def _(spark, d):
    p = table(spark, d, "part")
    new = p.select(F.col("p_type").alias("item")).distinct()
    top = F.broadcast(p.agg(F.max("p_partkey").alias("top")))
    return new.join(top, F.lit(True)).select("item", (F.col("top") + F.row_number().over(Window.orderBy("item"))).alias("new_id"))


@twin("hlp16_weather_sync_plan", "WITH h AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE day(ts) % 3 <> 0), sp AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-25', INTERVAL 1 DAY))::DATE AS d) SELECT d FROM sp WHERE d NOT IN (SELECT d FROM h)")
def _(spark, d):
    have = table(spark, d, "events").where("day(ts) % 3 <> 0").select(F.to_date("ts").alias("d"))
    return J.missing_days(have, "2024-01-24", 23)


@twin("hlp17_sync_label", "SELECT event_type, count(*) AS waiting, CASE WHEN count(*) = 0 THEN 'synced' WHEN max(user_id) % 2 = 0 THEN 'retrying ' || count(*) ELSE 'sending ' || count(*) END AS label FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("waiting"), F.max("user_id").alias("u"))
    label = F.when(F.col("waiting") == 0, "synced").when(F.col("u") % 2 == 0, F.format_string("retrying %d", "waiting")).otherwise(F.format_string("sending %d", "waiting"))
    return g.select("event_type", "waiting", label.alias("label"))


@twin("hlp21_home_summary", f"WITH {DAYS}, t AS (SELECT * FROM dst ORDER BY d DESC LIMIT 14) SELECT max(d) AS latest, count(*) AS days, round(avg(sales), 6) AS avg_sales, round(avg(CASE WHEN day(d) % 5 <> 0 THEN left_over END), 6) AS avg_left_known FROM t")
def _(spark, d):
    t = day_stats(spark, d).orderBy(F.col("d").desc()).limit(14)
    return t.agg(F.max("d").alias("latest"), F.count("*").alias("days"), F.round(F.avg("sales"), 6).alias("avg_sales"), F.round(F.avg(F.when(F.dayofmonth("d") % 5 != 0, F.col("left_over"))), 6).alias("avg_left_known"))


@twin("str3_dispatch_by_kind", f"WITH {LOG} SELECT entry_type AS kind, count(*) AS n, CASE WHEN entry_type IN ('made', 'refill', 'waste') THEN 'append' ELSE 'last write wins' END AS handling FROM log GROUP BY 1")
def _(spark, d):
    g = log(spark, d).groupBy(F.col("entry_type").alias("kind")).agg(F.count("*").alias("n"))
    return g.withColumn("handling", F.when(F.col("kind").isin("made", "refill", "waste"), "append").otherwise("last write wins"))


@twin("str9_snk8_outbound_batches", "SELECT (row_number() OVER (ORDER BY event_id) - 1) // 200 AS batch, event_id FROM events WHERE event_type = 'error'")
def _(spark, d):
    """Positions in the outbound queue: counts per range of ids are summed up first, then each range is numbered by itself."""
    q = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.floor(F.col("event_id") / 65536).alias("span"))
    spans = q.groupBy("span").agg(F.count("*").alias("n"))
    # One row per 65,536 ids.
    before = spans.select(F.col("span").alias("s"), (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))
    x = q.withColumn("nth", F.row_number().over(Window.partitionBy("span").orderBy("event_id"))).join(before, F.col("span") == F.col("s"))
    return x.select(F.floor((F.col("before") + F.col("nth") - 1) / 200).alias("batch"), "event_id")


@twin("str10_late_corrections", f"WITH {LOG}, s AS (SELECT *, business_date + (entry_id % 3)::INT AS arrived FROM log) SELECT arrived, count(*) AS n, count(*) FILTER (WHERE arrived > business_date) AS late FROM s GROUP BY 1")
def _(spark, d):
    s = log(spark, d).withColumn("arrived", F.date_add("business_date", (F.col("entry_id") % 3).cast("int")))
    return s.groupBy("arrived").agg(F.count("*").alias("n"), F.count_if(F.col("arrived") > F.col("business_date")).alias("late"))


@twin("j5_j6_strictly_before_history", f"WITH {OBS} SELECT t.d, t.item, count(*) AS days, count(*) FILTER (WHERE h.dow = t.dow) AS same_weekday, max(h.d) AS newest FROM obs t JOIN obs h ON h.item = t.item AND h.d < t.d GROUP BY 1, 2")
def _(spark, d):
    """What each decision may see: frames that end the row before, not pairs of days."""
    n = lambda w: F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = observations(spark, d).withColumns({"days": n(by_item()), "same_weekday": n(by_weekday()), "newest": F.lag("d").over(by_item())})
    return x.where("days > 0").select("d", "item", "days", "same_weekday", "newest")


@twin("j12_dates_by_policies_grid", f"WITH {OBS} SELECT d, p AS policy FROM (SELECT DISTINCT d FROM obs), (SELECT unnest(['operator_actual', 'same_weekday_mean', 'same_weekday_quantile', 'roll_chance']) AS p)")
def _(spark, d):
    return observations(spark, d).select("d").distinct().select("d", F.explode(F.array(*[F.lit(n) for n in NAMES])).alias("policy"))


@twin("dom17_rolling_window_backtest", f"WITH {EOBS}, r AS (SELECT *, avg(sold) OVER (PARTITION BY item, dow ORDER BY d RANGE BETWEEN INTERVAL 56 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS m FROM x) SELECT item, count(m) AS decisions, round(sum(CASE WHEN floor(m + 0.5e0) >= sold THEN co * (floor(m + 0.5e0) - sold) ELSE cu * (sold - floor(m + 0.5e0)) END), 4) AS cost FROM r WHERE m IS NOT NULL GROUP BY 1")
def _(spark, d):
    no = F.datediff("d", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("item", "dow").orderBy("no").rangeBetween(-56, -1)
    x = eobs(spark, d).withColumn("no", no).withColumn("m", F.avg("sold").over(frame)).where("m is not null").withColumn("q", S.round_half_up(F.col("m")).cast("double"))
    return scored(x).groupBy("item").agg(F.count("m").alias("decisions"), F.round(F.sum("cost_of_error"), 4).alias("cost"))
