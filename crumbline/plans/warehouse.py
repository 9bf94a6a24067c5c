"""Queries on the append-only log, the item dimension, joins of every kind and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crumbline.operators import observations as O
from crumbline.operators.asof import in_force
from crumbline.operators.observations import isodow
from crumbline.sources.adapter import LOG, OBS, log, observations, table

from .registry import twin

KEY, ORDER = ["business_date", "item_id", "entry_type"], ["recorded_at", "entry_id"]


def current(spark, d):
    return O.latest(log(spark, d), KEY, ORDER)


SALES = f"""WITH {LOG}, pr AS (SELECT business_date, item_id, sum(quantity) FILTER (WHERE entry_type = 'made') AS m, sum(quantity) FILTER (WHERE entry_type = 'refill') AS r FROM cur WHERE entry_type IN ('made', 'refill') GROUP BY 1, 2),
wa AS (SELECT business_date, item_id, sum(quantity) AS w FROM cur WHERE entry_type = 'waste' GROUP BY 1, 2),
sales AS (SELECT business_date, item_id, coalesce(m, 0) AS quantity_made, coalesce(r, 0) AS quantity_refill, coalesce(w, 0) AS quantity_wasted, coalesce(m, 0) + coalesce(r, 0) - coalesce(w, 0) AS quantity_sold, coalesce(w, 0) = 0 AS demand_censored FROM pr FULL JOIN wa USING (business_date, item_id))"""


@twin("agg1_current_entries", f"WITH {LOG} SELECT business_date, item_id, entry_type, quantity, entry_id FROM cur")
def _(spark, d):
    return current(spark, d).select("business_date", "item_id", "entry_type", "quantity", "entry_id")


@twin("agg2_daily_production", f"{SALES} SELECT business_date, item_id, m AS quantity_made, r AS quantity_refill FROM pr")
def _(spark, d):
    return O.production(current(spark, d))


@twin("agg3_daily_waste", f"{SALES} SELECT business_date, item_id, w AS quantity_wasted FROM wa")
def _(spark, d):
    return O.waste(current(spark, d))


@twin("j1_prj2_daily_sales", f"{SALES} SELECT * FROM sales")
def _(spark, d):
    return O.sales(current(spark, d))


@twin("str5_corrections_history", f"WITH {LOG} SELECT business_date, item_id, entry_type, count(*) AS versions, count(DISTINCT quantity) AS different FROM log GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(spark, d):
    return log(spark, d).groupBy(*KEY).agg(F.count("*").alias("versions"), F.countDistinct("quantity").alias("different")).where("versions > 1")


@twin("str5_operator_rows_win", f"""WITH {LOG}, f AS (SELECT business_date, item_id, entry_type, quantity + 1 AS fq FROM log WHERE entry_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY business_date, item_id, entry_type ORDER BY entry_id DESC) = 1)
SELECT business_date, item_id, entry_type, CASE WHEN entry_id % 2 = 1 THEN quantity WHEN fq IS NOT NULL THEN fq WHEN entry_type = 'waste' THEN quantity WHEN entry_id IS NOT NULL THEN 0e0 END AS quantity,
CASE WHEN entry_id IS NULL THEN 'new' WHEN entry_id % 2 = 1 THEN 'operator' WHEN fq IS NULL THEN CASE WHEN entry_type = 'waste' THEN 'kept' ELSE 'dropped' END WHEN fq = quantity THEN 'same' ELSE 'corrected' END AS outcome FROM cur FULL JOIN f USING (business_date, item_id, entry_type) WHERE true""".replace("WHEN entry_id IS NOT NULL THEN 0e0 END", "ELSE 0e0 END"))
def _(spark, d):
    """A newer file against what is stored: it overrides seeded rows (even ids), never the operator's; what it lacks becomes 0, but never waste."""
    entries = log(spark, d)
    file = O.latest(entries.where("entry_id % 3 = 0"), KEY, ["entry_id"]).select(*KEY, (F.col("quantity") + 1).alias("fq"))
    both = current(spark, d).join(file, KEY, "full")
    operator, is_waste = F.col("entry_id") % 2 == 1, F.col("entry_type") == "waste"
    q = F.when(operator, F.col("quantity")).when(F.col("fq").isNotNull(), F.col("fq")).when(is_waste, F.col("quantity")).otherwise(0.0)
    outcome = F.when(F.col("entry_id").isNull(), "new").when(operator, "operator").when(F.col("fq").isNull(), F.when(is_waste, "kept").otherwise("dropped")).when(F.col("fq") == F.col("quantity"), "same").otherwise("corrected")
    return both.select(*KEY, q.alias("quantity"), outcome.alias("outcome"))


@twin("str6_fill_only_gaps", f"{SALES}, base AS (SELECT business_date, item_id, quantity_made FROM sales WHERE item_id % 2 = 0) SELECT s.business_date, s.item_id, coalesce(b.quantity_made, s.quantity_made + 100) AS quantity_made FROM sales s LEFT JOIN base b USING (business_date, item_id)")
def _(spark, d):
    s = O.sales(current(spark, d))
    have = s.where("item_id % 2 = 0").select("business_date", "item_id", F.col("quantity_made").alias("have"))
    return s.join(have, ["business_date", "item_id"], "left").select("business_date", "item_id", F.coalesce("have", F.col("quantity_made") + 100).alias("quantity_made"))


@twin("str7_forecast_never_replaces_archive", """WITH w AS (SELECT ts::DATE AS d, 'archive' AS kind, round(sum(value), 4) AS v FROM events WHERE event_type = 'error' GROUP BY 1 UNION ALL SELECT ts::DATE, 'forecast', round(avg(value), 4) FROM events WHERE event_type IN ('view', 'error') GROUP BY 1)
SELECT d, kind, v FROM w WHERE NOT (kind = 'archive' AND day(d) % 4 = 0) QUALIFY row_number() OVER (PARTITION BY d ORDER BY kind) = 1""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("d", F.to_date("ts"))
    archive = e.where("event_type = 'error'").groupBy("d").agg(F.round(F.sum("value"), 4).alias("v")).withColumn("kind", F.lit("archive")).where("day(d) % 4 <> 0")
    forecast = e.where("event_type in ('view', 'error')").groupBy("d").agg(F.round(F.avg("value"), 4).alias("v")).withColumn("kind", F.lit("forecast"))
    return archive.unionByName(forecast).groupBy("d").agg(F.min(F.struct("kind", "v")).alias("r")).select("d", "r.kind", "r.v")


@twin("j2_recommendation_outcomes", f"""{SALES}, rec AS (SELECT DISTINCT business_date, item_id, 5 + item_id % 7 AS recommended FROM log WHERE entry_type = 'made'), items AS (SELECT item_id, 'item-' || item_id AS item_key FROM (SELECT DISTINCT item_id FROM log))
SELECT r.business_date, item_key, recommended, quantity_made + quantity_refill AS supplied, quantity_sold, demand_censored FROM rec r JOIN items USING (item_id) LEFT JOIN sales s ON s.business_date = r.business_date AND s.item_id = r.item_id""")
def _(spark, d):
    rec = log(spark, d).where("entry_type = 'made'").select("business_date", "item_id").distinct().withColumn("recommended", 5 + F.col("item_id") % 7)
    items = log(spark, d).select("item_id").distinct().withColumn("item_key", F.concat(F.lit("item-"), F.col("item_id")))
    s = O.sales(current(spark, d))
    return rec.join(items, "item_id").join(s, ["business_date", "item_id"], "left").select("business_date", "item_key", "recommended", (F.col("quantity_made") + F.col("quantity_refill")).alias("supplied"), "quantity_sold", "demand_censored")


@twin("dom44_agg29_parallel_run", f"""{SALES}, ch AS (SELECT business_date, item_id, quantity_made + (item_id % 5 = 0)::INT AS sm, quantity_wasted + (day(business_date) % 6 = 0)::INT AS sw FROM sales),
df AS (SELECT c.business_date, c.item_id, s.quantity_made - sm AS made_diff, s.quantity_wasted - sw AS waste_diff FROM ch c LEFT JOIN sales s USING (business_date, item_id)),
dy AS (SELECT business_date, bool_and(made_diff = 0 AND waste_diff = 0) AS agree, count(*) AS n, sum(abs(made_diff)) AS made_off, sum(abs(waste_diff)) AS waste_off FROM df WHERE item_id % 5 <> 0 GROUP BY 1)
SELECT business_date, agree, n, made_off, waste_off, min(agree::INT) OVER (ORDER BY business_date DESC) = 1 AS in_streak FROM dy""")
def _(spark, d):
    s = O.sales(current(spark, d))
    checks = s.select("business_date", "item_id", (F.col("quantity_made") + (F.col("item_id") % 5 == 0).cast("int")).alias("sm"), (F.col("quantity_wasted") + (F.dayofmonth("business_date") % 6 == 0).cast("int")).alias("sw"))
    diff = checks.where("item_id % 5 <> 0").join(s, ["business_date", "item_id"], "left").select("business_date", (F.col("quantity_made") - F.col("sm")).alias("m"), (F.col("quantity_wasted") - F.col("sw")).alias("w"))
    days = diff.groupBy("business_date").agg(F.every((F.col("m") == 0) & (F.col("w") == 0)).alias("agree"), F.count("*").alias("n"), F.sum(F.abs("m")).alias("made_off"), F.sum(F.abs("w")).alias("waste_off"))
    # One row per day: the streak is counted from the newest one.
    return days.withColumn("in_streak", F.min(F.col("agree").cast("int")).over(Window.orderBy(F.col("business_date").desc())) == 1)


PRICES = "pc AS (SELECT p_type AS item, l_shipdate::DATE AS since, round(avg(p_retailprice), 4) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@twin("j3_price_in_force", f"WITH {OBS}, {PRICES} SELECT obs.d, obs.item, supply, pc.price AS price FROM obs ASOF LEFT JOIN pc ON obs.item = pc.item AND obs.d >= pc.since")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("item"), "p_retailprice")
    lines = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("since"), "l_partkey")
    changes = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("item", "since").agg(F.round(F.avg("p_retailprice"), 4).alias("price"))
    return in_force(observations(spark, d).select("d", "item", "supply"), changes, ["item"], "d", "since", ["price"])


@twin("j3_udf4_template_for_date", f"""WITH {OBS}, ta AS (SELECT weekday, since, (weekday + month(since)) % 3 AS tpl FROM (SELECT unnest(range(1, 8)) AS weekday), (SELECT unnest(range(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 3 MONTH))::DATE AS since)),
ti AS (SELECT tpl, item, 3 + tpl * 2 + length(item) % 4 AS qty FROM (SELECT unnest(range(0, 3)) AS tpl), (SELECT DISTINCT item FROM obs) WHERE length(item) % 2 = 0 OR tpl > 0), ds AS (SELECT DISTINCT d, dow AS weekday FROM obs),
fx AS (SELECT ds.d, ta.tpl FROM ds ASOF JOIN ta ON ds.weekday = ta.weekday AND ds.d >= ta.since) SELECT d, item, qty FROM fx JOIN ti USING (tpl)""")
def _(spark, d):
    weekdays = spark.range(1, 8).select(F.col("id").cast("int").alias("weekday"))
    since = spark.sql("select explode(sequence(date'1995-01-01', date'2001-11-30', interval 3 months)) as since")
    assigned = weekdays.crossJoin(since).withColumn("tpl", (F.col("weekday") + F.month("since")) % 3)
    obs = observations(spark, d)
    lines = spark.range(3).select(F.col("id").alias("tpl")).crossJoin(obs.select("item").distinct()).where((F.length("item") % 2 == 0) | (F.col("tpl") > 0))
    lines = lines.withColumn("qty", 3 + F.col("tpl") * 2 + F.length("item") % 4)
    days = obs.select("d", F.col("dow").alias("weekday")).distinct()
    return in_force(days, assigned, ["weekday"], "d", "since", ["tpl"]).where("tpl is not null").join(lines, "tpl").select("d", "item", "qty")


BOM = """ing AS (SELECT l_suppkey % 40 AS ing, l_shipdate::DATE AS since, round(avg(l_extendedprice) / 100, 4) AS pack_cost, 10 + l_suppkey % 40 AS pack_qty FROM lineitem GROUP BY 1, 2, 4),
bom AS (SELECT p_type AS item, p_size % 40 AS ing, round(sum(p_size) / 1000e0, 6) AS qty FROM part GROUP BY 1, 2)"""


def _bom(spark, d):
    lines = table(spark, d, "lineitem")
    ing = lines.groupBy((F.col("l_suppkey") % 40).alias("ing"), F.to_date("l_shipdate").alias("since")).agg(F.round(F.avg("l_extendedprice") / 100, 4).alias("pack_cost"))
    ing = ing.withColumn("pack_qty", 10 + F.col("ing"))
    bom = table(spark, d, "part").groupBy(F.col("p_type").alias("item"), (F.col("p_size") % 40).alias("ing")).agg(F.round(F.sum("p_size") / 1000, 6).alias("qty"))
    return ing, bom


@twin("j4_agg4_item_cost_current", f"WITH {BOM} SELECT item, round(sum(qty * pack_cost / pack_qty), 6) AS unit_cost FROM bom JOIN (SELECT DISTINCT ON (ing) * FROM ing ORDER BY ing, since DESC) USING (ing) GROUP BY 1")
def _(spark, d):
    ing, bom = _bom(spark, d)
    last = ing.groupBy("ing").agg(F.max_by(F.struct("pack_cost", "pack_qty"), "since").alias("p"))
    return bom.join(last, "ing").groupBy("item").agg(F.round(F.sum(F.col("qty") * F.col("p.pack_cost") / F.col("p.pack_qty")), 6).alias("unit_cost"))


@twin("j4_item_cost_asof", f"WITH {BOM}, ats AS (SELECT unnest([DATE '1996-06-15', DATE '1999-01-01', DATE '2001-03-03']) AS d), bd AS (SELECT * FROM bom, ats) SELECT d, item, round(sum(qty * pack_cost / pack_qty), 6) AS unit_cost FROM bd ASOF JOIN ing ON bd.ing = ing.ing AND bd.d >= ing.since GROUP BY 1, 2")
def _(spark, d):
    ing, bom = _bom(spark, d)
    days = spark.sql("select explode(array(date'1996-06-15', date'1999-01-01', date'2001-03-03')) as d")
    priced = in_force(bom.crossJoin(F.broadcast(days)), ing, ["ing"], "d", "since", ["pack_cost", "pack_qty"])
    return priced.where("pack_cost is not null").groupBy("d", "item").agg(F.round(F.sum(F.col("qty") * F.col("pack_cost") / F.col("pack_qty")), 6).alias("unit_cost"))


@twin("j9_dom43_open_days", f"WITH {LOG}, days AS (SELECT DISTINCT business_date, day(business_date) % 3 = 0 AS prod_done, day(business_date) % 5 = 0 AS waste_done FROM log WHERE day(business_date) <> 13) SELECT business_date, isodow(business_date)::INT AS day_of_week, prod_done, waste_done, EXISTS (SELECT 1 FROM log e WHERE e.business_date = days.business_date AND entry_type IN ('made', 'refill')) AS has_production, EXISTS (SELECT 1 FROM log e WHERE e.business_date = days.business_date AND entry_type = 'waste' AND item_id = 3) AS has_waste FROM days WHERE NOT (prod_done AND waste_done)")
def _(spark, d):
    entries = log(spark, d)
    days = entries.where("day(business_date) <> 13").select("business_date").distinct()
    flags = entries.groupBy("business_date").agg(F.bool_or(F.col("entry_type").isin("made", "refill")).alias("has_production"), F.bool_or((F.col("entry_type") == "waste") & (F.col("item_id") == 3)).alias("has_waste"))
    out = days.join(flags, "business_date", "left")
    out = out.select("business_date", isodow("business_date").alias("day_of_week"), (F.dayofmonth("business_date") % 3 == 0).alias("prod_done"), (F.dayofmonth("business_date") % 5 == 0).alias("waste_done"), "has_production", "has_waste")
    return out.where("not (prod_done and waste_done)")


@twin("j10_flt7_anti_join_new_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')")
def _(spark, d):
    late = table(spark, d, "orders").where("o_orderdate >= date'2001-01-01'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(late, "c_custkey", "left_anti")


@twin("j9_semi_join_active_parts", "SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= DATE '2001-06-01')")
def _(spark, d):
    late = table(spark, d, "lineitem").where("l_shipdate >= date'2001-06-01'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey", "p_type").join(late, "p_partkey", "left_semi")


@twin("set2_intersect_nations", "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def _(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("nationkey")).intersect(table(spark, d, "supplier").where("s_acctbal > 0").select("s_nationkey"))


@twin("set3_union_of_days", f"WITH {LOG}, u AS (SELECT business_date AS d FROM log UNION SELECT o_orderdate::DATE FROM orders WHERE o_orderdate < DATE '1995-03-01') SELECT d FROM u")
def _(spark, d):
    return log(spark, d).select(F.col("business_date").alias("d")).union(table(spark, d, "orders").where("o_orderdate < date'1995-03-01'").select(F.to_date("o_orderdate"))).distinct()


@twin("set4_win5_recent_set_overlap", f"WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY d DESC) AS a, row_number() OVER (PARTITION BY item, dow ORDER BY d DESC) AS b FROM obs), u AS (SELECT item, supply FROM n WHERE a <= 7 UNION ALL SELECT item, supply FROM n WHERE b <= 2) SELECT item, count(*) AS n_rows, max(supply) AS recent_max FROM u GROUP BY 1")
def _(spark, d):
    o = observations(spark, d)
    a = F.row_number().over(Window.partitionBy("item").orderBy(F.col("d").desc()))
    b = F.row_number().over(Window.partitionBy("item", "dow").orderBy(F.col("d").desc()))
    n = o.withColumns({"a": a, "b": b})
    return n.where("a <= 7").select("item", "supply").union(n.where("b <= 2").select("item", "supply")).groupBy("item").agg(F.count("*").alias("n_rows"), F.max("supply").alias("recent_max"))


@twin("set5_agg24_reconcile", "WITH l AS (SELECT l_orderkey AS k, round(sum(l_extendedprice), 2) AS v FROM lineitem WHERE l_linenumber < 7 GROUP BY 1), o AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(l.k, o.k) AS orderkey, round(coalesce(l.v, 0) - coalesce(o.v, 0), 2) AS delta, CASE WHEN l.k IS NULL THEN 'only header' WHEN o.k IS NULL THEN 'only lines' ELSE 'both' END AS side FROM l FULL JOIN o ON l.k = o.k WHERE abs(coalesce(l.v, 0) - coalesce(o.v, 0)) >= 0.01e0")
def _(spark, d):
    lines = table(spark, d, "lineitem").where("l_linenumber < 7").groupBy(F.col("l_orderkey").alias("orderkey")).agg(F.round(F.sum("l_extendedprice"), 2).alias("lv"))
    heads = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("ov"))
    gap = F.coalesce("lv", F.lit(0.0)) - F.coalesce("ov", F.lit(0.0))
    side = F.when(F.col("lv").isNull(), "only header").when(F.col("ov").isNull(), "only lines").otherwise("both")
    return lines.join(heads, "orderkey", "full").where(F.abs(gap) >= 0.01).select("orderkey", F.round(gap, 2).alias("delta"), side.alias("side"))


@twin("agg23_cross_foot", "WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1), h AS (SELECT o_orderkey, o_orderstatus, 25 * (1 + o_orderkey % 7) AS claimed FROM orders) SELECT o_orderstatus AS status, count(*) AS n_orders, count(*) FILTER (WHERE q <> claimed) AS mismatches, sum(q - claimed) AS off_by FROM h JOIN l ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    heads = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), (25 * (1 + F.col("o_orderkey") % 7)).alias("claimed"))
    both = heads.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("status").agg(F.count("*").alias("n_orders"), F.count_if(F.col("q") != F.col("claimed")).alias("mismatches"), F.sum(F.col("q") - F.col("claimed")).alias("off_by"))


@twin("j14_calendar_spine", f"{SALES}, ends AS (SELECT min(business_date) AS lo, max(business_date) AS hi FROM log), spine AS (SELECT unnest(range(lo::TIMESTAMP - INTERVAL 3 DAY, hi + INTERVAL 4 DAY, INTERVAL 1 DAY))::DATE AS d FROM ends) SELECT d, sum(quantity_sold) AS sold FROM spine LEFT JOIN sales ON business_date = d GROUP BY 1")
def _(spark, d):
    s = O.sales(current(spark, d))
    spine = s.agg(F.min("business_date").alias("lo"), F.max("business_date").alias("hi")).select(F.explode(F.sequence(F.date_sub("lo", 3), F.date_add("hi", 3))).alias("d"))
    days = s.groupBy("business_date").agg(F.sum("quantity_sold").alias("sold"))
    return spine.join(days, spine.d == days.business_date, "left").select("d", "sold")


@twin("j15_dom49_waste_vs_last_week", f"{SALES} SELECT a.business_date, a.item_id, a.quantity_wasted, b.quantity_wasted AS last_week, a.quantity_wasted - b.quantity_wasted AS change FROM sales a LEFT JOIN sales b ON b.item_id = a.item_id AND b.business_date = a.business_date - 7")
def _(spark, d):
    s = O.sales(current(spark, d)).select("business_date", "item_id", "quantity_wasted")
    before = s.select(F.date_add("business_date", 7).alias("business_date"), "item_id", F.col("quantity_wasted").alias("last_week"))
    return s.join(before, ["business_date", "item_id"], "left").withColumn("change", F.col("quantity_wasted") - F.col("last_week"))


@twin("j16_alias_resolution", "WITH al AS (SELECT * FROM (VALUES ('LARGE', 'BIG'), ('SMALL', 'BIG'), ('PROMO', 'OFFER')) AS t(raw, canon)) SELECT coalesce(canon, p_type) AS item_key, count(*) AS parts, count(DISTINCT p_type) AS raw_names FROM part LEFT JOIN al ON raw = p_type GROUP BY 1")
def _(spark, d):
    alias = spark.sql("select * from values ('LARGE', 'BIG'), ('SMALL', 'BIG'), ('PROMO', 'OFFER') as t(raw, canon)")
    p = table(spark, d, "part").join(F.broadcast(alias), F.col("p_type") == F.col("raw"), "left")
    return p.groupBy(F.coalesce("canon", "p_type").alias("item_key")).agg(F.count("*").alias("parts"), F.countDistinct("p_type").alias("raw_names"))


@twin("agg5_job_health", "WITH j AS (SELECT event_type AS job, ts AS started_at, CASE WHEN user_id % 7 = 0 THEN 'error' ELSE 'ok' END AS status, 'm' || event_id AS message FROM events) SELECT job, max(started_at) AS last_attempt, max(started_at) FILTER (WHERE status = 'ok') AS last_ok, max_by(message, (started_at, message)) FILTER (WHERE status = 'error') AS last_error FROM j GROUP BY 1")
def _(spark, d):
    j = table(spark, d, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("started_at"), (F.col("user_id") % 7 == 0).alias("bad"), F.concat(F.lit("m"), F.col("event_id")).alias("message"))
    return j.groupBy("job").agg(F.max("started_at").alias("last_attempt"), F.max(F.when(~F.col("bad"), F.col("started_at"))).alias("last_ok"), F.max(F.when(F.col("bad"), F.struct("started_at", "message"))).getField("message").alias("last_error"))


@twin("agg19_item_rollup", f"WITH {LOG} SELECT item_id, count(DISTINCT business_date) AS days_present, min(business_date) AS first_seen, max(business_date) AS last_seen, sum(quantity) FILTER (WHERE entry_type = 'made') AS total_made, sum(quantity) FILTER (WHERE entry_type = 'waste') AS total_wasted, round(sum(quantity) FILTER (WHERE entry_type = 'waste') / nullif(sum(quantity) FILTER (WHERE entry_type IN ('made', 'refill')), 0), 6) AS waste_rate, array_to_string(list_sort(list(DISTINCT entry_type)), ' | ') AS kinds FROM cur GROUP BY 1")
def _(spark, d):
    q, k = F.col("quantity"), F.col("entry_type")
    of = lambda *kinds: F.sum(F.when(k.isin(*kinds), q))
    return current(spark, d).groupBy("item_id").agg(
        F.countDistinct("business_date").alias("days_present"), F.min("business_date").alias("first_seen"), F.max("business_date").alias("last_seen"), of("made").alias("total_made"),
        of("waste").alias("total_wasted"), F.round(of("waste") / F.nullif(of("made", "refill"), F.lit(0.0)), 6).alias("waste_rate"), F.array_join(F.array_sort(F.collect_set(k)), " | ").alias("kinds"),
    )


@twin("agg25_weekday_median_template", f"WITH {OBS}, r AS (SELECT item, dow, supply FROM obs QUALIFY row_number() OVER (PARTITION BY item, dow ORDER BY d DESC) <= 12) SELECT item, dow, round_even(median(supply), 0)::BIGINT AS qty FROM r GROUP BY 1, 2")
def _(spark, d):
    nth = F.row_number().over(Window.partitionBy("item", "dow").orderBy(F.col("d").desc()))
    return observations(spark, d).withColumn("nth", nth).where("nth <= 12").groupBy("item", "dow").agg(F.bround(F.median("supply"), 0).cast("long").alias("qty"))


@twin("agg31_rollup_week_month", f"WITH {OBS} SELECT month(d) AS m, week(d) AS w, sum(sold) AS sold FROM obs GROUP BY ROLLUP (month(d), week(d))")
def _(spark, d):
    return observations(spark, d).withColumns({"m": F.month("d"), "w": F.weekofyear("d")}).rollup("m", "w").agg(F.sum("sold").alias("sold")).select("m", "w", "sold")


@twin("flt2_active_items", f"WITH {LOG} SELECT item_id, max(business_date) AS last_seen FROM log WHERE item_id % 3 <> 0 OR business_date < DATE '2024-01-05' GROUP BY 1 HAVING max(business_date) >= (SELECT max(business_date) FROM log) - 21")
def _(spark, d):
    rows = log(spark, d).where("item_id % 3 <> 0 or business_date < date'2024-01-05'")
    newest = log(spark, d).agg(F.max("business_date").alias("newest"))
    return rows.groupBy("item_id").agg(F.max("business_date").alias("last_seen")).join(F.broadcast(newest), F.col("last_seen") >= F.date_sub("newest", 21)).select("item_id", "last_seen")


@twin("flt3_active_menu", f"WITH {OBS}, l AS (SELECT item, max(d) AS last_seen FROM obs WHERE item <> 'SMALL' OR d < DATE '2000-01-01' GROUP BY 1) SELECT item, last_seen FROM l WHERE last_seen >= (SELECT max(last_seen) - 28 FROM l)")
def _(spark, d):
    seen = observations(spark, d).where("item <> 'SMALL' or d < date'2000-01-01'").groupBy("item").agg(F.max("d").alias("last_seen"))
    return seen.withColumn("newest", F.max("last_seen").over(Window.partitionBy())).where(F.col("last_seen") >= F.date_sub("newest", 28)).select("item", "last_seen")


@twin("flt1_window_filter", f"WITH {OBS}, m AS (SELECT max(d) AS hi FROM obs) SELECT item, count(*) AS n, sum(sold) AS sold FROM obs, m WHERE d BETWEEN hi - 29 AND hi GROUP BY 1")
def _(spark, d):
    o = observations(spark, d)
    newest = o.agg(F.max("d").alias("hi"))
    return o.join(F.broadcast(newest), F.col("d").between(F.date_sub("hi", 29), F.col("hi"))).groupBy("item").agg(F.count("*").alias("n"), F.sum("sold").alias("sold"))


@twin("flt5_name_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('D W'))")
def _(spark, d):
    return table(spark, d, "part").where(F.lower("p_name").contains(F.lower(F.lit("D W")))).select("p_partkey", "p_name")


@twin("flt6_row_level_security", "SELECT event_id, user_id FROM events WHERE user_id = 7")
def _(spark, d):
    return table(spark, d, "events").where(F.col("user_id") == 7).select("event_id", "user_id")


@twin("flt7_quarantine", f"WITH {LOG} SELECT entry_id, CASE WHEN entry_type NOT IN ('made', 'refill', 'waste') THEN 'kind' WHEN quantity < 5 THEN 'range' END AS problem FROM log WHERE entry_type NOT IN ('made', 'refill', 'waste') OR quantity < 5")
def _(spark, d):
    problem = F.when(~F.col("entry_type").isin("made", "refill", "waste"), "kind").when(F.col("quantity") < 5, "range")
    return log(spark, d).withColumn("problem", problem).where("problem is not null").select("entry_id", "problem")


@twin("src18_srt6_cursor_page", "SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 0) ORDER BY ts, event_id LIMIT 500")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    return e.where("ts > timestamp'2024-01-10' or (ts = timestamp'2024-01-10' and event_id > 0)").orderBy("ts", "event_id").limit(500)


@twin("snk5_idempotent_load", f"WITH {LOG}, old AS (SELECT sha256(concat_ws('|', business_date::VARCHAR, item_id::VARCHAR, entry_type)) AS h FROM log WHERE entry_id % 2 = 0) SELECT substr(sha256(concat_ws('|', business_date::VARCHAR, item_id::VARCHAR, entry_type)), 1, 16) AS value_hash, count(*) AS n FROM log WHERE NOT EXISTS (SELECT 1 FROM old WHERE h = sha256(concat_ws('|', business_date::VARCHAR, item_id::VARCHAR, entry_type))) GROUP BY 1")
def _(spark, d):
    rows = log(spark, d).withColumn("value_hash", F.substring(F.sha2(F.concat_ws("|", F.col("business_date").cast("string"), F.col("item_id").cast("string"), "entry_type"), 256), 1, 16))
    return rows.join(rows.where("entry_id % 2 = 0").select("value_hash"), "value_hash", "left_anti").groupBy("value_hash").agg(F.count("*").alias("n"))


@twin("prj17_value_hash", f"WITH {LOG} SELECT entry_id, substr(sha256(business_date::VARCHAR || '|' || item_id || '|' || entry_type || '|' || quantity::BIGINT || '.0'), 1, 16) AS value_hash FROM log")
def _(spark, d):
    text = F.concat_ws("|", F.col("business_date").cast("string"), F.col("item_id").cast("string"), "entry_type", F.col("quantity").cast("string"))
    return log(spark, d).select("entry_id", F.substring(F.sha2(text, 256), 1, 16).alias("value_hash"))


@twin("prj18_seed_ids", f"WITH {LOG} SELECT entry_id, concat_ws(':', 'seed', business_date::VARCHAR, item_id::VARCHAR, entry_type) AS id FROM log")
def _(spark, d):
    return log(spark, d).select("entry_id", F.concat_ws(":", F.lit("seed"), F.col("business_date").cast("string"), F.col("item_id").cast("string"), "entry_type").alias("id"))


@twin("srt1_srt7_sorted_day_sheet", f"{SALES} SELECT business_date, item_id, row_number() OVER (PARTITION BY business_date ORDER BY coalesce(CASE WHEN demand_censored THEN NULL ELSE quantity_wasted END, -1) DESC, quantity_made + quantity_refill DESC, item_id) AS place FROM sales")
def _(spark, d):
    left = F.coalesce(F.when(~F.col("demand_censored"), F.col("quantity_wasted")), F.lit(-1.0))
    order = Window.partitionBy("business_date").orderBy(left.desc(), (F.col("quantity_made") + F.col("quantity_refill")).desc(), "item_id")
    return O.sales(current(spark, d)).select("business_date", "item_id", F.row_number().over(order).alias("place"))


@twin("srt2_win15_sheet_order", "WITH o AS (SELECT * FROM (VALUES ('PROMO', 1), ('LARGE', 2)) AS t(item, r)) SELECT p_type AS item, row_number() OVER (ORDER BY coalesce(r, 2147483647), p_type) AS place FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN o ON item = p_type")
def _(spark, d):
    order = spark.sql("select * from values ('PROMO', 1), ('LARGE', 2) as t(item, r)")
    items = table(spark, d, "part").select(F.col("p_type").alias("item")).distinct().join(F.broadcast(order), "item", "left")
    return items.select("item", F.row_number().over(Window.orderBy(F.coalesce("r", F.lit(2147483647)), "item")).alias("place"))


@twin("dom45_unpivot_blank_makes_no_row", f"WITH {OBS}, u AS (SELECT d, item, unnest(['made', 'refill', 'waste', 'sold']) AS entry_type, unnest([made, refill, nullif(wasted, 0), sold]) AS quantity FROM obs) SELECT d, item, entry_type, quantity::BIGINT AS quantity FROM u WHERE quantity IS NOT NULL")
def _(spark, d):
    o = observations(spark, d).withColumn("w", F.nullif("wasted", F.lit(0)))
    return o.selectExpr("d", "item", "stack(4, 'made', made, 'refill', refill, 'waste', w, 'sold', sold) as (entry_type, quantity)").where("quantity is not null")


@twin("hlp20_gap_runs", f"{SALES}, dd AS (SELECT business_date AS d, item_id, row_number() OVER (PARTITION BY item_id ORDER BY business_date) AS n FROM sales WHERE (day(business_date) + item_id) % 4 <> 0), g AS (SELECT item_id, d, date_diff('day', DATE '2024-01-01', d) - n AS grp FROM dd) SELECT item_id, min(d) AS first_day, max(d) AS last_day, count(*) AS days FROM g GROUP BY item_id, grp")
def _(spark, d):
    s = O.sales(current(spark, d)).where("(day(business_date) + item_id) % 4 <> 0").select("item_id", F.col("business_date").alias("d"))
    island = F.datediff("d", F.lit("2024-01-01").cast("date")) - F.row_number().over(Window.partitionBy("item_id").orderBy("d"))
    return s.withColumn("island", island).groupBy("item_id", "island").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days")).drop("island")
