"""Queries: text cleaning, typed-in quantities, cells of sheets, transcripts, nested data and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crumbline.functions import scalars as S
from crumbline.operators import etl as E
from crumbline.operators import workbook as B
from crumbline.sources.adapter import OBS, observations, table

from .registry import twin

# ------------------------------------------------------------------ scalars --


@twin("txt1_norm", r"SELECT doc_id, coalesce(lower(trim(regexp_replace(replace(text, chr(160), ' '), '\s+', ' ', 'g'))), '') AS key FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", S.norm(F.col("text")).alias("key"))


@twin("txt8_hygiene_variants", r"SELECT lower(trim(regexp_replace(w, '[^\pL]+', '', 'g'))) AS key, count(DISTINCT w) AS variants, array_to_string(list_sort(list(DISTINCT w)), ' | ') AS names FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1 HAVING count(DISTINCT w) > 1 AND key <> ''")
def _(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct()  # different spellings, before they are collected
    key = F.lower(F.trim(F.regexp_replace("w", r"[^\p{L}]+", "")))
    g = w.groupBy(key.alias("key")).agg(F.collect_set("w").alias("s")).where((F.size("s") > 1) & (F.col("key") != ""))
    return g.select("key", F.size("s").cast("long").alias("variants"), F.array_join(F.array_sort("s"), " | ").alias("names"))


QTY = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN '  ' || user_id || ' [out by ' || event_id % 12 || 'pm]' WHEN 3 THEN 'none left' WHEN 4 THEN user_id || '.5' ELSE '-' || user_id || ' (sic)' END AS v FROM events)"


@twin("txt2_parse_qty", rf"SELECT event_id, try_cast(nullif(num, '') AS DOUBLE) AS qty, CASE WHEN t = '' THEN NULL WHEN num <> '' THEN nullif(trim(trim(substr(t, length(num) + 1)), '[]()'), '') ELSE t END AS note, CASE WHEN t = '' THEN NULL WHEN num = '' THEN 'no number' WHEN trim(substr(t, length(num) + 1)) <> '' THEN 'number with text' END AS problem FROM (SELECT event_id, trim(v) AS t, regexp_extract(trim(v), '^[-]?[0-9]+([.][0-9]+)?') AS num FROM {QTY})")
def _(spark, d):
    e, n = F.col("event_id"), F.col("user_id").cast("string")
    v = F.when(e % 6 == 0, "").when(e % 6 == 1, n).when(e % 6 == 2, F.concat(F.lit("  "), n, F.lit(" [out by "), e % 12, F.lit("pm]"))).when(e % 6 == 3, "none left").when(e % 6 == 4, F.concat(n, F.lit(".5"))).otherwise(F.concat(F.lit("-"), n, F.lit(" (sic)")))
    return table(spark, d, "events").select("event_id", S.parse_qty(v).alias("q")).select("event_id", "q.*")


@twin("txt3_src15_strip_comment", "SELECT page_id, trim(split_part(url, '#', 1)) AS url FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", S.strip_comment(F.col("url")).alias("url"))


@twin("txt4_ordinal_pct", "SELECT event_id, (user_id % 130)::VARCHAR || CASE WHEN user_id % 130 % 100 BETWEEN 10 AND 20 THEN 'th' WHEN user_id % 10 = 1 THEN 'st' WHEN user_id % 10 = 2 THEN 'nd' WHEN user_id % 10 = 3 THEN 'rd' ELSE 'th' END AS nth, round_even(100 * ((user_id % 200) / 200e0), 0)::BIGINT || '%' AS share FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.ordinal(F.col("user_id") % 130).alias("nth"), S.pct((F.col("user_id") % 200) / 200.0).alias("share"))


@twin("txt5_money_formats", "SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN '−' ELSE '' END || '$' || format('{:,}', abs(v)) AS usd, CASE WHEN v < 0 THEN '−' ELSE '' END || '$' || abs(v) AS plain FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice - 30000 + 0.5e0)::BIGINT AS v FROM lineitem)")
def _(spark, d):
    x = F.col("l_extendedprice") - 30000
    v = S.round_half_up(x)
    plain = F.concat(F.when(v < 0, "−").otherwise(""), F.lit("$"), F.abs(v).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.usd(x).alias("usd"), plain.alias("plain"))


@twin("txt5_usd_short_share", "SELECT event_id, CASE WHEN v < 0 THEN '−' ELSE '' END || CASE WHEN abs(v) >= 10000 THEN '$' || round(abs(v) / 1000e0)::BIGINT || 'k' WHEN abs(v) >= 1000 THEN '$' || printf('%.1f', round(abs(v) / 1000e0, 1)) || 'k' ELSE '$' || abs(v) END AS short, CASE WHEN user_id % 9 = 0 THEN '—' ELSE floor(100e0 * (event_id % 50) / (user_id % 9) + 0.5e0)::BIGINT || '%' END AS share FROM (SELECT *, (event_id * 37 % 30001) - 9000 AS v FROM events)")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.usd_short((F.col("event_id") * 37 % 30001) - 9000).alias("short"), S.share(F.col("event_id") % 50, F.col("user_id") % 9).alias("share"))


@twin("txt6_7_formulas", r"SELECT event_id, regexp_replace(regexp_replace(f, '\$?[A-Z]{1,3}\$?\d+', '<ref>', 'g'), '\d+(?:\.\d+)?', '<n>', 'g') AS shape, list_sort(['May ' || event_id % 28, 'Totals']) AS sheets FROM (SELECT event_id, '=SUM(B' || user_id || ':$C$9)*1.25+''May ' || event_id % 28 || '''!A1-Totals!B2+AB!C3' AS f FROM events)")
def _(spark, d):
    f = F.concat(F.lit("=SUM(B"), "user_id", F.lit(":$C$9)*1.25+'May "), F.col("event_id") % 28, F.lit("'!A1-Totals!B2+AB!C3"))
    return table(spark, d, "events").select("event_id", S.formula_shape(f).alias("shape"), S.sheet_references(f).alias("sheets"))


@twin("txt9_zip_problem", r"SELECT event_id, CASE event_id % 7 WHEN 4 THEN 'too short: 2 of 5 digits' WHEN 2 THEN 'too long: 7 digits, perhaps 12345' WHEN 3 THEN 'not a postal code of 5 digits' WHEN 5 THEN 'a dash is missing: 12345-6789' END AS problem FROM events")
def _(spark, d):
    v = F.element_at(F.array(*[F.lit(x) for x in (" 60601 ", "60601-4567", "1234567", "12-34", "12", "123456789", "Chicago")]), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", S.zip_problem(v).alias("problem"))


@twin("txt10_dom28_alert_text", "SELECT event_type AS job, 'job ' || event_type || ' had ' || count(*) || ' rows' AS message FROM events GROUP BY 1")
def _(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("job")).agg(F.count("*").cast("string").alias("n"))
    return g.select("job", F.replace(F.replace(F.lit("job {job} had {n} rows"), F.lit("{job}"), F.col("job")), F.lit("{n}"), F.col("n")).alias("message"))


@twin("txt11_host_predicate", "SELECT page_id, url LIKE '%//m.%' OR lower(split_part(split_part(url, '//', 2), '/', 1)) LIKE '%.example.net' AS throwaway FROM pages")
def _(spark, d):
    host = F.lower(F.substring_index(F.element_at(F.split("url", "//"), 2), "/", 1))
    return table(spark, d, "pages").select("page_id", (F.col("url").contains("//m.") | host.endswith(".example.net")).alias("throwaway"))


@twin("dat1_6_date_parts", f"WITH {OBS} SELECT DISTINCT d, isodow(d)::INT AS dow, (d + 9) AS plus9, (d - 21) AS weeks_back3, date_trunc('week', d)::DATE AS week_start, last_day(d) AS month_end, round(date_diff('day', DATE '1995-01-01', d) / 7e0, 6) AS weeks, floor((date_diff('day', DATE '0001-01-01', d) + 1) / 7)::BIGINT AS bucket, dayname(d) AS weekday_name FROM obs")
def _(spark, d):
    x = observations(spark, d).select("d").distinct()
    return x.select(
        "d", (F.weekday("d") + 1).cast("int").alias("dow"), F.date_add("d", 9).alias("plus9"), F.date_sub("d", 21).alias("weeks_back3"), F.to_date(F.date_trunc("week", "d")).alias("week_start"), F.last_day("d").alias("month_end"),
        F.round(S.weeks_between(F.lit("1995-01-01").cast("date"), F.col("d")), 6).alias("weeks"), S.refit_bucket(F.col("d")).alias("bucket"), F.date_format("d", "EEEE").alias("weekday_name"),
    )


@twin("dat3_business_date", "SELECT event_id, (ts - INTERVAL 3 HOUR)::DATE AS business_date FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.business_date(F.col("ts")).alias("business_date"))


@twin("dat7_8_timestamps", "SELECT event_id, ts::DATE + INTERVAL 10 HOUR AS made_at, ts::DATE + INTERVAL 16 HOUR AS refill_at, ts::DATE + INTERVAL 36 HOUR AS waste_at FROM events")
def _(spark, d):
    day = F.to_date("ts").cast("timestamp_ntz")
    plus = lambda h: day + F.make_dt_interval(F.lit(0), F.lit(h))
    return table(spark, d, "events").select("event_id", plus(10).alias("made_at"), plus(16).alias("refill_at"), plus(36).alias("waste_at"))


@twin("mth1_rounding", "SELECT event_id, floor(value + 0.5e0)::BIGINT AS half_up, round_even(user_id / 2e0, 0)::BIGINT AS half_even FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", S.round_half_up(F.col("value")).alias("half_up"), F.bround(F.col("user_id") / 2.0, 0).cast("long").alias("half_even"))


@twin("mth2_recency_weight", "SELECT event_id, round(power(0.5e0, (user_id % 60) / 21e0) * CASE WHEN event_id % 7 = 0 THEN 1e0 ELSE 0.3e0 END, 9) AS w FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(S.recency_weight(F.col("user_id") % 60, F.col("event_id") % 7 == 0), 9).alias("w"))


@twin("mth3_beta_tail", f"""WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY item, dow ORDER BY d DESC) AS n FROM obs),
k AS (SELECT item, dow, 1 + count(*) FILTER (WHERE censored) AS a, 1 + count(*) FILTER (WHERE NOT censored) AS b FROM n WHERE n <= 8 GROUP BY 1, 2)
SELECT item, dow, x, round(list_sum(list_transform(range(0, a), lambda i: exp(lgamma(a + b) - lgamma(i + 1) - lgamma(a + b - i)) * power(x, i) * power(1 - x, a + b - 1 - i))), 9) AS tail
FROM k, (SELECT unnest([0.137e0, 0.351e0, 0.523e0, 0.871e0]) AS x)""")
def _(spark, d):
    """How sure it is that an item sells out more often than x on a weekday, from the last eight of them."""
    n = F.row_number().over(Window.partitionBy("item", "dow").orderBy(F.col("d").desc()))
    k = observations(spark, d).withColumn("n", n).where("n <= 8").groupBy("item", "dow").agg((1 + F.count_if("censored")).alias("a"), (1 + F.count_if(~F.col("censored"))).alias("b"))
    k = k.withColumn("x", F.explode(F.array(*[F.lit(x) for x in (0.137, 0.351, 0.523, 0.871)])))
    return k.select("item", "dow", "x", F.round(S.beta_tail(F.col("a"), F.col("b"), F.col("x")), 9).alias("tail"))


@twin("mth4_dom37_thinned_ladder", f"""WITH {OBS}, l AS (SELECT item, sold, count(*)::DOUBLE AS n FROM obs GROUP BY 1, 2), p AS (SELECT item, sold AS dd, n / sum(n) OVER (PARTITION BY item) AS pr FROM l), k AS (SELECT unnest(range(1, 6)) AS k),
bt AS (SELECT item, k, pr, list_sum(list_transform(range(k, greatest(k, dd + 1)), lambda j: exp(lgamma(dd + 1) - lgamma(j + 1) - lgamma(dd - j + 1)) * power(0.7e0, j) * power(0.3e0, dd - j))) AS t FROM p, k WHERE dd >= k)
SELECT item, k, round(sum(pr * t), 6) AS s FROM bt GROUP BY 1, 2""")
def _(spark, d):
    """Chance that the k-th unit sells when each wish is dropped with 30 %: binomial tails over the distribution of demand."""
    n = observations(spark, d).groupBy("item", F.col("sold").alias("dd")).agg(F.count("*").cast("double").alias("n"))
    p = n.withColumn("pr", F.col("n") / F.sum("n").over(Window.partitionBy("item")))
    x = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(5)))).where("dd >= k")
    zero = F.struct(F.pow(F.lit(0.3), "dd").alias("term"), F.lit(0.0).alias("below"))

    def step(acc, j):
        return F.struct((acc["term"] * (F.col("dd") - j) / (j + 1.0) * (0.7 / 0.3)).alias("term"), (acc["below"] + acc["term"]).alias("below"))

    tail = 1.0 - F.aggregate(F.sequence(F.lit(0), F.col("k") - 1), zero, step, lambda a: a["below"])
    return x.groupBy("item", F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.col("pr") * tail), 6).alias("s"))


@twin("mth6_interpolation", "SELECT event_id, round(CASE WHEN x <= 0.55e0 THEN 2e0 WHEN x >= 0.85e0 THEN 9e0 WHEN x < 0.65e0 THEN 2 + (x - 0.55e0) * 10 WHEN x < 0.75e0 THEN 3 + (x - 0.65e0) * 20 ELSE 5 + (x - 0.75e0) * 40 END, 6) AS y FROM (SELECT event_id, (user_id % 101) / 100e0 AS x FROM events)")
def _(spark, d):
    x = (F.col("user_id") % 101) / 100.0
    y = F.when(x <= 0.55, 2.0).when(x >= 0.85, 9.0).when(x < 0.65, 2 + (x - 0.55) * 10).when(x < 0.75, 3 + (x - 0.65) * 20).otherwise(5 + (x - 0.75) * 40)
    return table(spark, d, "events").select("event_id", F.round(y, 6).alias("y"))


@twin("mth7_8_losses", f"WITH {OBS}, f AS (SELECT *, avg(sold) OVER (PARTITION BY item ORDER BY d ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS m, greatest(0.5e0, m) AS r FROM obs) SELECT item, round(avg(greatest(0.75e0 * (sold - r), -0.25e0 * (sold - r))), 6) AS pinball, round(avg(power(sold - r, 2) / r), 6) AS dispersion FROM f WHERE m IS NOT NULL GROUP BY 1")
def _(spark, d):
    w = Window.partitionBy("item").orderBy("d").rowsBetween(-14, -1)
    f = observations(spark, d).withColumn("m", F.avg("sold").over(w)).where("m is not null").withColumn("r", F.greatest(F.lit(0.5), "m"))
    e = F.col("sold") - F.col("r")
    return f.groupBy("item").agg(F.round(F.avg(F.greatest(0.75 * e, -0.25 * e)), 6).alias("pinball"), F.round(F.avg(F.pow(e, 2.0) / F.col("r")), 6).alias("dispersion"))


@twin("mth9_poisson", f"""WITH {OBS}, r AS (SELECT item, avg(sold) AS m FROM obs GROUP BY 1)
SELECT item, k, round(CASE WHEN m > 0 THEN exp(k * ln(m) - m - lgamma(k + 1)) ELSE (k = 0)::INT::DOUBLE END, 9) AS pmf, round(ln(1 + m), 9) AS log1p FROM r, (SELECT unnest(range(0, 15)) AS k)""")
def _(spark, d):
    """Chances of each number of sales of an item in a day, were they Poisson around its mean."""
    r = observations(spark, d).groupBy("item").agg(F.avg("sold").alias("m")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))))
    up_to = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), "k"))
    pmf = F.exp(-F.col("m")) * F.aggregate(up_to, F.lit(1.0), lambda a, i: F.when(i <= F.col("k"), a * F.col("m") / i).otherwise(a))
    return r.select("item", "k", F.round(pmf, 9).alias("pmf"), F.round(F.log1p("m"), 9).alias("log1p"))


@twin("arr1_2_arrays", f"WITH {OBS}, l AS (SELECT item, list(sold ORDER BY d DESC)[1:5] AS last5 FROM obs GROUP BY 1) SELECT item, last5::BIGINT[] AS last5, len(list_filter(last5, lambda v: v > 2)) AS above2, list_sum(last5)::BIGINT AS total, [(item = 'LARGE')::INT, (item = 'MEDIUM')::INT, (item = 'PROMO')::INT] AS one_hot FROM l")
def _(spark, d):
    n = F.row_number().over(Window.partitionBy("item").orderBy(F.col("d").desc()))
    g = observations(spark, d).withColumn("n", n).where("n <= 5").groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "sold"))), lambda x: x["sold"].cast("long")).alias("last5"))
    total = F.aggregate("last5", F.lit(0).cast("long"), lambda a, v: a + v)
    return g.select("item", "last5", F.size(F.filter("last5", lambda v: v > 2)).cast("long").alias("above2"), total.alias("total"), F.transform(F.array(*[F.lit(x) for x in ("LARGE", "MEDIUM", "PROMO")]), lambda x: (x == F.col("item")).cast("int")).alias("one_hot"))


@twin("map1_template_quantities", f"WITH {OBS}, q AS (SELECT dow, item, floor(avg(supply) + 0.5e0)::BIGINT AS qty FROM obs GROUP BY 1, 2) SELECT dow, max(qty) FILTER (WHERE item = 'LARGE') AS large, count(*) FILTER (WHERE qty > 3) AS big_items FROM q GROUP BY 1")
def _(spark, d):
    q = observations(spark, d).groupBy("dow", "item").agg(S.round_half_up(F.avg("supply")).alias("qty"))
    m = q.groupBy("dow").agg(F.map_from_entries(F.collect_list(F.struct("item", "qty"))).alias("m"))
    return m.select("dow", F.col("m")["LARGE"].alias("large"), F.size(F.map_filter("m", lambda k, v: v > 3)).cast("long").alias("big_items"))


@twin("jsn1_json_round_trip", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.k')::BIGINT * 2 AS twice FROM events")
def _(spark, d):
    p = F.from_json("props", "k bigint")
    back = F.from_json(F.to_json(F.struct((p["k"] * 2).alias("k"))), "k bigint")["k"]
    return table(spark, d, "events").select("event_id", p["k"].alias("k"), back.alias("twice"))


@twin("jsn2_settings_merge", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN user_id ELSE 180 END::BIGINT AS training_window, CASE WHEN user_id % 3 = 0 THEN user_id ELSE 28 END::BIGINT AS baseline_window FROM events")
def _(spark, d):
    own = F.map_from_entries(F.array_compact(F.array(F.when(F.col("user_id") % 2 == 0, F.struct(F.lit("training_window"), F.col("user_id"))), F.when(F.col("user_id") % 3 == 0, F.struct(F.lit("baseline_window"), F.col("user_id"))))))
    default = F.create_map(F.lit("training_window"), F.lit(180).cast("long"), F.lit("baseline_window"), F.lit(28).cast("long"))
    merged = F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(own, k)), own)
    return table(spark, d, "events").select("event_id", merged["training_window"].alias("training_window"), merged["baseline_window"].alias("baseline_window"))


# ---------------------------------------------------------------- documents --


@twin("agg21_hlp7_duplicate_groups", "SELECT substr(md5(text), 1, 12) AS fingerprint, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) >= 2")
def _(spark, d):
    g = table(spark, d, "documents").groupBy(F.substring(F.md5("text"), 1, 12).alias("fingerprint"))
    return g.agg(F.count("*").alias("members"), F.min("doc_id").alias("first_id")).where("members >= 2")


@twin("agg20_hlp8_type_census", "WITH c AS (SELECT event_id % 4 AS col, CASE WHEN v = '' THEN 'empty' WHEN try_cast(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.') THEN 'int' WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS kind FROM " + QTY + "), g AS (SELECT col, kind, count(*) AS n FROM c GROUP BY 1, 2) SELECT col, kind, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, kind) AS place FROM g")
def _(spark, d):
    e, n = F.col("event_id"), F.col("user_id").cast("string")
    v = F.when(e % 6 == 0, "").when(e % 6 == 1, n).when(e % 6 == 2, F.concat(F.lit("  "), n, F.lit(" [out]"))).when(e % 6 == 3, "none left").when(e % 6 == 4, F.concat(n, F.lit(".5"))).otherwise(F.concat(F.lit("-"), n, F.lit(" (sic)")))
    g = table(spark, d, "events").groupBy((e % 4).alias("col"), E.value_kind(v).alias("kind")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("col").orderBy(F.col("n").desc(), "kind")))


@twin("src5_6_header_cells", "WITH c AS (SELECT conv_id AS sheet, turn AS r, (turn * 3 + conv_id) % 5 AS c, CASE WHEN turn = conv_id % 3 THEN ' Items ' ELSE role END AS v FROM conversations) SELECT h.sheet, h.r AS header_row, h.c AS header_col, b.v AS below FROM c h LEFT JOIN c b ON b.sheet = h.sheet AND b.r = h.r + 1 WHERE lower(trim(h.v)) = 'items'")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("sheet"), F.col("turn").alias("r"), ((F.col("turn") * 3 + F.col("conv_id")) % 5).alias("c"), F.when(F.col("turn") == F.col("conv_id") % 3, " Items ").otherwise(F.col("role")).alias("v"))
    return E.header_with_below(c, "items")


@twin("src7_hlp9_line_dsl", "SELECT conv_id AS doc, turn AS line, CASE WHEN role = 'user' THEN 'DAY' ELSE 'ROW' END AS kind, count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def _(spark, d):
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("line"), F.when(F.col("role") == "user", "DAY").otherwise("ROW").alias("kind"))
    return E.with_sections(lines, F.col("kind") == "DAY", ["doc"], "line")


@twin("src7_hlp9_transcripts", f"WITH {OBS}, c AS (SELECT d, item, supply, wasted, bool_or(wasted > 0) OVER (PARTITION BY d) AS counted FROM obs) SELECT d, item, supply AS made, CASE WHEN counted THEN wasted END AS wasted, CASE WHEN counted THEN greatest(0, supply - wasted) END AS sold, counted AND wasted = 0 AS censored FROM c")
def _(spark, d):
    """Each month of the record typed off as a sheet, waste of nothing left blank, and read again."""
    o = observations(spark, d)
    menu = o.groupBy().agg(F.array_sort(F.collect_set("item")).alias("menu"))
    pair = F.concat_ws("/", F.col("supply").cast("string"), F.when(F.col("wasted") > 0, F.col("wasted").cast("string")).otherwise("."))
    days = o.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("item", pair))).alias("m"), F.sum("supply").alias("made"), F.sum("wasted").alias("waste")).join(F.broadcast(menu), F.lit(True))
    head = F.format_string("DAY %s %d %d %d 0.00  # typed off", F.col("d").cast("string"), F.col("made"), F.col("waste"), F.col("made") - F.col("waste"))
    cells = F.array_join(F.transform("menu", lambda i: F.coalesce(F.element_at("m", i), F.lit("./."))), " ")
    months = days.groupBy(F.date_trunc("month", "d").alias("doc")).agg(F.first("menu").alias("menu"), F.array_sort(F.collect_list(F.struct("d", F.array(head, cells).alias("x")))).alias("days"))
    text = F.concat(F.array(F.lit("ITEMS")), "menu", F.array(F.lit("END"), F.lit("")), F.flatten(F.transform("days", lambda x: x["x"])))
    rows = E.transcript_rows(E.transcript(months.select("doc", F.posexplode(text).alias("no", "line"))))
    return rows.select("d", "item", *[F.col(c).cast("long").alias(c) for c in ("made", "wasted", "sold")], "censored")


@twin("src9_nested_json_templates", f"WITH {OBS} SELECT dow, item, max(supply)::INT AS qty FROM obs GROUP BY 1, 2")
def _(spark, d):
    """Templates as files have them, one JSON object per weekday, made from the most that was supplied, and read back."""
    most = observations(spark, d).groupBy("dow", "item").agg(F.max("supply").cast("int").alias("qty"))
    by_day = most.groupBy("dow").agg(F.map_from_entries(F.collect_list(F.struct("item", "qty"))).alias("m"))
    return E.templates(by_day.select(F.to_json(F.create_map(F.col("dow").cast("string"), "m")).alias("json")))


@twin("src11_columnar_history", f"WITH {OBS}, r AS (SELECT d, item, made, refill, wasted FROM obs) SELECT d, item, unnest(['made', 'refill', 'waste']) AS entry_type, unnest([made, refill, wasted])::DOUBLE AS quantity FROM r")
def _(spark, d):
    o = observations(spark, d)
    return E.decoded_history(E.encoded_history(o))


@twin("src13_alert_feed", "SELECT event_type AS event, max(CASE user_id % 3 WHEN 0 THEN 'Severe' WHEN 1 THEN 'Moderate' ELSE 'Minor' END) FILTER (WHERE user_id % 3 = (SELECT min(user_id % 3) FROM events e2 WHERE e2.event_type = events.event_type AND event_id % 2 = 0)) AS severity FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("event"), (F.col("user_id") % 3).alias("rank"), F.when(F.col("event_id") % 2 == 0, "Actual").otherwise("Test").alias("status"))
    feed = e.groupBy().agg(F.to_json(F.struct(F.collect_set(F.struct("event", "rank", "status")).alias("features"))).alias("json"))
    return E.alerts(feed)


@twin("src14_fallback_lookup", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN n_name END, r_name) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    first = n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    second = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k2"), F.col("r_name").alias("b"))
    c = table(spark, d, "customer")
    x = c.join(F.broadcast(first), (F.col("c_nationkey") == F.col("k")) & (F.col("c_custkey") % 3 == 0), "left").join(F.broadcast(second), F.col("c_nationkey") == F.col("k2"), "left")
    return x.select("c_custkey", F.coalesce("a", "b").alias("place"))


@twin("src17_range_scan", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1997-02-01'")
def _(spark, d):
    x = table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1997-02-01'")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@twin("src20_markdown_tally", "SELECT event_id, event_type AS name, user_id::BIGINT AS n FROM events WHERE event_type <> 'view'")
def _(spark, d):
    row = F.concat(F.lit("| "), "event_id", F.lit(" | "), "event_type", F.lit(" | "), "user_id", F.lit(" |"))
    cells = F.transform(F.split(row, r"\|"), lambda c: F.trim(c))
    x = table(spark, d, "events").where("event_type <> 'view'").select(cells.alias("c"))
    return x.select(F.get("c", F.lit(1)).try_cast("long").alias("event_id"), F.get("c", F.lit(2)).alias("name"), F.get("c", F.lit(3)).try_cast("long").alias("n"))


@twin("src21_dom46_exceptions", "WITH c AS (SELECT event_id, v FROM " + QTY + r") SELECT event_id, 'no number' AS kind FROM c WHERE v <> '' AND NOT regexp_matches(v, '^\s*-?\d') UNION ALL SELECT event_id, 'whitespace' FROM c WHERE v <> trim(v) UNION ALL SELECT event_id, 'negative' FROM c WHERE v LIKE '-%'")
def _(spark, d):
    e, n = F.col("event_id"), F.col("user_id").cast("string")
    v = F.when(e % 6 == 0, "").when(e % 6 == 1, n).when(e % 6 == 2, F.concat(F.lit("  "), n, F.lit(" [out]"))).when(e % 6 == 3, "none left").when(e % 6 == 4, F.concat(n, F.lit(".5"))).otherwise(F.concat(F.lit("-"), n, F.lit(" (sic)")))
    rules = F.array(
        F.when((v != "") & ~v.rlike(r"^\s*-?\d"), "no number"), F.when(v != F.trim(v), "whitespace"), F.when(v.startswith("-"), "negative")
    )  # one pass over the cells for all rules
    return table(spark, d, "events").select("event_id", F.explode(F.array_compact(rules)).alias("kind"))


BOOKS = """o AS (SELECT 'book ' || (l_orderkey % 8) AS book, l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)"""


def _books(spark, d):
    """Line items as workbooks: a sheet an order with amounts and a running sum, whose first cell reads the last one in every fifth order, and a sheet of totals. Gives the
    cells of orders, those of totals, and in how many partitions the former lie by book and sheet: lines are dealt so once, and Spark sees that what is asked by sheet needs no further shuffle."""
    lines = table(spark, d, "lineitem")
    # A partition takes about a quarter of a million lines, so that sorting their cells needs no disk.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() >> 18)
    k = F.col("l_orderkey")
    book, sheet = F.concat(F.lit("book "), k % 8), F.concat(F.lit("order "), k)
    x = lines.select(k, "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").repartition(n, book, sheet).withColumns({"book": book, "sheet": sheet})
    own = Window.partitionBy("book", "sheet")
    # The order takes all columns, so that every step asks for the same ones and they are shuffled once.
    order = own.orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    x = x.select("book", "sheet", k.alias("k"), "l_quantity", "l_extendedprice", (F.row_number().over(order) + 1).alias("r"), (F.count("*").over(own) + 1).alias("last"))
    first = F.when(F.col("k") % 5 == 0, F.concat(F.lit("=D"), "last", F.lit("+C2"))).otherwise("=C2")
    running = F.when(F.col("r") == 2, first).otherwise(F.concat(F.lit("=D"), F.col("r") - 1, F.lit("+$C"), "r"))
    one = lambda r, c, kind, v, f=F.lit(None): F.struct(r.alias("r"), F.lit(c).alias("c"), F.lit(kind).alias("kind"), v.cast("string").alias("v"), f.cast("string").alias("f"))
    r, head, none = F.col("r"), F.lit(1), F.lit(None)
    cells = F.array(
        one(r, 1, "number", F.col("l_quantity")), one(r, 2, "number", F.col("l_extendedprice")), one(r, 3, "blank", none, F.concat(F.lit("=A"), "r", F.lit("*B"), "r")), one(r, 4, "blank", none, running),
        one(head, 1, "text", F.lit("quantity")), one(head, 2, "text", F.lit("price")),
    )
    lines = x.select("book", "sheet", "r", F.explode(cells).alias("x")).where("r = 2 or x.r > 1").select("book", "sheet", "x.*")
    total = F.concat(F.lit("=SUM('order "), "k", F.lit("'!C2:$C$"), "last", F.lit(')&"C2"'))
    totals = x.where("r = 2").select("book", F.lit("Totals").alias("sheet"), one(F.col("k").cast("int"), 1, "blank", none, total).alias("x")).select("book", "sheet", "x.*")
    return lines, totals, n


@twin("src21_workbook_profile", f"WITH {BOOKS} SELECT book, 'order ' || k AS sheet, n + 1 AS last_row, 4 AS last_col, 0 AS blank_rows, 1::BIGINT AS ragged, 2 * n AS formulas, CASE WHEN k % 5 = 0 OR n = 1 THEN 2 ELSE 3 END::BIGINT AS shapes, 2 * n - CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS reads FROM o UNION ALL SELECT book, 'Totals', max(k), 1, max(k) - count(*), 0, count(*), 1, sum(n)::BIGINT FROM o GROUP BY 1")
def _(spark, d):
    orders, totals, n = _books(spark, d)
    f = lambda cells: B.shapes(cells).groupBy("book", "sheet").agg(F.sum("n").alias("formulas"), F.count("*").alias("shapes"))
    # Totals are long and few sheets: they are counted where they lie, and a row each joins those of orders. One row of each a sheet, side by side; a join would leave out sheets without a name.
    some = B.extents(totals).unionByName(f(totals), True).unionByName(B.reads(orders, n, totals), True)
    x = B.extents(orders).unionByName(f(orders), True).unionByName(some.repartition(n, "book", "sheet"), True)
    one = lambda c: F.max(c).alias(c)
    return x.groupBy("book", "sheet").agg(F.max("last_row").cast("long").alias("last_row"), *map(one, ("last_col", "blank_rows", "ragged", "formulas", "shapes", "reads")))


@twin("src21_circular_references", f"WITH {BOOKS} SELECT book, 'order ' || k AS sheet, 'D2' AS first_cell, n AS cells FROM o WHERE k % 5 = 0")
def _(spark, d):
    orders, totals, _ = _books(spark, d)
    at = B.cell_circles(orders.union(totals)).groupBy("circle").agg(F.count("*").alias("cells"))
    return at.select("circle.book", "circle.sheet", F.concat(B.letters(F.col("circle.c")), F.col("circle.r").cast("string")).alias("first_cell"), "cells")


@twin("src21_dom46_column_census", "WITH t AS (SELECT 'book ' || (l_orderkey % 8) AS book, count(*) AS n, count(DISTINCT l_orderkey) AS k FROM lineitem GROUP BY 1) SELECT book, unnest(['A', 'A', 'A', 'B', 'B', 'C', 'D']) AS col, unnest(['formula', 'number', 'text', 'number', 'text', 'formula', 'formula']) AS kind, unnest([k, n, k, n, k, n, n]) AS n FROM t")
def _(spark, d):
    orders, totals, _ = _books(spark, d)
    g = B.census(orders.union(totals)).groupBy("book", "c", "kind").agg(F.sum("n").alias("n"))
    return g.select("book", B.letters(F.col("c")).alias("col"), "kind", "n")


@twin("dom47_resent_days", f"WITH {OBS}, o AS (SELECT d, item, made FROM obs), n AS (SELECT d, item, CASE WHEN day(d) % 6 = 0 AND item = 'LARGE' THEN made + 1 ELSE made END AS made FROM obs WHERE NOT (day(d) % 10 = 0 AND item = 'SMALL')), f AS (SELECT coalesce(o.d, n.d) AS d, o.made IS DISTINCT FROM n.made AS differs FROM o FULL JOIN n ON o.d = n.d AND o.item = n.item) SELECT d, count(*) AS item_rows, count(*) FILTER (WHERE differs) AS changed, CASE WHEN bool_or(differs) THEN CASE WHEN day(d) % 12 = 0 THEN 'changed' ELSE 'blocked' END ELSE 'identical' END AS verdict FROM f GROUP BY 1")
def _(spark, d):
    o = observations(spark, d).select("d", "item", "made")
    n = o.where("not (day(d) % 10 = 0 and item = 'SMALL')").withColumn("made", F.when((F.dayofmonth("d") % 6 == 0) & (F.col("item") == "LARGE"), F.col("made") + 1).otherwise(F.col("made")))
    return E.resent_days(o, n, F.dayofmonth("d") % 12 == 0)


@twin("dom48_seed_reorder", "WITH o AS (SELECT * FROM (VALUES (3, 'LARGE'), (1, 'PROMO')) AS t(r, item)) SELECT p_type AS item, coalesce(r, 100 + row_number() OVER (ORDER BY p_type))::BIGINT AS sort_order FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN o ON item = p_type")
def _(spark, d):
    o = spark.sql("select * from values (3L, 'LARGE'), (1L, 'PROMO') as t(r, item)")
    items = table(spark, d, "part").select(F.col("p_type").alias("item")).distinct().join(F.broadcast(o), "item", "left")
    return items.select("item", F.coalesce("r", 100 + F.row_number().over(Window.orderBy("item"))).cast("long").alias("sort_order"))


@twin("snk9_merge_import", "WITH old AS (SELECT event_id FROM events WHERE event_id % 3 = 0), new AS (SELECT event_id, user_id FROM events WHERE event_id % 2 = 0) SELECT event_id, user_id FROM new WHERE event_id NOT IN (SELECT event_id FROM old)")
def _(spark, d):
    e = table(spark, d, "events")
    return e.where("event_id % 2 = 0").select("event_id", "user_id").join(e.where("event_id % 3 = 0").select("event_id"), "event_id", "left_anti")


@twin("str12_windowed_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
