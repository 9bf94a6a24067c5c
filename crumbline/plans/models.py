"""Queries that SQL can't express: fitted models and streams."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from crumbline.operators import fitted, pooled, seed
from crumbline.operators.economics import scored
from crumbline.shared import shared_dir
from crumbline.sources import loads
from crumbline.sources.adapter import LOG, log, table
from crumbline.streaming import mutations as M
from crumbline.streaming import replay

from .planning import eobs
from .registry import twin


@twin("dom5_6_7_quantile_regression_per_item")
def _(spark, d):
    return fitted.fitted_decisions(eobs(spark, d), fitted.item_quantiles)


@twin("dom8_quantile_regression_pooled")
def _(spark, d):
    return pooled.quantile_decisions(eobs(spark, d))


@twin("dom9_10_poisson_per_item")
def _(spark, d):
    return fitted.fitted_decisions(eobs(spark, d), fitted.item_poisson)


@twin("dom10_poisson_pooled")
def _(spark, d):
    return pooled.poisson_decisions(eobs(spark, d))


@twin("dom10_poisson_dispersion")
def _(spark, d):
    """Whether sales are as spread as the Poisson model says, for every week's fit."""
    return pooled.poisson_dispersion(eobs(spark, d))


#: Features that a pooled Poisson model has, to see what each is worth.
SUBSETS = {"level": ["level"], "level + weekday": ["level", *fitted.COLUMNS[2:]], "all": fitted.COLUMNS, "weekday": fitted.COLUMNS[2:]}


@twin("dom10_poisson_ablation")
def _(spark, d):
    """What the decisions of models with fewer features cost."""
    obs, out = eobs(spark, d), None
    for name, columns in SUBSETS.items():
        made = pooled.poisson_decisions(obs, columns).where("modelled").select("d", "item", "q")
        cost = scored(obs.join(made, ["d", "item"])).agg(F.lit(name).alias("features"), F.count("q").alias("decisions"), F.round(F.sum("cost_of_error"), 4).alias("total_cost"))
        out = cost if out is None else out.union(cost)
    return out


@twin("str1_4_stream_latest_wins", f"WITH {LOG} SELECT business_date, item_id, entry_type, quantity FROM cur")
def _(spark, d):
    """The whole log, each entry sent twice, drained through the stream; then the latest values from what it stored."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    work = (base.rstrip("/") + f"/stream-{spark.sparkContext.applicationId}-{id(object())}") if base else tempfile.mkdtemp(prefix="crumbline-stream-")
    e = log(spark, d)
    sent = e.select(F.lpad(F.col("entry_id").cast("string"), 12, "0").alias("mutation_id"), F.lit("entry").alias("kind"), "business_date", "item_id", "entry_type", "quantity", F.col("recorded_at").cast("timestamp").alias("received_at"))
    sent.union(sent).repartition(3).write.json(f"{work}/in")
    M.apply(M.read(spark, f"{work}/in"), f"{work}/store", f"{work}/checkpoint").awaitTermination()
    if not base:
        import atexit

        atexit.register(shutil.rmtree, work, True)
    return M.latest(spark.read.parquet(f"{work}/store")).select("business_date", "item_id", "entry_type", "quantity")


#: A log of mutations made from events: each event is one, its kind and payload follow its type; a signup is of a kind that nobody knows.
KINDS = {"entries": replay.Kind("item long, quantity double", many=True), "confirm": replay.Kind("user long, what string", ("user", "what")), "settings": replay.Kind("name string, value double", ("name",))}
MUTATIONS = """m AS (
  SELECT event_id, lpad(event_id::VARCHAR, 12, '0') AS mutation_id, ts, user_id, json_extract_string(props, '$.k')::DOUBLE AS k,
    CASE event_type WHEN 'view' THEN 'entries' WHEN 'click' THEN 'entries' WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'settings' ELSE 'signup' END AS kind
  FROM events
)"""


@twin(
    "str3_hlp19_typed_replay",
    f"""WITH {MUTATIONS}
SELECT 'entries' AS kind, mutation_id AS key, k AS value FROM m WHERE kind = 'entries'
UNION ALL SELECT 'confirm', user_id || ':' || (k::BIGINT % 2)::VARCHAR, arg_max(event_id, (ts, mutation_id))::DOUBLE FROM m WHERE kind = 'confirm' GROUP BY user_id, k::BIGINT % 2
UNION ALL SELECT 'settings', (user_id % 20)::VARCHAR, arg_max(k, (ts, mutation_id)) FROM m WHERE kind = 'settings' GROUP BY user_id % 20
UNION ALL SELECT 'rejected', kind, count(*)::DOUBLE FROM m WHERE kind = 'signup' GROUP BY kind""",
)
def _(spark, d):
    """All events as mutations, each sent twice, replayed by the stream: history of entries, the last mutation of every key of the other kinds, and how many
    nobody could read."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    kind = F.when(F.col("event_type").isin("view", "click"), "entries").when(F.col("event_type") == "purchase", "confirm").when(F.col("event_type") == "error", "settings").otherwise("signup")
    payload = (
        F.when(kind == "entries", F.to_json(F.array(F.struct((F.col("user_id") % 20).alias("item"), F.col("k").alias("quantity")))))
        .when(kind == "confirm", F.to_json(F.struct(F.col("user_id").alias("user"), (F.col("k").cast("long") % 2).cast("string").alias("what"))))
        .when(kind == "settings", F.to_json(F.struct((F.col("user_id") % 20).cast("string").alias("name"), F.col("k").alias("value"))))
        .otherwise("{}")
    )
    sent = e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("mutation_id"), kind.alias("kind"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("received_at"))
    work = f"{shared_dir(spark)}/replay-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    sent.union(sent).repartition(3).write.json(f"{work}/in")
    replay.replay(replay.read(spark, f"{work}/in"), f"{work}/out", f"{work}/checkpoint", KINDS).awaitTermination()
    of = lambda name: replay.table(spark, f"{work}/out", name, KINDS.get(name))
    row = lambda df, name, key, value: df.select(F.lit(name).alias("kind"), key.alias("key"), value.cast("double").alias("value"))
    bad = of(replay.REJECTED).groupBy("kind").agg(F.count("*").alias("n"))
    return (
        row(of("entries"), "entries", F.col("mutation_id"), F.col("quantity"))
        .union(row(of("confirm"), "confirm", F.concat_ws(":", "user", "what"), F.col("mutation_id")))
        .union(row(of("settings"), "settings", F.col("name"), F.col("value")))
        .union(row(bad, "rejected", F.col("kind"), F.col("n")))
    )


@twin(
    "str12_visits",
    """WITH g AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
v AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS visit FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM v GROUP BY user_id, visit""",
)
def _(spark, d):
    """Visits of users: events no more than six hours apart."""
    s = replay.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours", "1 day")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@twin(
    "str12_purchases_after_clicks",
    """SELECT c.event_id AS click, p.event_id AS purchase FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 2 DAY
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
)
def _(spark, d):
    """Pairs of a click and a purchase of the same user at most two days later."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    pairs = replay.followed(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "ts", "2 DAYS", "1 day")
    return pairs.select(F.col("first.event_id").alias("click"), F.col("then.event_id").alias("purchase"))


@twin(
    "snk5_snk9_audited_loads",
    """WITH c AS (SELECT * FROM customer), o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders), half AS (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 AS cut FROM o)
SELECT 'first' AS batch, 'customers' AS "table", count(*) AS sent, count(*) AS taken FROM c
UNION ALL SELECT 'first', 'orders', count(*), count(*) FROM o, half WHERE o_orderdate <= cut
UNION ALL SELECT 'second', 'customers', count(*), count(*) FILTER (WHERE c_acctbal < 0) FROM c
UNION ALL SELECT 'second', 'orders', count(*), count(*) FILTER (WHERE o_orderdate > cut) FROM o, half""",
)
def _(spark, d):
    """Two loads of customers and orders: the earlier half of the orders, then all of them again with the balances below 0 set to 0."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    half = o.agg((F.unix_micros(F.min("o_orderdate").cast("timestamp")) / 2 + F.unix_micros(F.max("o_orderdate").cast("timestamp")) / 2).alias("at"))
    early = o.join(F.broadcast(half), F.unix_micros(F.col("o_orderdate").cast("timestamp")) <= F.col("at")).drop("at")
    folder = f"{shared_dir(spark)}/loads-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    dim, fact = loads.Table(("c_custkey",), replaces=True), loads.Table(("o_orderkey",))
    loads.load(spark, folder, "first", "customer, orders", {"customers": (c, dim), "orders": (early, fact)})
    loads.load(spark, folder, "second", "customer, orders", {"customers": (c.withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0))), dim), "orders": (o, fact)})
    return loads.batches(spark, folder).select("batch", "table", "sent", "taken")


@twin(
    "dom45_lineage_roots",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 7 AS parent FROM part WHERE p_partkey > 0),
w(child, up, depth) AS (SELECT child, parent, 1 FROM e UNION ALL SELECT w.child, e.parent, w.depth + 1 FROM w JOIN e ON e.child = w.up)
SELECT child::VARCHAR AS item_key, up::VARCHAR AS root_key, depth::BIGINT AS depth FROM w WHERE up = 0""",
)
def _(spark, d):
    """Parts as a family tree, in which each stems from the one at a seventh of its number: where they all come from."""
    p = table(spark, d, "part").where("p_partkey > 0")
    return seed.roots(p.select(F.floor(F.col("p_partkey") / 7).cast("string").alias("parent_key"), F.col("p_partkey").cast("string").alias("child_key")))


@twin(
    "dom45_attributes_in_force",
    """WITH s AS (SELECT lower(p_name) AS item_key, l_shipdate::DATE AS since, max(l_extendedprice) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT item_key, since AS effective_from, price, lead(since) OVER (PARTITION BY item_key ORDER BY since) - 1 AS effective_to FROM s""",
)
def _(spark, d):
    """Prices of items by name and the days on which they hold, from what lines were sold for."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    one = table(spark, d, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("since"), F.col("l_extendedprice").alias("price"))
    sheet = one.join(p, F.col("l_partkey") == F.col("p_partkey")).select("name", "since", "price", *[F.lit(None).cast(t).alias(c) for c, t in (("variants", "string"), ("parent", "string"), ("parent_since", "date"))])
    return seed.items(sheet)["attributes"]
