"""Planning data made from the driver's tables: what was supplied and thrown away per item and day, prices, and an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbline.operators.observations import derived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str, item: str = "p_type") -> DataFrame:
    """(d, item, made, refill, wasted) from lineitem and part: lines of a part type shipped on a day; returned ones are waste."""
    lines = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("d"), "l_partkey", F.col("l_returnflag").alias("flag"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(item).alias("item"))
    # Parts ship too rarely for a count by part and day to spare rows, and its hash table would hold them all. Parts are hashed, a partition of them by a task, so that
    # lines are neither counted by part nor sorted; a task's counts by item and day are few.
    joined = lines.join(parts.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))
    flag = F.col("flag")
    return joined.groupBy("d", "item").agg(F.count_if(flag != "A").alias("made"), F.count_if(flag == "A").alias("refill"), F.count_if(flag == "R").alias("wasted"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(counts(spark, sf_dir))


ECON_SQL = """SELECT * FROM (VALUES ('ECONOMY', 6.2e0, 1.4e0), ('LARGE', 13.5e0, 4.7e0), ('MEDIUM', 9.7e0, 2.6e0), ('PROMO', 10.9e0, 3.05e0), ('SMALL', 7.4e0, 1.85e0), ('STANDARD', 8.6e0, 2.3e0)) AS t(item, price, cost)"""


def economics(spark: SparkSession) -> DataFrame:
    """(item, price, cost): six rows."""
    return F.broadcast(spark.sql(ECON_SQL))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_entries from events: (entry_id, business_date, item_id, entry_type, quantity, recorded_at)."""
    kind = F.col("event_type")
    return (
        table(spark, sf_dir, "events")
        .where(kind != "signup")
        .select(
            F.col("event_id").alias("entry_id"), F.to_date("ts").alias("business_date"), (F.col("user_id") % 20).alias("item_id"),
            F.when(kind == "view", "made").when(kind == "click", "refill").when(kind == "purchase", "afternoon_count").otherwise("waste").alias("entry_type"),
            F.get_json_object("props", "$.k").cast("double").alias("quantity"), F.col("ts").alias("recorded_at"),
        )
    )


#: The same in SQL, as common table expressions that other queries start with.
OBS = (
    """b AS (
  SELECT l_shipdate::DATE AS d, p_type AS item, count(*) FILTER (WHERE l_returnflag <> 'A') AS made, count(*) FILTER (WHERE l_returnflag = 'A') AS refill,
    count(*) FILTER (WHERE l_returnflag = 'R') AS wasted
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
), obs AS (
  SELECT *, made + refill AS supply, greatest(0, made + refill - wasted) AS sold, wasted <= 0 AS censored, isodow(d)::INT AS dow FROM b
), econ AS ("""
    + ECON_SQL
    + ")"
)
LOG = """log AS (
  SELECT event_id AS entry_id, ts::DATE AS business_date, user_id % 20 AS item_id,
    CASE event_type WHEN 'view' THEN 'made' WHEN 'click' THEN 'refill' WHEN 'purchase' THEN 'afternoon_count' ELSE 'waste' END AS entry_type,
    json_extract_string(props, '$.k')::DOUBLE AS quantity, ts AS recorded_at
  FROM events WHERE event_type <> 'signup'
), cur AS (SELECT DISTINCT ON (business_date, item_id, entry_type) * FROM log ORDER BY business_date, item_id, entry_type, recorded_at DESC, entry_id DESC)"""
