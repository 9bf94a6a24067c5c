"""The jobs of a day: observations come in, a sheet is issued and kept, what came of issued sheets is scored. Each can run again at any time and gives the same tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbline.operators import jobs, ladder
from crumbline.operators.economics import scored, with_economics
from crumbline.operators.observations import isodow
from crumbline.sources.files import replace_days
from crumbline.sources.loads import exists

SEEN = ["d", "item", "supply", "sold", "censored", "wasted"]
OBSERVATIONS, ISSUED, SCORES, LEDGER = "observations", "issued", "scores", "ledger"


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if not exists(spark, f"{folder}/{name}"):
        raise RuntimeError(f"no {name} yet")
    return spark.read.parquet(f"{folder}/{name}").withColumn("d", F.col("d").cast("date"))


def ingest(spark: SparkSession, folder: str, read: Callable[[], DataFrame]) -> DataFrame:
    """Keeps the observations (columns SEEN) that read() gives: a day that it has replaces the stored one as a whole, other days stay. One row: items, days, rows and latest_day of what came. Fails,
    and keeps what was there, where nothing came."""
    kinds = {"d": "date", "item": "string", "censored": "boolean"}  # the same in every batch, whatever the source says
    came = read().select(*[F.col(c).cast(kinds.get(c, "double")).alias(c) for c in SEEN]).where("d is not null and item is not null")
    if came.isEmpty():
        raise RuntimeError("no observations came")
    replace_days(came, f"{folder}/{OBSERVATIONS}")
    return came.agg(F.countDistinct("item").alias("items"), F.countDistinct("d").alias("days"), F.count("*").alias("rows"), F.max("d").alias("latest_day"))


def recommended(obs: DataFrame, econ: DataFrame, days: DataFrame, level: int = 3) -> DataFrame:
    """(d, item, quantity) of the sell-chance rule for days(d), all in one pass; each sees days strictly before it, so a sheet made late equals the one that its morning
    would have had. Items without a day before, or with too few for the rule, have no row."""
    first = obs.groupBy("item").agg(F.min("d").alias("first"))
    targets = first.join(F.broadcast(days), F.col("d") > F.col("first")).select("item", F.col("d").alias("t"), F.col("d").alias("c"))
    made = ladder.decided(ladder.with_targets(obs, targets), econ, level, by_unit=False)
    return made.where("quantity is not null").select(F.col("t").alias("d"), "item", F.col("quantity").cast("double").alias("quantity"))


def prep(spark: SparkSession, folder: str, econ: DataFrame, today: dt.date, back: int = 14, version: str = "roll_chance-3") -> DataFrame:
    """Issues the sheet of today and those of the back days before it that were never issued, marked backfilled. What was issued stays as it was issued: days of this version that are kept
    aren't made again. The rows issued now."""
    path = f"{folder}/{ISSUED}"
    obs = stored(spark, folder, OBSERVATIONS)
    kept = stored(spark, folder, ISSUED) if exists(spark, path) else None
    done = spark.createDataFrame([], "d date") if kept is None else kept.where(F.col("version") == version).select("d")
    days = spark.createDataFrame(jobs.missing_days(done, today.isoformat(), back).collect(), "d date")  # back + 1 rows at most, told before the write changes what is kept
    rows = recommended(obs, econ, days).withColumns({"version": F.lit(version), "backfilled": F.col("d") != F.lit(today)})
    # One file tree per version and day: a stopped write leaves whole days or none, and the next run makes those that lack.
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "d").parquet(path)
    return stored(spark, folder, ISSUED).where(F.col("version") == version).join(F.broadcast(days), "d", "left_semi")


def score(spark: SparkSession, folder: str, econ: DataFrame, today: dt.date, back: int = 14) -> DataFrame:
    """Scores what was issued for days of the last back ones that have been observed, by the cost of error. Days are scored anew each time and replaced as a whole, so corrections that come in
    within back days count. The rows scored now."""
    since = F.lit(today - dt.timedelta(back))
    obs = stored(spark, folder, OBSERVATIONS).where(F.col("d") >= since)
    rows = stored(spark, folder, ISSUED).where(F.col("d") >= since).join(obs, ["d", "item"]).withColumn("dow", isodow("d"))
    replace_days(scored(with_economics(rows, econ), "quantity").select("d", "item", "version", "backfilled", "quantity", "supply", "sold", "wasted", "censored", "cost_of_error"), f"{folder}/{SCORES}")
    return stored(spark, folder, SCORES).where(F.col("d") >= since)


def accepted(verdict: DataFrame) -> DataFrame:
    """evidence.retrain_verdict() as a job: a refused rule is a failure, whose reason the ledger shows."""
    said = verdict.select("verdict").first()
    if said is None or said.verdict != "accepted":
        raise RuntimeError(said.verdict if said else "no verdict")
    return verdict


def run_day(spark: SparkSession, folder: str, read: Callable[[], DataFrame], econ: DataFrame, today: dt.date, verdict: Callable[[], DataFrame] | None = None, back: int = 14) -> dict[str, bool]:
    """All jobs of a day in order: ingest, score, retrain (where verdict is given), prep. After a failure the rest waits for tomorrow, but a sheet is issued whatever else failed, from the observations
    that are there. The ledger in the folder has a row per job."""
    todo = [("ingest", lambda: ingest(spark, folder, read))]
    if exists(spark, f"{folder}/{ISSUED}"):
        todo.append(("score", lambda: score(spark, folder, econ, today, back)))
    if verdict:
        todo.append(("retrain", lambda: accepted(verdict())))
    todo.append(("prep", lambda: prep(spark, folder, econ, today, back)))
    return jobs.chain(spark, f"{folder}/{LEDGER}", todo)
