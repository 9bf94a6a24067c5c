"""The daily jobs: each runs, and a row of the ledger says how it went; a failure is recorded, never raised."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "job string, started_at timestamp, status string, message string, rows long"


def run_job(spark: SparkSession, ledger: str, job: str, work: Callable[[], DataFrame | None], now: dt.datetime | None = None) -> bool:
    """Runs work and appends to the ledger; the rows of a result count as its measure."""
    started = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    try:
        result = work()
        row = (job, started, "ok", None, result.count() if result is not None else None)
    except Exception as e:  # the ledger is where failures are looked for
        row = (job, started, "error", str(e)[:500], None)
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(ledger)
    return row[2] == "ok"


def chain(spark: SparkSession, ledger: str, jobs: list[tuple[str, Callable[[], DataFrame | None]]], always: tuple[str, ...] = ("prep",)) -> dict[str, bool]:
    """Runs jobs in order; after a failure only those that must always run go on."""
    done: dict[str, bool] = {}
    for name, work in jobs:
        if all(done.values()) or name in always:
            done[name] = run_job(spark, ledger, name, work)
    return done


def status(ledger: DataFrame) -> DataFrame:
    """Of each job: last attempt, last success, last error, from the ledger."""
    bad = F.col("status") == "error"
    return ledger.groupBy("job").agg(
        F.max("started_at").alias("last_attempt"), F.max(F.when(~bad, F.col("started_at"))).alias("last_ok"), F.max(F.when(bad, F.struct("started_at", "message"))).getField("message").alias("last_error")
    )


def missing_days(done: DataFrame, upto: str, back: int = 14) -> DataFrame:
    """Days of the last back ones that done(d) lacks: what a backfill has to make."""
    spine = done.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(upto).cast("date"), back), F.lit(upto).cast("date"))).alias("d"))
    return spine.join(done.select("d").distinct(), "d", "left_anti")
