"""A week of daily jobs, with days on which something fails, against sheets made in one go."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crumbline.operators import daily, jobs
from crumbline.operators.observations import derived
from crumbline.sources.adapter import economics

FIRST = dt.date(2026, 1, 5)


def record(spark, days):
    rows = [(FIRST + dt.timedelta(i), item, 6 + (i * k) % 5, i % 2, (i * k + i // 3) % 4) for i in range(days) for k, item in ((3, "LARGE"), (7, "SMALL"))]
    return derived(spark.createDataFrame(rows, "d date, item string, made long, refill long, wasted long"))


def sheets(df):
    return sorted((r.d, r["item"], r.quantity) for r in df.collect())


def test_a_week_with_failures(spark, tmp_path):
    folder, econ = str(tmp_path), economics(spark)
    start = 40
    today = lambda i: FIRST + dt.timedelta(start + i)

    def broken():
        raise OSError("log can't be read")

    done = {}
    for i in (0, 1, 3):  # the machine was off on the third day
        read = broken if i == 1 else lambda i=i: record(spark, start + i)
        verdict = (lambda: spark.createDataFrame([("refused: earns less",)], "verdict string")) if i == 3 else None
        done[i] = daily.run_day(spark, folder, read, econ, today(i), verdict, back=2)
    assert done == {0: {"ingest": True, "prep": True}, 1: {"ingest": False, "prep": True}, 3: {"ingest": True, "score": True, "retrain": False, "prep": True}}
    issued = daily.stored(spark, folder, daily.ISSUED)
    whole = record(spark, start + 3)
    days = lambda *n: spark.createDataFrame([(today(i),) for i in n], "d date")
    # The second day's sheet was issued without the first day's observations; all others equal those made from everything before them.
    want = sheets(daily.recommended(whole, econ, days(-2, -1, 0, 2, 3))) + sheets(daily.recommended(record(spark, start), econ, days(1)))
    assert sheets(issued) == sorted(want)
    assert {r.d: r.backfilled for r in issued.collect()} == {today(i): i in (-2, -1, 2) for i in (-2, -1, 0, 1, 2, 3)}
    score = daily.stored(spark, folder, daily.SCORES)
    assert {r.d for r in score.collect()} == {today(1)}  # of the last two days only that one had a sheet when scores were made
    again = daily.run_day(spark, folder, lambda: record(spark, start + 3), econ, today(3), back=2)
    assert all(again.values()) and sheets(daily.stored(spark, folder, daily.ISSUED)) == sorted(want)
    assert {r.d for r in daily.stored(spark, folder, daily.SCORES).collect()} == {today(1), today(2)}
    errors = {r.job: (r.last_error, r.last_ok is not None) for r in jobs.status(spark.read.parquet(f"{folder}/{daily.LEDGER}")).collect()}
    assert errors == {"ingest": ("log can't be read", True), "score": (None, True), "retrain": ("refused: earns less", False), "prep": (None, True)}


def test_nothing_comes_and_nothing_is_there(spark, tmp_path):
    folder, econ = str(tmp_path), economics(spark)
    assert daily.run_day(spark, folder, lambda: record(spark, 1).limit(0), econ, FIRST) == {"ingest": False, "prep": False}
    daily.ingest(spark, folder, lambda: record(spark, 3))
    with pytest.raises(RuntimeError):
        daily.ingest(spark, folder, lambda: record(spark, 3).limit(0))
    daily.ingest(spark, folder, lambda: record(spark, 3).where("item = 'SMALL'").withColumn("sold", F.lit(9)).where(F.col("d") == FIRST))
    got = sorted((r.d.day, r["item"]) for r in daily.stored(spark, folder, daily.OBSERVATIONS).collect())
    assert got == [(5, "SMALL"), (6, "LARGE"), (6, "SMALL"), (7, "LARGE"), (7, "SMALL")]
