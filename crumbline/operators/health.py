"""How the daily jobs are doing, and what is said about it to whom."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels by rank, and when things count as old (fixed values): hours since data came, days data may lack, days since a model was fitted, per cent
#: that a score may be worse.
LEVELS = ("ok", "stale", "degraded", "failed")
FAILED_HOURS, STALE_HOURS, GAP_DAYS, RETRAIN_DAYS, WORSE = 54, 30, 2, 10, 10.0


def assessed(inputs: DataFrame) -> DataFrame:
    """inputs(at, ingest_ok, ingest_error, retrain_ok, retrain_error, latest_day, expected_day, score_pct, has_model) with findings, the worst
    first, as (level, code), and worst, the rank of the worst level. All rules are one pass over the row."""
    seconds = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) / 1e6 - F.unix_micros(F.col(b).cast("timestamp")) / 1e6
    age, old = seconds("at", "ingest_ok") / 3600, seconds("at", "retrain_ok") / 86400
    gap = F.datediff("expected_day", "latest_day")
    later = lambda bad, ok: F.col(bad).isNotNull() & (F.col(ok).isNull() | (F.col(bad) > F.col(ok)))

    def rule(when: Column, level: Column | int, code: str) -> Column:
        level = F.lit(level) if isinstance(level, int) else level
        return F.when(when, F.struct((-level).alias("rank"), F.lit(code).alias("code")))

    rules = [
        rule(F.col("ingest_ok").isNull(), 3, "ingest-never"), rule(age >= FAILED_HOURS, 3, "ingest-failed"), rule((age >= STALE_HOURS) & (age < FAILED_HOURS), 1, "ingest-stale"),
        rule(later("ingest_error", "ingest_ok"), 2, "ingest-error"), rule(gap >= 1, F.when(gap >= GAP_DAYS, 2).otherwise(1), "data-gap"), rule(~F.col("has_model"), 2, "no-model"),
        rule(later("retrain_error", "retrain_ok"), 2, "retrain-error"), rule(~later("retrain_error", "retrain_ok") & (old >= RETRAIN_DAYS), 1, "retrain-stale"), rule(F.col("score_pct") > WORSE, 2, "score-worse"),
    ]
    found = F.array_sort(F.array_compact(F.array(*rules)))
    out = inputs.withColumn("findings", F.transform(found, lambda f: F.struct((-f["rank"]).alias("level"), f["code"].alias("code"))))
    return out.withColumn("worst", F.coalesce(F.array_max(F.transform("findings", lambda f: f["level"])), F.lit(0)))


def alert_text(name: Column, findings: Column) -> Column:
    """One line for a channel: the worst level and all codes."""
    names = F.array(*[F.lit(x) for x in LEVELS])
    worst = F.element_at(names, F.coalesce(F.array_max(F.transform(findings, lambda f: f["level"])), F.lit(0)) + 1)
    return F.concat(name, F.lit(" is "), worst, F.when(F.size(findings) > 0, F.concat(F.lit(": "), F.array_join(F.transform(findings, lambda f: f["code"]), ", "))).otherwise(""))


def notify(alerts: DataFrame, send: Callable[[str], bool] = lambda text: print(text) or True) -> DataFrame:
    """Sends alerts(code, text) by a function of one's own, on the executors, and says which were taken: (code, sent). A sender that raises counts as
    not sent, so a dead channel stops nothing."""

    def run(pdfs):
        for pdf in pdfs:
            taken = []
            for text in pdf["text"]:
                try:
                    taken.append(bool(send(text)))
                except Exception:  # whatever a channel does
                    taken.append(False)
            yield pdf[["code"]].assign(sent=taken)

    return alerts.select("code", "text").mapInPandas(run, "code string, sent boolean")
