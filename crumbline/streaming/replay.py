"""A log of mutations of several kinds as a stream with keyed state: each mutation counts once, each kind has its own schema and handling.

What a batch costs follows the batch: which mutations were seen is state of the stream, keyed by id, and no batch reads what earlier ones
stored. A batch is written to a place of its own that a repeated batch overwrites, so a run that is killed between writing and
committing leaves nothing twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "mutation_id string, kind string, payload string, received_at timestamp"
#: Where payloads go that their kind's schema can't read, and kinds that nobody knows.
REJECTED = "rejected"


@dataclass(frozen=True)
class Kind:
    """The schema of a kind's payload (with many, an array of such), and its key: without one, mutations are history and all stay; with one, the last
    mutation of a key by server time, then id, is the state. own lists columns that a mutation never sets, e.g. of one device."""

    schema: str
    key: tuple[str, ...] = ()
    many: bool = False
    own: tuple[str, ...] = ()


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).json(path)


def typed(log: DataFrame, name: str, kind: Kind) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of one kind: payloads as columns, and the mutations whose payload isn't of the schema."""
    own = log.where(F.col("kind") == name)
    shape = f"array<struct<{kind.schema}>>" if kind.many else f"struct<{kind.schema}>"
    # A field of a wrong type makes that field null; a payload without a single field, or a row without its key, is none of the kind.
    parsed = own.withColumn("rows", F.from_json("payload", shape) if kind.many else F.array(F.from_json("payload", shape)))
    fields = [f.name for f in parsed.schema["rows"].dataType.elementType]
    whole = lambda r: reduce(and_, [r[k].isNotNull() for k in kind.key]) if kind.key else reduce(or_, [r[k].isNotNull() for k in fields])
    good = F.coalesce(F.col("rows").isNotNull() & F.forall("rows", lambda r: F.coalesce(whole(r), F.lit(False))), F.lit(False))
    rows = parsed.where(good).select("mutation_id", "received_at", F.explode("rows").alias("row"))
    return rows.select("mutation_id", "received_at", "row.*").drop(*kind.own), parsed.where(~good).drop("rows")


def last(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The last row of each key, by server time, then id."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct("received_at", "mutation_id"))
    return rows.groupBy(*key).agg(best.alias("r")).select(*key, "r.*")


def replay(stream: DataFrame, folder: str, checkpoint: str, kinds: dict[str, Kind], trigger: dict | None = None) -> StreamingQuery:
    """Writes each batch's mutations, each once, to folder/<kind>/batch=<n>; payloads and kinds that can't be read go to folder/rejected and stop
    nothing."""
    once = stream.dropDuplicates(["mutation_id"])

    def batch(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            bad = df.where(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)))
            for name, kind in kinds.items():
                rows, rejected = typed(df, name, kind)
                rows = last(rows, kind.key) if kind.key else rows
                rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={n}")
                bad = bad.unionByName(rejected)
            bad.write.mode("overwrite").parquet(f"{folder}/{REJECTED}/batch={n}")
        finally:
            df.unpersist()

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def table(spark: SparkSession, folder: str, name: str, kind: Kind | None = None) -> DataFrame:
    """What replay() has made of a kind: its history, or the state of its keys."""
    rows = spark.read.parquet(f"{folder}/{name}").drop("batch")
    return last(rows, kind.key) if kind and kind.key else rows


def compacted(spark: SparkSession, folder: str, name: str, kind: Kind, to: str) -> None:
    """The state of a keyed kind as one table elsewhere, for readers that would else merge very many batches."""
    table(spark, folder, name, kind).write.mode("overwrite").parquet(to)


def page(log: DataFrame, cursor: tuple | None, limit: int) -> DataFrame:
    """The next rows of a log after a cursor (received_at, mutation_id), in that order. Rows that share a server time are told apart by id, so that none is
    skipped or sent twice where a page ends among them."""
    after = log
    if cursor is not None:
        at, last_id = F.lit(cursor[0]).cast("timestamp"), F.lit(cursor[1])
        after = log.where((F.col("received_at") > at) | ((F.col("received_at") == at) & (F.col("mutation_id") > last_id)))
    return after.orderBy("received_at", "mutation_id").limit(limit)


def latest_values(stream: DataFrame, folder: str, checkpoint: str, key: tuple[str, ...], value: Column, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the last value of each key as state of the stream and writes the keys that changed in a batch to folder/batch=<n>. Replays change
    nothing, and corrections count however late they come: there is no watermark."""
    best = stream.groupBy(*key).agg(F.max_by(value, F.struct("received_at", "mutation_id")).alias("value"), F.max(F.struct("received_at", "mutation_id")).alias("at"))

    def batch(df: DataFrame, n: int) -> None:
        df.select(*key, "value", "at.*").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return best.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sessions(events: DataFrame, at: str, by: str, gap: str, delay: str) -> DataFrame:
    """(start, end, by, n) of visits: events of one key no further apart than gap. As a stream, a visit is told once it can't grow any more, and events later
    than delay are left out."""
    w = F.session_window(at, gap)
    seen = events.withWatermark(at, delay) if events.isStreaming else events
    return seen.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def followed(first: DataFrame, then: DataFrame, by: str, at: str, within: str, delay: str) -> DataFrame:
    """Pairs of an event of first and one of then of the same key at most within later. As streams, both keep what can still find a partner and no more."""
    a = first.select(F.col(by).alias("k"), F.col(at).alias("t"), F.struct("*").alias("first"))
    b = then.select(F.col(by).alias("k2"), F.col(at).alias("t2"), F.struct("*").alias("then"))
    if first.isStreaming:
        a, b = a.withWatermark("t", delay), b.withWatermark("t2", delay)
    return a.join(b, F.expr(f"k = k2 AND t2 >= t AND t2 <= t + INTERVAL {within}")).select("first", "then")
