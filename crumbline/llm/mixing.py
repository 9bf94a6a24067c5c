"""Operator 7: mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, stored, table

#: Weights of the sources by code point, repeating; the share of all words that the mix has; most copies of a word.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents of one source and size are ranked in so many groups by id, so that no task ranks all documents of a hot size.
SPREAD = 1024
SEED = 7


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, source_docs, target) from (source, source_size, source_docs), one row per source.

    Sources are weighted in order of code points, null last. A target stops at most times its source's size; the excess goes
    to the others by weight until none is above. With the sources in order of (most x size / weight), those that stop are the
    first ones, so running sums give the level at which the others are filled. The windows see one row per source only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    row = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (row + 1).cast("int")))
    weighted = weighted.withColumn("most", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    so_far = fill.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(so_far), F.lit(0.0))) / (
        F.sum("w").over(every) - F.coalesce(F.sum("w").over(so_far), F.lit(0.0))
    )
    stops = weighted.withColumn("level", level).withColumn("stops", (F.col("most") / F.col("w") <= F.col("level")).cast("int"))
    open_level = F.max(F.when(F.col("stops") == 0, F.col("level"))).over(every)  # that of the first one; later ones are lower
    return stops.withColumn("target", F.when(F.col("stops") == 1, F.col("most")).otherwise(F.col("w") * open_level)).select(
        "source", "source_size", "source_docs", F.col("target").cast("double").alias("target")
    )


def offset(seed: int) -> Column:
    """A source's one random offset in [0, 1): a hash of seed and source, so that reruns agree."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce("source", F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def mixed(sized: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc, mix) from (doc, source, id, size): mix is a struct of size, source_size, target and copies, doc is whatever it is.

    A document of a source is expected target / source_size times, so the prefix sum of expected copies is its place times
    that number. One random offset in [0, 1) per source is added; a document is taken once for each integer between its prefix sum
    and the one before. Places follow the size, up over the even ranks and down again over the odd ones: neighbours are
    about equally long, and so are the ends, so what one place takes too much the next ones lack, whatever the offset. Ranks come from
    counts by (source, size, group of ids): windows see one row per size or group, or one group's documents, never a source.
    A null text has size 0, a null source is a source, a null id ranks first, repeated rows count as documents of their own
    (rows of one source, size and id are told apart by an order that may differ between reruns; they take as many words in all),
    a source without words has target 0 and gets no copies.
    """
    sized = sized.withColumn("band", F.floor(F.sqrt("size"))).withColumn("spread", F.coalesce(F.pmod("id", F.lit(SPREAD)), F.lit(0)))
    groups = sized.groupBy("source", "band", "size", "spread").agg(F.count("*").alias("n"))
    by_size = groups.groupBy("source", "band", "size").agg(F.sum("n").alias("n_size"))
    by_band = by_size.groupBy("source", "band").agg(F.sum("n_size").alias("n_band"), F.sum(F.col("n_size") * F.col("size")).alias("words"))
    by_source = by_band.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n_band").alias("source_docs"))
    goal = targets(by_source, weights, share, most).withColumn("offset", offset(seed))

    def before(n: str, by: list[str], order: str):
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(window), F.lit(0))

    bands = by_band.withColumn("at_band", before("n_band", ["source"], "band"))
    at_size = by_size.withColumn("at_size", before("n_size", ["source", "band"], "size"))
    at_group = groups.withColumn("at_group", before("n", ["source", "band", "size"], "spread"))
    sizes = _join(at_size, bands.select("source", "band", "at_band"), ["source", "band"]).withColumn("at", F.col("at_band") + F.col("at_size"))
    start = _join(at_group, sizes.select("source", "size", "at"), ["source", "size"]).withColumn("start", F.col("at") + F.col("at_group"))
    start = _join(start.select("source", "size", "spread", "start"), goal, ["source"])
    nth = F.row_number().over(Window.partitionBy("source", "size", "spread").orderBy("id"))
    placed = _join(sized.withColumn("nth", nth), start, ["source", "size", "spread"]).withColumn("rank", F.col("start") + F.col("nth") - 1)
    half = F.floor(F.col("rank") / 2)
    placed = placed.withColumn("place", F.when(F.col("rank") % 2 == 0, half).otherwise(F.col("source_docs") - 1 - half))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(F.col("offset") + (F.col("place") + 1) * each) - F.floor(F.col("offset") + F.col("place") * each)
    return placed.select("doc", F.struct("size", "source_size", "target", F.least(copies, F.lit(most).cast("long")).alias("copies")).alias("mix"))


def _join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal."""
    other = right.select(*[F.col(c).alias(f"{c}_r") if c in on else F.col(c) for c in right.columns])
    return left.join(other, [left[c].eqNullSafe(other[f"{c}_r"]) for c in on]).drop(*[f"{c}_r" for c in on])


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of docs, each document as often as it is taken; docs has doc_id, text and source."""
    sized = docs.select(F.struct("*").alias("doc"), "source", F.col("doc_id").alias("id"), n_words(F.col("text")).alias("size"))
    taken = mixed(sized, **how).where("mix.copies > 0")
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("mix.copies").cast("int")))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Words are counted once: what is ranked and summed below is three numbers and the source of each document.
    sized = stored(docs.select(F.col("doc_id").alias("doc"), "source", F.col("doc_id").alias("id"), n_words(F.col("text")).alias("size")), "mix-sizes")
    return mixed(sized).select(
        F.col("doc").alias("doc_id"), "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken")
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, 2e0 * sum(size)::DOUBLE AS most,
    [5e0, 2e0, 1e0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), f AS (
  SELECT *, (1.5e0 * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER before, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0e0)) AS level
  FROM s WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, docs, CASE WHEN most / w <= level THEN most ELSE w * max(CASE WHEN most / w > level THEN level END) OVER () END AS target FROM f
), o AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS each, ('0x' || substr(sha256('7|' || coalesce(source, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656e0 AS off FROM t
), r AS (
  SELECT d.doc_id, d.size, o.*, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id % 1024, d.doc_id) - 1 AS nth FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source
), p AS (SELECT *, CASE WHEN nth % 2 = 0 THEN nth // 2 ELSE docs - 1 - nth // 2 END AS place FROM r)
SELECT doc_id, size, source_size, target, (least(floor(off + (place + 1) * each) - floor(off + place * each), 2) * size)::BIGINT AS taken FROM p
"""
