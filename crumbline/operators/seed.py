"""First tables from sheets of items, days and counts: items, their other names, attributes in force and lineage; and who descends from whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbline.shared import removed, written

#: Columns of a day sheet that are quantities, and the kind of entry that each is.
ENTRIES = {"made": "made", "refill": "refill", "waste": "waste", "sold": "afternoon_count"}


def key_of(name: Column) -> Column:
    """A name in lower case, with single spaces."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s ]+", " ")))


def items(sheet: DataFrame) -> dict[str, DataFrame]:
    """items, aliases, attributes and lineage of sheet(name, variants, price, since, parent, parent_since): variants are names parted by bars. Attributes hold from
    a day until the day before the item's next ones (null: still). Rows of one item and day count once, the highest price of them; without a
    price it stays unknown."""
    s = sheet.withColumn("item_key", key_of(F.col("name")))
    alias = s.select("item_key", F.explode(F.split(F.coalesce("variants", F.lit("")), r"\|")).alias("raw")).select(F.trim("raw").alias("raw_name"), "item_key").where("raw_name <> ''")
    since = s.groupBy("item_key", F.col("since").alias("effective_from")).agg(F.max("price").alias("price"))
    until = F.date_sub(F.lead("effective_from").over(Window.partitionBy("item_key").orderBy("effective_from")), 1)
    lineage = s.where("trim(parent) <> ''").select(key_of(F.col("parent")).alias("parent_key"), F.col("item_key").alias("child_key"), F.coalesce("parent_since", "since").alias("effective_date"))
    return {
        "items": s.groupBy("item_key").agg(F.min("name").alias("display_name")), "aliases": alias.groupBy("raw_name").agg(F.min("item_key").alias("item_key")),
        "attributes": since.withColumn("effective_to", until), "lineage": lineage.distinct(),
    }


def entries(sheet: DataFrame, aliases: DataFrame) -> DataFrame:
    """(d, item_key, entry_type, quantity, source_ref, value_hash): one row per quantity of sheet(ref, d, raw_name, made, refill, waste, sold). A blank cell makes no row:
    absence is not zero. A name that is no alias stands for itself."""
    each = ", ".join(f"'{kind}', cast({column} as double)" for column, kind in ENTRIES.items())
    rows = sheet.selectExpr("ref", "d", "trim(raw_name) AS raw_name", f"stack({len(ENTRIES)}, {each}) as (entry_type, quantity)").where("quantity is not null")
    named = rows.join(aliases, "raw_name", "left").withColumn("item_key", F.coalesce("item_key", key_of(F.col("raw_name"))))
    sign = F.sha2(F.concat_ws("|", F.col("d").cast("string"), "item_key", "entry_type", F.col("quantity").cast("string")), 256)
    return named.select("d", "item_key", "entry_type", "quantity", F.concat_ws(":", "ref", "entry_type").alias("source_ref"), F.substring(sign, 1, 16).alias("value_hash"))


def ancestors(lineage: DataFrame) -> DataFrame:
    """(child_key, ancestor_key, steps): every ancestor of every item over rename, split and merge edges lineage(parent_key, child_key); steps is the
    shortest way. Each round joins what is known with itself, so rounds grow with the logarithm of the depth. Edges that lead round in a
    circle end where they began: an item is no ancestor of its own."""
    edge = lineage.select("child_key", F.col("parent_key").alias("ancestor_key")).where("child_key <> ancestor_key").distinct().withColumn("steps", F.lit(1))
    known, before = written(edge, "lineage"), -1
    now = (known.count(), known.agg(F.sum("steps")).first()[0])
    while now != before:
        a, b = known, known.select(F.col("child_key").alias("ancestor_key"), F.col("ancestor_key").alias("further"), F.col("steps").alias("more"))
        longer = a.join(b, "ancestor_key").select("child_key", F.col("further").alias("ancestor_key"), (F.col("steps") + F.col("more")).alias("steps"))
        all_ = known.union(longer.where("child_key <> ancestor_key")).groupBy("child_key", "ancestor_key").agg(F.min("steps").alias("steps"))
        new = written(all_, "lineage")
        removed(known)
        known, before = new, now
        now = (known.count(), known.agg(F.sum("steps")).first()[0])
    return known


def roots(lineage: DataFrame) -> DataFrame:
    """(item_key, root_key, depth): where each item with a parent comes from, the first of its ancestors that have none."""
    up = ancestors(lineage)
    born = up.select(F.col("child_key").alias("ancestor_key")).distinct()
    last = up.join(born, "ancestor_key", "left_anti")
    best = F.min(F.struct("ancestor_key", "steps"))
    return last.groupBy(F.col("child_key").alias("item_key")).agg(best.alias("r")).select("item_key", F.col("r.ancestor_key").alias("root_key"), F.col("r.steps").cast("long").alias("depth"))
