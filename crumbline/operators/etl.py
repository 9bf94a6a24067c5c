"""Cells, transcripts, nested data: what turns sheets and files into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crumbline.functions.scalars import strip_comment


def value_kind(v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit("")) == "", "empty").when(v.try_cast("long").isNotNull() & ~v.contains("."), "int").when(v.try_cast("double").isNotNull(), "float").otherwise("text")


def header_with_below(cells: DataFrame, label: str) -> DataFrame:
    """Where a label stands in cells(sheet, r, c, v), and the value in the row below it."""
    head = cells.where(F.lower(F.trim("v")) == label).select("sheet", F.col("r").alias("header_row"), F.col("c").alias("header_col"), (F.col("r") + 1).alias("r"))
    below = cells.select("sheet", "r", F.col("v").alias("below"))
    return head.join(below, ["sheet", "r"], "left").select("sheet", "header_row", "header_col", "below")


def with_sections(lines: DataFrame, starts: Column, by: list[str], order: str) -> DataFrame:
    """lines with section: how many starts have come up to each line."""
    return lines.withColumn("section", F.count_if(starts).over(Window.partitionBy(*by).orderBy(order)))


def transcript(lines: DataFrame) -> DataFrame:
    """lines(doc, no, line) of typed-off sheets as cells (doc, section, d, place, item, made, wasted), with the day's own totals. A sheet lists its
    items between ITEMS and END; DAY lines hold date, made, waste, sold and revenue, the lines below them a made/waste pair for each item
    in turn, a point where it is blank. What follows # is a comment. A cell beyond the items has none; cells above any DAY are in section 0."""
    x = lines.withColumn("line", strip_comment(F.col("line"))).where("line <> ''")
    so_far = Window.partitionBy("doc").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").isin("ITEMS", "END")
    listing = F.last(F.when(fence, F.col("line") == "ITEMS"), ignorenulls=True).over(so_far)
    x = x.withColumn("kind", F.when(fence, "fence").when(listing, "item").when(F.startswith("line", F.lit("DAY ")), "day").otherwise("cells"))
    x = x.withColumns({"place": F.count_if(F.col("kind") == "item").over(so_far), "section": F.count_if(F.col("kind") == "day").over(so_far), "words": F.split("line", r"\s+")})
    items = x.where("kind = 'item'").select("doc", "place", F.col("line").alias("item"))
    day = F.first(F.when(F.col("kind") == "day", F.col("words")), ignorenulls=True).over(Window.partitionBy("doc", "section"))
    above = F.coalesce(F.sum(F.when(F.col("kind") == "cells", F.size("words"))).over(Window.partitionBy("doc", "section").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumns({"day": day, "above": above}).where("kind = 'cells'").select("doc", "section", "day", "above", F.posexplode("words").alias("i", "cell"))
    part = lambda n: F.get(F.split("cell", "/"), F.lit(n)).try_cast("double")
    total = lambda n: F.get("day", F.lit(n)).try_cast("double")
    cells = x.select(
        "doc", "section", F.get("day", F.lit(1)).try_cast("date").alias("d"), (F.col("above") + F.col("i") + 1).alias("place"), part(0).alias("made"), part(1).alias("wasted"),
        total(2).alias("day_made"), total(3).alias("day_waste"), total(4).alias("day_sold"), total(5).alias("revenue"),
    )
    return cells.join(items, ["doc", "place"], "left")


def transcript_problems(cells: DataFrame) -> DataFrame:
    """(doc, section, d, problem) of days that don't add up, have cells without an item, or no date."""
    sums = cells.groupBy("doc", "section", "d").agg(F.coalesce(F.sum("made"), F.lit(0.0)).alias("made"), F.coalesce(F.sum("wasted"), F.lit(0.0)).alias("wasted"), F.count_if(F.col("item").isNull()).alias("lost"), F.max("day_made").alias("m"), F.max("day_waste").alias("w"), F.max("day_sold").alias("s"))
    said = F.array_compact(F.array(
        F.when(F.col("d").isNull(), "cells without a day"), F.when(F.col("lost") > 0, "more cells than items"), F.when(F.col("made") != F.col("m"), "made does not add up"),
        F.when(F.col("wasted") != F.col("w"), "waste does not add up"), F.when(F.col("m") - F.col("w") != F.col("s"), "sold is not made less waste"),
    ))
    return sums.select("doc", "section", "d", F.explode(said).alias("problem"))


def transcript_rows(cells: DataFrame) -> DataFrame:
    """Cells with a made figure as (d, item, made, wasted, sold, censored). On a day with any waste figure a blank means that nothing was left; a day
    without one was not counted: what was sold is not known."""
    counted = F.count("wasted").over(Window.partitionBy("doc", "section")) > 0
    x = cells.withColumn("counted", counted).where("made is not null and item is not null")
    wasted = F.when(F.col("counted"), F.coalesce("wasted", F.lit(0.0)))
    return x.select("d", "item", "made", wasted.alias("wasted"), F.greatest(F.lit(0.0), F.col("made") - wasted).alias("sold"), F.coalesce(wasted == 0, F.lit(False)).alias("censored")).withColumn("sold", F.when(F.col("wasted").isNotNull(), F.col("sold")))


def templates(json: DataFrame) -> DataFrame:
    """{weekday: {item: quantity}} as rows (dow, item, qty)."""
    m = json.select(F.explode(F.from_json("json", "map<string, map<string, int>>")).alias("dow", "m"))
    return m.select(F.col("dow").cast("int").alias("dow"), F.explode("m").alias("item", "qty"))


def encoded_history(obs: DataFrame) -> DataFrame:
    """One row per month: a dictionary of dates and positional rows [date index, item, made, refill, waste], as exported files have them."""
    days = obs.withColumn("month", F.date_trunc("month", "d"))
    return days.groupBy("month").agg(F.array_sort(F.collect_set("d")).alias("dates"), F.collect_list(F.struct("d", "item", "made", "refill", "wasted")).alias("x")).select(
        "dates", F.transform("x", lambda r: F.struct((F.array_position("dates", r["d"]) - 1).cast("int").alias("i"), r["item"].alias("item"), r["made"].cast("double").alias("made"), r["refill"].cast("double").alias("refill"), r["wasted"].cast("double").alias("wasted"))).alias("rows")
    )


def decoded_history(files: DataFrame) -> DataFrame:
    r = files.select("dates", F.explode("rows").alias("r"))
    rows = r.select(F.get("dates", F.col("r.i")).alias("d"), "r.item", "r.made", "r.refill", "r.wasted")
    return rows.selectExpr("d", "item", "stack(3, 'made', made, 'refill', refill, 'waste', wasted) as (entry_type, quantity)")


def alerts(feed: DataFrame) -> DataFrame:
    """Actual alerts of a feed, one per event: the most severe."""
    f = feed.select(F.explode(F.from_json("json", "features array<struct<event: string, rank: int, status: string>>")["features"]).alias("f")).where("f.status = 'Actual'")
    best = f.groupBy("f.event").agg(F.min("f.rank").alias("rank"))
    return best.select("event", F.when(F.col("rank") == 0, "Severe").when(F.col("rank") == 1, "Moderate").otherwise("Minor").alias("severity"))


def resent_days(old: DataFrame, new: DataFrame, named: Column) -> DataFrame:
    """Days that came again: identical, changed (if the day was named for replacement) or blocked."""
    a, b = old.withColumnRenamed("made", "a"), new.withColumnRenamed("made", "b")
    both = a.join(b, ["d", "item"], "full").withColumn("differs", ~F.col("a").eqNullSafe(F.col("b")))
    g = both.groupBy("d").agg(F.count("*").alias("item_rows"), F.count_if("differs").alias("changed"))
    return g.withColumn("verdict", F.when(F.col("changed") == 0, "identical").when(named, "changed").otherwise("blocked"))


def replaced_days(stored: DataFrame, sent: DataFrame) -> DataFrame:
    """stored with every day that sent has replaced as a whole."""
    return stored.join(sent.select("d").distinct(), "d", "left_anti").unionByName(sent)
