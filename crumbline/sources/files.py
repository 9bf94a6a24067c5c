"""Files in and out: typed-in logs, lines, JSON, state that may be missing, appends that refuse surprises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crumbline.functions.scalars import strip_comment

LOG_COLUMNS = ("business_date", "item_key", "quantity_made", "quantity_refill", "quantity_wasted")


def number(c):
    """A double from text; blanks, None and anything else that is no number are null."""
    return F.when(F.trim(c).isin("", "None"), None).otherwise(F.trim(c).try_cast("double"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(d, item, made, refill, wasted, supply) from a CSV of text columns; wasted is null where blank. Rows without made are left out."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in LOG_COLUMNS if c not in raw.columns})
    out = raw.select(F.col("business_date").try_cast("date").alias("d"), F.col("item_key").alias("item"), number(F.col("quantity_made")).alias("made"), F.coalesce(number(F.col("quantity_refill")), F.lit(0.0)).alias("refill"), number(F.col("quantity_wasted")).alias("wasted"))
    return out.where("made is not null").withColumn("supply", F.col("made") + F.col("refill"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files without comments and blank ones."""
    return spark.read.text(path).select(strip_comment(F.col("value")).alias("line")).where("line <> ''")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Typed-off sheets as lines(doc, no, line) for operators.etl.transcript; a file is one sheet."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("doc"), "value")
    return whole.select("doc", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON state; nothing where the file is missing, and without rows that can't be read."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return lines.where("value <> ''").select(parsed.alias("r")).where("r._bad is null").select("r.*").drop("_bad")


def append_known(df: DataFrame, path: str, columns: list[str]) -> None:
    """Appends CSV rows; unknown columns are refused, missing ones are blank."""
    unknown = [c for c in df.columns if c not in columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("append").option("header", True).csv(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Writes df(d, ...) so that the days it has replace those at path, and other days stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("d").parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_new(df: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key isn't stored yet."""
    from crumbline.streaming.mutations import exists

    new = df.dropDuplicates(key)
    if exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select(*key), key, "left_anti")
    new.write.mode("append").parquet(path)


def read_economics(spark: SparkSession, prices: str, recipes: str, ingredients: str) -> DataFrame:
    """(item, price, cost) from three CSVs: prices(item_key, price), recipes(item_key, ingredient, qty_per_unit), ingredients(ingredient, pack_cost,
    pack_qty). An item without a price or without any known ingredient keeps a null there; unknown is not 0."""
    csv = lambda path: spark.read.option("header", True).csv(path)
    each = csv(ingredients).select("ingredient", (number(F.col("pack_cost")) / F.nullif(number(F.col("pack_qty")), F.lit(0.0))).alias("unit"))
    cost = csv(recipes).join(each, "ingredient").groupBy(F.col("item_key").alias("item")).agg(F.sum(number(F.col("qty_per_unit")) * F.col("unit")).alias("cost"))
    price = csv(prices).select(F.col("item_key").alias("item"), number(F.col("price")).alias("price"))
    return price.join(cost, "item", "full").select("item", "price", "cost")


PREDICTION = "d date, item string, plan double, point double, lo double, hi double"


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Stored predictions, as write_once() left them; nothing where there are none."""
    return read_state(spark, path, PREDICTION)


def write_scored(rows: DataFrame, path: str) -> None:
    """Scored decisions as CSV, a header in every file."""
    rows.select("policy", "d", "item", "q", "demand", "waste_cost", "stockout_cost", "unidentified").write.mode("overwrite").option("header", True).csv(path)


def audited_append(df: DataFrame, path: str, audit: str, key: list[str], batch: str) -> int:
    """append_new() with a row in the audit table: batch, digest of the keys sent, rows sent and rows new. The audit row comes last, so a batch
    that has one is whole; sending it again appends nothing and adds a row that says so."""
    sent = df.dropDuplicates(key).persist()
    try:
        before = _rows_at(df.sparkSession, path)
        append_new(sent, path, key)
        new = _rows_at(df.sparkSession, path) - before
        digest = F.lower(F.hex(F.bit_xor(F.xxhash64(*key))))
        row = sent.agg(F.lit(batch).alias("batch"), digest.alias("digest"), F.count("*").alias("sent")).withColumn("new", F.lit(new).cast("long"))
        row.write.mode("append").parquet(audit)
    finally:
        sent.unpersist()
    return new


def _rows_at(spark: SparkSession, path: str) -> int:
    from crumbline.streaming.mutations import exists

    return spark.read.parquet(path).count() if exists(spark, path) else 0


def as_markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line): a table in Markdown, header first, rows in order. For sheets that a person reads: one task numbers the lines."""
    from pyspark.sql import Window

    row = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = df.select(F.row_number().over(Window.orderBy(*order)).alias("n"), row([F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]).alias("line"))
    head = df.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns) + " |"), (0, "|" + "---|" * len(columns))], "n int, line string")
    return head.union(body).select(F.col("n").alias("line_no"), "line")


def from_markdown(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a Markdown table as text, by line: what as_markdown() wrote."""
    cells = F.transform(F.slice(F.split("line", r"\|"), 2, len(columns)), lambda c: F.trim(c))
    kept = lines.where(F.col("line").startswith("| ")).where(~F.col("line").startswith("| " + columns[0] + " |")).select("line_no", cells.alias("c"))
    return kept.select("line_no", *[F.get("c", F.lit(i)).alias(c) for i, c in enumerate(columns)])
