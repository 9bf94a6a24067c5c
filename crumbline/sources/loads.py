"""Loads that a crash can't split: a batch of several tables is there as a whole, or not at all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT = "import_batches"
AUDIT_SCHEMA = "batch string, seq long, source string, digest string, table string, sent long, taken long"


@dataclass(frozen=True)
class Table:
    """A table of a load: its key, and whether a row of a known key replaces what is stored (a dimension) or is left out (a fact)."""

    key: tuple[str, ...]
    replaces: bool = False


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder or file, which readers see at once or not at all; False if something is at the new place already."""
    fs, place = _fs(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    return fs.rename(place, target)


def deleted(spark: SparkSession, path: str) -> None:
    fs, place = _fs(spark, path)
    fs.delete(place, True)


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """The audit rows of the batches that are whole: one per batch and table."""
    path = f"{folder}/{AUDIT}"
    return spark.read.schema(AUDIT_SCHEMA).parquet(f"{path}/*") if exists(spark, path) else spark.createDataFrame([], AUDIT_SCHEMA)


def read(spark: SparkSession, folder: str, name: str, table: Table) -> DataFrame | None:
    """What the whole batches have made of a table, with the batch that each row came with; None before the first. Of a dimension the row of the
    last batch counts. Parts of a batch without an audit row aren't read."""
    seqs = [r.seq for r in batches(spark, folder).where(F.col("table") == name).select("seq").distinct().orderBy("seq").collect()]
    paths = [f"{folder}/{name}/batch={n}" for n in seqs]
    if not paths:
        return None
    rows = spark.read.option("basePath", f"{folder}/{name}").option("mergeSchema", True).parquet(*paths)
    if not table.replaces:
        return rows
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in table.key]), F.col("batch"))
    return rows.groupBy(*table.key).agg(best.alias("r")).select(*table.key, "r.*")


def load(spark: SparkSession, folder: str, batch: str, source: str, sent: dict[str, tuple[DataFrame, Table]]) -> list[tuple[str, int, int]]:
    """(table, rows sent, rows taken) of a batch. A batch that is whole already is not loaded again.

    Of each table the rows that aren't stored yet are written aside: facts by their key, dimensions where any column differs. What was written
    aside is then renamed to its place, and the audit comes last, by a rename of its own. Until then readers see nothing of the batch; a run that dies
    before is simply repeated and overwrites what it had left. Two loads of the same number can't both be whole: the second rename finds the
    place taken, and that load begins anew behind the other. Of several rows of one key in a batch one is taken, the same in every run.
    """
    done = batches(spark, folder)
    if done.where(F.col("batch") == batch).limit(1).count():
        return []
    seq = (done.agg(F.max("seq")).first()[0] or 0) + 1
    aside, audit = f"{folder}/.aside-{seq}-{batch}", []
    deleted(spark, aside)
    for name, (df, table) in sent.items():
        key = list(table.key)
        order = F.struct(*[c for c in df.columns if c not in key]) if len(df.columns) > len(key) else F.lit(1)
        one = df.groupBy(*key).agg(F.max(order).alias("r")) if len(df.columns) > len(key) else df.distinct()
        one = one.select(*key, "r.*") if "r" in one.columns and len(df.columns) > len(key) else one
        stored = read(spark, folder, name, table)
        if stored is None:
            new = one
        elif table.replaces:
            new = one.join(stored.drop("batch").withColumn("stored_digest", _digest(df.columns)).select(*key, "stored_digest"), key, "left")
            new = new.where(~F.col("stored_digest").eqNullSafe(_digest(df.columns))).drop("stored_digest")
        else:
            new = one.join(stored.select(*key), key, "left_anti")
        new.write.mode("overwrite").parquet(f"{aside}/{name}")
        audit.append((batch, seq, source, _of_rows(df), name, df.count(), spark.read.parquet(f"{aside}/{name}").count()))
    spark.createDataFrame(audit, AUDIT_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{aside}/{AUDIT}")
    for name in sent:
        place = f"{folder}/{name}/batch={seq}"
        deleted(spark, place)  # left by a run of this number that has no audit row
        moved(spark, f"{aside}/{name}", place)
    if not moved(spark, f"{aside}/{AUDIT}", f"{folder}/{AUDIT}/seq-{seq}"):
        return load(spark, folder, batch, source, sent)
    deleted(spark, aside)
    return [(name, n, taken) for _, _, _, _, name, n, taken in audit]


def _digest(columns: list[str]):
    return F.xxhash64(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def _of_rows(df: DataFrame) -> str:
    """A digest of all rows, whatever their order."""
    r = df.agg(F.bit_xor(_digest(df.columns)).alias("x"), F.sum(_digest(df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{(r.x or 0) & (2**64 - 1):016x}-{int(r.s or 0) & (2**64 - 1):016x}"


def write_state(spark: SparkSession, text: str, path: str) -> None:
    """A small state file, replaced as a whole: written beside and renamed over, so that a reader finds the old or the new one."""
    fs, place = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    aside = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(aside, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if place.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, place, options)


# ---- proof that stored rows only ever grew ---------------------------------------------------------------------------------------


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files of a table, made where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").rlike(r"/[_.][^/]*$")).select(F.regexp_replace("path", r"^.*?:/+", "/").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def violations(before: DataFrame, now: DataFrame) -> DataFrame:
    """(file, problem): files of an earlier audit that are gone or have other content. An append-only table has none, however much was added."""
    old, new = before.select("file", F.col("sha256").alias("old")), now.select("file", F.col("sha256").alias("new"))
    both = old.join(new, "file", "left").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("file", F.when(F.col("new").isNull(), "removed").otherwise("rewritten").alias("problem"))


def audited(spark: SparkSession, path: str, record: str) -> int:
    """Checks a table against the record of the last audit, and makes the record anew; the number of files. Refuses a table of which a stored file was
    changed or removed, and then leaves the record as it is."""
    now = digests(spark, path)
    if exists(spark, record):
        bad = violations(spark.read.parquet(record), now).limit(5).collect()
        if bad:
            raise ValueError("append-only table was changed: " + ", ".join(f"{r.file} {r.problem}" for r in bad))
    now.write.mode("overwrite").parquet(record + ".new")
    deleted(spark, record)
    moved(spark, record + ".new", record)
    return spark.read.parquet(record).count()
