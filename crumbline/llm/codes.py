"""Operator 13: vectors as short codes, from codebooks fitted on the distinct integer parts and their weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .exact import as_long, as_matrix, distances, finite, sha256, small, totals, whole

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: A part that this share of all vectors has, or more, joins by a broadcast: at most PARTS / OFTEN parts have it. Labels up to
#: this number are broadcast, too; more are joined under SALTS keys each.
OFTEN, LABELS, SALTS = 0.001, 100_000, 32
#: Rows of which distances to all entries are held at a time.
BLOCK = 2048


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the row of c nearest to each row of x, ties to the smaller index; exact."""
    at, d = [], []
    for i in range(0, len(x), BLOCK):
        each = distances(x[i : i + BLOCK], c)
        first = each.argmin(axis=1)
        at.append(first)
        d.append(each[np.arange(len(each)), first])
    return (np.concatenate(at), np.concatenate(d)) if at else (np.zeros(0, dtype=int), np.zeros(0))


def parts_of(v: Column, dims: int, parts: int) -> Column:
    """Array of (pos, part) of a vector."""
    bounds = [dims * i // parts for i in range(parts + 1)]
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.slice(v, a + 1, b - a).alias("part")) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))])


def coded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, often: float = OFTEN, labels: int = LABELS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of vectors(vec_id, embedding, label).

    Vectors that are null, empty or hold null or non-finite components are left out. Components become integers, floor(scale * x), and
    vectors are cut into parts. All vectors are to have the same length: others than that of the vector with the smallest vec_id are left
    out, and parts differ by one component at most where the length can't be cut evenly. A part position's codebook starts with
    the parts of the vectors with the smallest vec_ids (all, if there are fewer; ties of repeated ids go by components, null ids
    come last) and is moved in each round to the floor of the means of what is nearest to each entry; unused entries stay. Repeated rows are vectors of their own,
    null labels are one label, an empty table gives no rows, errors beyond the range of a long are null. More columns are ignored.

    Equal parts of a position are one weighted row, counted before they are shuffled, and the rounds run over those rows; in a round
    each task adds up its own rows, and parts x entries x length / parts numbers reach the driver. Codes come back to the vectors by
    a join on the part. A part that very many vectors share doesn't gather them in one task: such parts are few and are broadcast.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label").where(finite(F.col("v")))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(1).collect()
    if not first:
        return kept.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))])
    dims = len(first[0].v)
    kept = kept.where(F.size("v") == dims)
    exact = small(kept, "v", scale, dims)
    if exact:  # integers take less room than the numbers they come from
        kept = kept.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("int")))
    unit = 1 if exact else scale
    kept = stored(kept.withColumn("row", F.monotonically_increasing_id()), "codes-vectors")
    start = [whole([r.v], unit, False)[0].tolist() for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    bounds = [dims * i // parts for i in range(parts + 1)]
    books = [[[int(n) for n in row[a:b]] for row in start] for a, b in zip(bounds, bounds[1:])]

    each = kept.select("row", F.explode(parts_of(F.col("v"), dims, parts)).alias("p")).select("row", "p.pos", "p.part")
    distinct = stored(each.groupBy("pos", "part").agg(F.count("*").alias("weight")), "codes-parts")

    def groups(books):
        def run(b):
            for pos, rows in b.groupby("pos"):
                x = whole(rows.part, unit, exact)
                at, _ = nearest(x, as_matrix(books[pos], exact))
                weights = rows.weight.to_numpy()
                for entry in np.unique(at):
                    yield int(pos) * entries + int(entry), weights[at == entry], x[at == entry]

        return run

    for _ in range(rounds):
        sums = totals(distinct, groups(books))
        books = [
            [[s // sums[pos * entries + e][0] for s in sums[pos * entries + e][1]] if pos * entries + e in sums else row for e, row in enumerate(book)]
            for pos, book in enumerate(books)
        ]
    final = books

    def measured(batches):
        for b in batches:
            for pos, rows in b.groupby("pos"):
                at, d = nearest(whole(rows.part, unit, exact), as_matrix(final[pos], exact))
                yield pd.DataFrame({"pos": rows.pos, "part": rows.part, "weight": rows.weight, "entry": at, "d": pd.array([as_long(n) for n in d], dtype="Int64")})

    kind = "array<int>" if exact else "array<double>"
    codes = stored(distinct.mapInPandas(measured, f"pos int, part {kind}, weight long, entry int, d long"), "codes-measured")
    dropped(distinct)
    many = max(2.0, often * codes.where("pos = 0").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    hot, rest = codes.where(F.col("weight") >= many).drop("weight"), codes.where(F.col("weight") < many).drop("weight")
    near = each.join(F.broadcast(hot), ["pos", "part"], "left")
    back = near.where("entry is not null").select("row", "pos", "entry", "d").union(near.where("entry is null").drop("entry", "d").join(rest, ["pos", "part"]).select("row", "pos", "entry", "d"))
    digit = [F.max(F.when(F.col("pos") == i, F.lower(F.lpad(F.hex("entry"), max(2, len(f"{entries - 1:x}")), "0")))) for i in range(parts)]
    error = F.when(F.count("d") == parts, F.expr("try_cast(sum(cast(d as decimal(38,0))) as bigint)"))
    by_row = back.groupBy("row").agg(F.concat(*digit).alias("code"), error.alias("error"))
    rows = stored(kept.select("row", "vec_id", "label").join(by_row, "row"), "codes-rows")

    known = F.when(F.count("error") == F.count("*"), F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)"))
    by_label = stored(rows.groupBy("label").agg(known.alias("label_error")).withColumnRenamed("label", "l"), "codes-labels")
    same = F.col("label").eqNullSafe(F.col("l"))
    if by_label.count() <= labels:
        joined = rows.join(F.broadcast(by_label), same)
    else:
        salts = by_label.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("s", F.pmod("row", F.lit(SALTS)).cast("int")).join(salts, same & (F.col("s") == F.col("salt")))
    digest = sha256(n for book in final for row in book for n in row)
    dropped(kept)
    dropped(codes)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """DuckDB SQL: the rounds one after another over all parts of all vectors."""
    width = 16
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS p
  FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"w AS MATERIALIZED (SELECT v.rid, u.pos, v.p[u.pos * {width} + 1 : u.pos * {width} + {width}] AS p FROM v, (SELECT unnest(range({PARTS})) AS pos) u)",
        f"f AS (SELECT rid, row_number() OVER (ORDER BY vec_id, p) - 1 AS j FROM v QUALIFY j < {ENTRIES})",
        "c0 AS MATERIALIZED (SELECT w.pos, f.j, w.p FROM w JOIN f ON w.rid = f.rid)",
    ]
    near = """SELECT w.rid, w.pos, arg_min(c.j, (d.d, c.j)) AS j, min(d.d) AS d FROM w JOIN c{0} c ON w.pos = c.pos,
  LATERAL (SELECT list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(w.p, c.p)])::BIGINT AS d) d GROUP BY w.rid, w.pos"""
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c.pos, c.j, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN (
  SELECT pos, j, list(q ORDER BY i) AS p FROM (SELECT a.pos, a.j, u.i, (sum(w.p[u.i]) // count(*) - CASE WHEN sum(w.p[u.i]) < 0 AND sum(w.p[u.i]) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS q
    FROM w JOIN a{r} a ON w.rid = a.rid AND w.pos = a.pos, (SELECT unnest(range(1, {width + 1})) AS i) u GROUP BY a.pos, a.j, u.i) GROUP BY pos, j) m ON c.pos = m.pos AND c.j = m.j)"""
        )
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(ROUNDS)})")
    steps.append("e AS (SELECT rid, string_agg(printf('%02x', j::BIGINT), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM a{0} GROUP BY rid)".format(ROUNDS))
    steps.append("h AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY pos, j)) AS digest FROM c{0})".format(ROUNDS))
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, e.code, e.error, sum(e.error) OVER (PARTITION BY v.label)::BIGINT AS label_error, h.digest AS codebooks_sha256
FROM v JOIN e ON v.rid = e.rid, h"""


ORACLE = _sql()
