"""Operator 12: clustering around centroids with Elkan's bounds, exact on integer vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .exact import as_long, as_matrix, distances, finite, sha256, small, to_each, totals, whole

SCALE, DIMS, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
STATE = "vec_id long, embedding array<double>, cluster int, upper float, lower array<float>"


def up(x: np.ndarray) -> np.ndarray:
    """Doubles as floats that are not smaller."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float32(np.inf)), y)


def down(x: np.ndarray) -> np.ndarray:
    """Doubles that are not negative as floats that are not larger."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float32(0)), y)


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles below and above the square roots of exact squares."""
    if squares.dtype == object:
        low = np.array([float(math.isqrt(int(s))) for s in squares.ravel()]).reshape(squares.shape)
        return np.nextafter(low, 0.0) * (1 - 2**-52), np.nextafter(low + 1.0, np.inf) * (1 + 2**-52)
    root = np.sqrt(squares)
    return np.maximum(np.nextafter(root, 0.0), 0.0), np.nextafter(root, np.inf)


def moves(before: list[list[int]], after: list[list[int]]) -> np.ndarray:
    """How far each centroid moved, rounded up."""
    squares = np.array([sum((p - q) ** 2 for p, q in zip(a, b)) for a, b in zip(before, after)], dtype=object)
    return np.array([0.0 if s == 0 else r for s, r in zip(squares, roots(squares)[1])])


def halves(centroids: list[list[int]]) -> np.ndarray:
    """Half the distance between each two centroids, rounded down."""
    squares = np.array([[sum((p - q) ** 2 for p, q in zip(a, b)) for b in centroids] for a in centroids], dtype=object).reshape(len(centroids), -1)
    return np.nextafter(roots(squares)[0] / 2, 0.0)


def nearest(x: np.ndarray, c: np.ndarray, half: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """(cluster, upper, lower, how many distances were computed) after each row of x has been given to the nearest row of c.

    A centroid is skipped only where the upper bound of the row's own distance is strictly below the row's lower bound for it, or
    below half the distance between the two centroids: then it is farther, and no tie is lost. Bounds are rounded away from
    skipping. Whatever isn't skipped is compared by exact integers, ties to the smaller number.
    """
    cluster, upper, lower = cluster.copy(), upper.astype(np.float64), lower.astype(np.float64)
    best = np.zeros(len(x), dtype=x.dtype)
    tight = np.zeros(len(x), dtype=bool)
    computed = 0

    def unsure(j, rows):
        """Rows for which centroid j can be as near as their own."""
        mine = cluster[rows]
        return rows[(mine != j) & ~(upper[rows] < lower[rows, j]) & ~(upper[rows] < half[mine, j])]

    for j in range(len(c)):
        rows = unsure(j, np.arange(len(x)))
        loose = rows[~tight[rows]]
        if len(loose):
            best[loose] = to_each(x[loose], c[cluster[loose]])
            below, above = roots(best[loose])
            upper[loose], lower[loose, cluster[loose]], tight[loose] = above, below, True
            computed += len(loose)
            rows = unsure(j, rows)
        if len(rows):
            there = distances(x[rows], c[j : j + 1])[:, 0]
            below, above = roots(there)
            lower[rows, j] = below
            computed += len(rows)
            nearer = (there < best[rows]) | ((there == best[rows]) & (j < cluster[rows]))
            won = rows[nearer]
            cluster[won], best[won], upper[won] = j, there[nearer], above[nearer]
    return cluster, upper, lower, computed


def assigned(state: DataFrame, before: list[list[int]], centroids: list[list[int]], scale: int, exact: bool) -> DataFrame:
    """The state after one more assignment. state has each vector's cluster among the centroids before, an upper bound of its distance
    to that one and lower bounds for all; both are moved as far as the centroids moved, then used."""
    moved, half = moves(before, centroids), halves(centroids)

    def run(batches):
        c = as_matrix(centroids, exact)
        for b in batches:
            if not len(b):
                continue
            own = b.cluster.to_numpy()
            upper = np.nextafter(b.upper.to_numpy(dtype=np.float64) + moved[own], np.inf)
            lower = np.maximum(np.nextafter(np.stack(b.lower.to_numpy()).astype(np.float64) - moved[None, :], -np.inf), 0.0)
            cluster, upper, lower, _ = nearest(whole(b.embedding, scale, exact), c, half, own, upper, lower)
            yield pd.DataFrame({"vec_id": b.vec_id, "embedding": b.embedding, "cluster": cluster, "upper": up(upper), "lower": list(down(lower))})

    return state.mapInPandas(run, STATE)


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of vectors(vec_id, embedding).

    Vectors that are null, have another length than dims or hold null or non-finite components are left out. Each becomes integers,
    floor(scale * x). The k vectors with the smallest SHA-256 of "seed:vec_id" start as centroids (all, if there are fewer; ties
    of repeated ids go by components; vectors without an id are never a start). Each round gives every vector to the nearest centroid and moves centroids to the floor of their vectors' means;
    then vectors are assigned once more. Repeated rows are vectors of their own; an empty table, or one in which nothing can
    start, gives no rows. Distances and sums beyond the range of a long are null. More columns of the input are ignored.

    State is kept per vector (cluster, upper bound, k lower bounds) as a table in the shared folder, one per round; the one before is
    removed once the next is written. A round is a map over vectors and sums that tasks make before the shuffle; k x dims numbers reach
    the driver. k centroids and k x k distances go to every task.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(finite(F.col("embedding")) & (F.size("embedding") == dims))
    exact = small(kept, "embedding", scale, dims)
    token = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.where("vec_id is not null").orderBy(token, "embedding").limit(k).collect()
    centroids = [[int(n) for n in whole([r.embedding], scale, False)[0]] for r in first]
    if not centroids:
        return kept.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    zero = F.array_repeat(F.lit(0.0).cast("float"), len(centroids))
    state, before = kept.select("vec_id", "embedding", F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), zero.alias("lower")), centroids

    def groups(b):
        x, own = whole(b.embedding, scale, exact), b.cluster.to_numpy()
        for g in np.unique(own):
            yield int(g), np.ones(int((own == g).sum()), dtype=np.int64), x[own == g]

    old = None
    for _ in range(rounds):
        state = stored(assigned(state, before, centroids, scale, exact), "elkan-state")
        dropped(old)
        old, before = state, centroids
        sums = totals(state.select("embedding", "cluster"), groups)
        centroids = [[s // sums[j][0] for s in sums[j][1]] if j in sums else c for j, c in enumerate(centroids)]
    final = centroids

    def measured(batches):
        c = as_matrix(final, exact)
        for b in batches:
            own = b.cluster.to_numpy()
            d = to_each(whole(b.embedding, scale, exact), c[own]) if len(b) else []
            yield pd.DataFrame({"vec_id": b.vec_id, "cluster": b.cluster, "distance": pd.array([as_long(n) for n in d], dtype="Int64")})

    last = assigned(state, before, final, scale, exact).mapInPandas(measured, "vec_id long, cluster int, distance long")
    last = stored(last, "elkan-clusters")
    dropped(old)
    each = last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count("*").alias("m")).collect()
    known = [r for r in each if r.n == r.m]
    inertia = as_long(sum(r.s for r in known)) if len(known) == len(each) else None
    sums = [(r.cluster, as_long(r.s) if r.n == r.m else None, inertia, sha256(final[r.cluster])) for r in each]
    by_cluster = vectors.sparkSession.createDataFrame(sums, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """DuckDB SQL: the rounds one after another, every distance computed."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS p
  FROM embeddings WHERE len(embedding) = {DIMS} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), p) - 1 AS j, p FROM v WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {CENTROIDS})",
    ]
    near = "SELECT v.rid, arg_min(c.j, (d.d, c.j)) AS j, min(d.d) AS d FROM v, c{0} c, LATERAL (SELECT list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v.p, c.p)])::BIGINT AS d) d GROUP BY v.rid"
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(
            f"""c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN (
  SELECT j, list(q ORDER BY i) AS p FROM (SELECT a.j, u.i, (sum(v.p[u.i]) // count(*) - CASE WHEN sum(v.p[u.i]) < 0 AND sum(v.p[u.i]) % count(*) <> 0 THEN 1 ELSE 0 END)::BIGINT AS q
    FROM v JOIN a{r} a ON v.rid = a.rid, (SELECT unnest(range(1, {DIMS + 1})) AS i) u GROUP BY a.j, u.i) GROUP BY j) m ON c.j = m.j)"""
        )
    steps.append(f"a{ROUNDS} AS MATERIALIZED ({near.format(ROUNDS)})")
    return f"""WITH {", ".join(steps)}
SELECT v.vec_id, a.j::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.p, ',')) AS centroid_sha256
FROM v JOIN a{ROUNDS} a ON v.rid = a.rid JOIN c{ROUNDS} c ON c.j = a.j"""


ORACLE = _sql()
