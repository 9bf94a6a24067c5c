"""Exact integer vectors inside tasks, and exact sums of them over all tasks.

Integers of ordinary size are held in doubles, which is exact as long as no sum of squares reaches 2^53; a table with larger
components is computed with Python's integers by the same code, slower and just as exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sums of Python's integers travel as digits of this many bits.
BITS = 40


def finite(v: Column) -> Column:
    """True for vectors that are not null, not empty and hold neither nulls nor non-finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def small(df: DataFrame, v: str, scale: int, dims: int) -> bool:
    """Whether squared distances of floor(scale * v) are exact in doubles, told from the largest component of all rows."""
    most = df.agg(F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))).first()[0]
    return most is None or 4.0 * dims * (scale * most + 1) ** 2 < 2.0**53


def whole(vectors, scale: int, small: bool) -> np.ndarray:
    """Rows of floor(scale * x): integers in doubles, or Python's integers."""
    if not len(vectors):
        return np.zeros((0, 0))
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    if small:
        return np.floor(rows * scale)
    one = lambda x: math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale
    return np.array([[one(float(x)) for x in row] for row in rows], dtype=object)


def as_matrix(rows: list[list[int]], small: bool) -> np.ndarray:
    """Rows of Python's integers as whole() gives them."""
    return np.array(rows, dtype=np.float64 if small else object)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of the rows of x to the rows of c, exact."""
    if x.dtype == object or c.dtype == object:
        return np.array([[sum((p - q) * (p - q) for p, q in zip(a, b)) for b in c] for a in x], dtype=object).reshape(len(x), len(c))
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def to_each(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x to the row of c beside it, exact."""
    return ((x - c) * (x - c)).sum(axis=1)


def as_long(x) -> int | None:
    """An exact integer for a long column; null beyond its range."""
    n = int(x)
    return n if -(1 << 63) <= n < 1 << 63 else None


def digits(n: int) -> Iterator[tuple[int, int]]:
    """(place, digit) of an integer in base 2^BITS; the last digit has the sign."""
    place = 0
    while not -(1 << 62) < n < 1 << 62:
        yield place, n & ((1 << BITS) - 1)
        n, place = n >> BITS, place + 1
    yield place, n


def totals(df: DataFrame, groups: Callable[[pd.DataFrame], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, tuple[int, list[int]]]:
    """(count, sums) by group over all rows of df, exact.

    groups(batch) gives (group, weights, rows) triples of a batch. Each task adds up its own rows and hands on one row per group,
    component and digit; those are summed by a shuffle, so that the driver gets one number per group, component and digit.
    """

    def partial(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for group, weights, rows in groups(batch):
                if rows.dtype == object:
                    added = [sum(int(w) * r for w, r in zip(weights, col)) for col in rows.T]
                else:
                    added = [int(s) for s in weights.astype(np.int64) @ rows.astype(np.int64)]
                n, old = sums.get(group, (0, [0] * rows.shape[1]))
                sums[group] = (n + int(weights.sum()), [a + b for a, b in zip(old, added)])
        out = [(g, at, place, digit) for g, (n, s) in sums.items() for at, value in enumerate([n, *s]) for place, digit in digits(value)]
        yield pd.DataFrame(out, columns=["g", "at", "place", "digit"])

    parts = df.mapInPandas(partial, "g long, at int, place int, digit long")
    found: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("g", "at", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("s")).collect():
        row = found.setdefault(r.g, {})
        row[r.at] = row.get(r.at, 0) + (int(r.s) << (BITS * r.place))
    return {g: (row[0], [row[at] for at in range(1, len(row))]) for g, row in found.items()}


def sha256(numbers) -> str:
    """Lowercase hex digest of decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(n)) for n in numbers).encode()).hexdigest()
