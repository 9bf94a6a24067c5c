"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """True for vectors that are not null, not zero and hold neither nulls nor non-finite numbers."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(vectors) -> np.ndarray:
    """A series of equally long lists as rows of doubles."""
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaling by the largest component first keeps very small and very large ones apart from 0 and infinity."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a and the row of b beside it; equal rows give equal results wherever they stand."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(out)
    if odd.any():
        out[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1)
    return out
