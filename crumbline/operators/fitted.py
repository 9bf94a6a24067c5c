"""Fitted demand models of one item: censored quantile regression and censored Poisson regression, walked forward.

Design matrices are made by Spark, with strictly earlier days only. A model is fitted anew every week on all of the item's earlier days, in one
task that holds that item's rows, one a day. Models of all items together are in pooled.py.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbline.functions.scalars import refit_bucket

from .checkloss import censored_quantile_fit, with_one
from .policies import features, weekday_quantile

COLUMNS = ["level", "trend", *[f"dow{k}" for k in range(2, 8)]]
#: Rows that a fit needs, and the most that is ever advised (fixed values).
LEAST_QUANTILE, LEAST_POISSON, MOST = 40, 60, 60
OUT = "d date, item string, q double, modelled boolean, converged boolean"


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:  # a weekday without rows
        return np.linalg.lstsq(a, b, rcond=None)[0]


def tail_means(rate: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Means of Poisson variables that are known to be at least so much."""
    if not len(rate):
        return rate
    k = np.arange(int(least.max()) + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(1, k[1:])))])
    p = np.exp(k * np.log(rate)[:, None] - rate[:, None] - logs)
    p[k >= least[:, None]] = 0
    below = p.sum(axis=1)
    # Of a tail that can't be told from nothing almost all weight is on its first value.
    return np.where(below > 1 - 1e-9, least + 1.0, (rate - (k * p).sum(axis=1)) / np.maximum(1 - below, 1e-9))


def poisson_fit(x: np.ndarray, y: np.ndarray, censored: np.ndarray, rounds: int = 50, ridge: float = 1e-3, start: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """Maximum likelihood of log-linear rates, where censored rows say "y or more": Newton steps on expected counts (for those rows the
    mean of the upper tail takes the place of y)."""
    x = with_one(x)
    beta = np.zeros(x.shape[1]) if start is None else start.copy()
    if start is None:
        beta[0] = np.log(max(y.mean(), 0.1))
    penalty = np.eye(x.shape[1]) * 2 * ridge
    penalty[0, 0] = 0
    for _ in range(rounds):
        rate = np.exp(np.clip(x @ beta, -20, 20))
        expected = y.astype(float).copy()
        expected[censored] = tail_means(rate[censored], y[censored].astype(int))
        step = _solved((x * rate[:, None]).T @ x + penalty, x.T @ (expected - rate) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            return beta, True
    return beta, False


def poisson_quantile(rate: float, tau: float, most: int = MOST) -> int:
    """The smallest count with at least the chance tau at or below it, most at the utmost."""
    total = 0.0
    for k in range(most):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else 1.0
        if total >= tau:
            return k
    return most


def rounded(q: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(q, 0, MOST) + 0.5)


def item_quantiles(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decisions of one item: every week a fit at each critical ratio asked for. Fewer than LEAST_QUANTILE days, or a fit that doesn't
    converge: the fallback."""
    pdf = pdf.sort_values("d", ignore_index=True)
    x, y = pdf[COLUMNS].to_numpy(float), pdf["sold"].to_numpy(float)
    limit, tau, q = pdf["supply"].astype(float).fillna(np.inf).to_numpy(), pdf["cr"].to_numpy(float), pdf["fallback"].to_numpy(float)
    modelled, converged, last = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool), {}
    for _, rows in pdf.groupby("block").indices.items():
        if rows[0] < LEAST_QUANTILE:
            continue
        for t in np.unique(tau[rows][np.isfinite(tau[rows])]):
            own = rows[tau[rows] == t]
            beta, converged[own], last[t] = censored_quantile_fit(x[: rows[0]], y[: rows[0]], limit[: rows[0]], t, start=last.get(t))
            ok = converged[own[0]]
            if ok:
                q[own], modelled[own] = rounded(with_one(x[own]) @ beta), True
    return pdf[["d", "item"]].assign(q=q, modelled=modelled, converged=converged)


def item_poisson(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("d", ignore_index=True)
    x, y, cen = pdf[COLUMNS].to_numpy(float), pdf["sold"].to_numpy(float), pdf["censored"].to_numpy(bool)
    tau, q = pdf["cr"].to_numpy(float), pdf["fallback"].to_numpy(float)
    modelled, converged, beta = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool), None
    for _, rows in pdf.groupby("block").indices.items():
        if rows[0] < LEAST_POISSON:
            continue
        beta, ok = poisson_fit(x[: rows[0]], y[: rows[0]], cen[: rows[0]], start=beta)
        converged[rows] = ok
        if ok:
            q[rows] = [poisson_quantile(r, t) if np.isfinite(t) else np.nan for r, t in zip(np.exp(np.clip(with_one(x[rows]) @ beta, -20, 20)), tau[rows])]
            modelled[rows] = True
        else:
            beta = None
    return pdf[["d", "item"]].assign(q=q, modelled=modelled, converged=converged)


def fitted_decisions(obs: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """(d, item, q, modelled, converged): decisions of every day with a design row, by models fitted on strictly earlier days; q is the
    fallback quantile where modelled is false, and null where that has no opinion either."""
    f = features(obs.withColumn("fallback", weekday_quantile(8, 3, 0)))
    f = f.select("d", "item", "sold", "supply", "censored", "cr", "fallback", *COLUMNS)
    # A set number of partitions: items with few rows are much work and must not share one.
    f = f.repartition(8 * f.sparkSession.sparkContext.defaultParallelism, "item")
    return f.withColumn("block", refit_bucket(F.col("d"))).groupBy("item").applyInPandas(run, OUT)
