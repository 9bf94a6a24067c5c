"""The exact check-loss solver, and pooled models fitted by sums, against certificates and plain loops."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from crumbline.operators import checkloss as C
from crumbline.operators import pooled as P
from crumbline.operators.economics import with_economics
from crumbline.operators.observations import derived

FIRST = dt.date(2025, 1, 6)


def certified(x, y, tau, b):
    """Whether b is the optimum: it passes through as many rows as it has numbers, and the slopes that those rows must have lie between tau - 1 and tau."""
    r = y - C.with_one(x) @ b
    on = np.argsort(np.abs(r))[: len(b)]
    rest = np.setdiff1d(np.arange(len(y)), on)
    slopes = np.linalg.solve(C.with_one(x)[on].T, -(C.with_one(x)[rest].T @ np.where(r[rest] > 0, tau, tau - 1)))
    return np.abs(r[on]).max() < 1e-9 and (slopes > tau - 1 - 1e-6).all() and (slopes < tau + 1e-6).all()


@pytest.mark.parametrize(("n", "k", "tau"), [(200, 3, 0.5017), (3000, 9, 0.7511), (20_000, 14, 0.8513), (40, 9, 0.6519)])
def test_planted_optima_are_certified(n, k, tau):
    rng = np.random.default_rng(n + k)
    # Quantiles are no round numbers: with columns of 0 and 1 those have several optima.
    x = np.column_stack([rng.normal(size=n), *[(rng.random(n) < 0.2).astype(float) for _ in range(k - 2)]])
    y = 3 + x @ rng.normal(size=k - 1) + rng.standard_t(3, n) * (1 + (x[:, 0] > 0))
    b = C.quantile_fit(x, y, tau)
    assert certified(x, y, tau, b)
    near = C.quantile_fit(x, y, tau, start=b + rng.normal(size=k) * 0.05)
    assert near == pytest.approx(b, abs=1e-6)


@pytest.mark.parametrize("tau", [0.3, 0.55, 0.85])
def test_least_loss_with_ties_and_columns_without_rows(tau):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        x = np.round(rng.normal(size=25) * 2)
        y = np.round(2 + x + rng.normal(size=25))
        least = min(C.loss(y - b[0] - b[1] * x, tau) for i, j in itertools.combinations(range(25), 2) if x[i] != x[j] for b in [np.linalg.solve([[1, x[i]], [1, x[j]]], [y[i], y[j]])])
        b = C.quantile_fit(np.column_stack([x, np.zeros(25), x]), y, tau)
        assert C.loss(y - C.with_one(np.column_stack([x, np.zeros(25), x])) @ b, tau) == pytest.approx(least, abs=1e-5)


def observed(spark, series, supply):
    """series: item -> (first day, demand by day)."""
    rows = []
    for item, (start, demand) in series.items():
        for n, want in enumerate(demand):
            rows.append((FIRST + dt.timedelta(start + n), item, supply[item], 0, int(max(0, supply[item] - want))))
    o = derived(spark.createDataFrame(rows, "d date, item string, made long, refill long, wasted long"))
    return with_economics(o, spark.createDataFrame([(i, 10.0, 2.9) for i in series], "item string, price double, cost double"))


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(4)
    weekday = lambda n: 2 * (n % 7 == 5)
    series = {
        "a": (0, [rng.poisson(50 + weekday(n)) for n in range(200)]), "b": (0, [rng.poisson(3 + weekday(n)) for n in range(200)]),
        "big": (0, [rng.poisson(90) for n in range(200)]), "z": (150, [rng.poisson(2) for n in range(50)]),
    }
    return observed(spark, series, {"a": 55, "b": 5, "big": 95, "z": 4}).cache()


@pytest.fixture(scope="module")
def roomy(spark):
    """Mostly more is supplied than sold, so quantiles can be told; z is new."""
    rng = np.random.default_rng(7)
    level = {"a": 22, "b": 4, "z": 9}
    series = {i: (0 if i != "z" else 80, [int(rng.poisson(v + (n % 7 == 5) * 3)) for n in range(120 if i != "z" else 40)]) for i, v in level.items()}
    return observed(spark, series, {"a": 32, "b": 9, "z": 16}).cache()


def plain_design(shop):
    f = P.designed(shop).toPandas().sort_values(["d", "item"], ignore_index=True)
    return f.assign(limit=f["limit"].astype(float), sold=f["sold"].astype(float))


def dummies(train, rows):
    items = sorted(train["item"].unique())
    return np.column_stack([rows[P.COLUMNS].to_numpy(float), *[(rows["item"] == i).to_numpy(float) for i in items[1:]]]), items


def plain_score(x, y, censored, b, ridge):
    """Slope of the penalised log likelihood, row by row."""
    out = -2 * ridge * b * np.r_[0, np.ones(len(b) - 1)]
    for row, n, c in zip(C.with_one(x), y, censored):
        rate = math.exp(row @ b)
        if c:
            below = sum(math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(n)))
            first = math.exp(n * math.log(rate) - rate - math.lgamma(n + 1)) if n else 0.0
            out = out + row * (first * n / (1 - below))
        else:
            out = out + row * (n - rate)
    return out


def test_poisson_by_sums_is_the_maximum(shop):
    f = plain_design(shop)
    fitted = P.poisson_fits(P.designed(shop))
    state = {r["item"]: P.unpacked(r.state) for r in fitted.found.collect()}
    weeks, checked = fitted.weeks.weeks, 0
    assert fitted.converged[np.array(fitted.weeks.rows) >= 60].all()
    for at in (12, 20, len(weeks) - 1):
        train = f[f["own"] < weeks[at]]
        x, items = dummies(train, train)
        b = np.r_[fitted.task.theta[at], [state[i][P.GAMMA, at] for i in items[1:]]]
        assert np.abs(plain_score(x, train["sold"], train["censored"], b, 1e-3)).max() < 1e-4 * len(train)
        checked += 1
    assert checked == 3 and fitted.weeks.rows[-1] == (f["own"] < weeks[-1]).sum()


def test_poisson_decisions_cap_and_fall_back(shop):
    f = plain_design(shop)
    got = {(r.d, r["item"]): r for r in P.poisson_decisions(shop).collect()}
    assert len(got) == len(f)
    new = [(r, got[r.d, r["item"]]) for _, r in f[f["item"] == "z"].iterrows()]
    unseen = [g for r, g in new if r.own == new[0][0].own]
    assert unseen and not any(g.modelled for g in unseen)  # never the first item's intercept
    assert all(g.modelled and g.q <= 8 for r, g in new if r.own > new[0][0].own)
    last = f["own"].max()
    assert {got[r.d, r["item"]].q for _, r in f[(f["item"] == "big") & (f["own"] == last)].iterrows()} == {60.0}
    assert not any(g.modelled for (d, i), g in got.items() if d < FIRST + dt.timedelta(7))
    assert P.poisson_decisions(shop.where("false")).count() == 0


@pytest.mark.parametrize("rate", [0.3, 2.0, 17.5, 58.0, 400.0])
def test_poisson_quantiles(rate):
    for tau in (0.05, 0.5, 0.71, 0.99):
        total, k = 0.0, 0
        while k < 60 and total + math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) < tau:
            total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
            k += 1
        assert P.poisson_quantiles(np.array([rate]), np.array([tau]))[0] == k


@pytest.mark.parametrize(("rate", "least"), [(2.0, 1), (0.1, 7), (30.0, 12), (5.0, 5), (900.0, 3), (3.0, 0)])
def test_tails(rate, least):
    score, info, log_r = P.tail(np.array([[rate]]), np.array([[float(least)]]))
    chances = np.array([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(least, least + 2000)])
    k, total = np.arange(least, least + 2000), chances.sum()
    assert np.isinf(log_r[0, 0]) or math.exp(log_r[0, 0]) == pytest.approx(total / chances[0])
    mean = (k * chances).sum() / total
    assert score[0, 0] == pytest.approx(mean - rate, abs=1e-7 * (1 + rate))
    assert info[0, 0] == pytest.approx(rate - ((k - mean) ** 2 * chances).sum() / total, abs=1e-6 * (1 + rate))


def test_dispersion_equals_plain_means(shop):
    f = plain_design(shop)
    fitted = P.poisson_fits(P.designed(shop))
    state = {r["item"]: P.unpacked(r.state) for r in fitted.found.collect()}
    got = {r.week: r for r in P.poisson_dispersion(shop).collect()}
    at = len(fitted.weeks.weeks) - 1
    train = f[f["own"] < fitted.weeks.weeks[at]]
    first = fitted.task.first[at]
    eta = C.with_one(train[P.COLUMNS].to_numpy(float)) @ fitted.task.theta[at] + np.array([0.0 if i == first else state[i][P.GAMMA, at] for i in train["item"]])
    row = got[dt.date.fromordinal(int(fitted.weeks.weeks[at]) * 7)]
    assert row.n == len(train) and row.dispersion == pytest.approx(((train["sold"] - np.exp(eta)) ** 2 / np.exp(eta)).mean())


def test_quantiles_of_a_week_equal_plain_fits(roomy):
    f = plain_design(roomy)
    got = {(r.d, r["item"]): r for r in P.quantile_decisions(roomy).collect()}
    assert len(got) == len(f) and sum(r.modelled for r in got.values()) > 50
    unseen = f[(f["item"] == "z") & (f["own"] == f[f["item"] == "z"]["own"].min())]
    assert len(unseen) and not any(got[r.d, r["item"]].modelled for _, r in unseen.iterrows())
    for week in sorted(f["own"].unique())[-8::4]:
        train, ask = f[f["own"] < week], f[f["own"] == week]
        (x, items), z = dummies(train, train), dummies(train, ask)[0]
        fits = [C.censored_quantile_fit(x, np.log1p(train["sold"].to_numpy()), np.log1p(train["limit"].to_numpy()), t) for t in P.GRID]
        good = np.array([ok for _, ok, _ in fits])
        for row, at in zip(ask.itertuples(), C.with_one(z) @ np.array([b for b, _, _ in fits]).T):
            r = got[row.d, row.item]
            assert r.modelled == (good.any() and row.item in items)
            if r.modelled:
                want = np.interp(row.cr, np.array(P.GRID)[good], np.maximum.accumulate(np.expm1(at[good])))
                assert r.q == pytest.approx(math.floor(min(max(want, 0), 60) + 0.5), abs=1.0)


def test_quantiles_by_sums_come_near_the_least_loss(roomy):
    f, fitted = plain_design(roomy), P.quantile_fits(P.designed(roomy), turns=1)
    state = {r["item"]: P.unpacked(r.state) for r in fitted.found.collect()}
    near = 0
    for at, week in enumerate(fitted.weeks.weeks):
        train = f[f["own"] < week]
        if len(train) < 200:
            continue
        x, items = dummies(train, train)
        y, limit = np.log1p(train["sold"].to_numpy()), np.log1p(train["limit"].to_numpy())
        for j, tau in enumerate(P.GRID):
            fit = at * len(P.GRID) + j
            plain = C.quantile_fit(x, y, tau)
            now = C.with_one(x) @ plain < limit - 1e-9
            b = np.r_[fitted.task.theta[fit], [state[i][P.GAMMA, fit] for i in items[1:]]]
            got = C.loss((y - C.with_one(x) @ b)[now], tau)
            least = C.loss((y - C.with_one(x) @ C.quantile_fit(x[now], y[now], tau))[now], tau)
            assert got >= least * (1 - 1e-9)
            near += got <= least * 1.01
    assert near >= 12  # of 16; the others chose a row or two otherwise
    rows = P.answered(fitted, P.between).collect()
    assert len(rows) == len(f) and all(r.q is None or 0 <= r.q <= 60 for r in rows)


def test_each_quantile_stands_alone_and_none_cross():
    at, tau = np.log1p(np.array([[9.0, 5.0, 7.0, 20.0], [9.0, 5.0, 7.0, 20.0], [1.0, 2.0, 3.0, 99.0]])), np.array([0.65, 0.65, 0.9])
    good = np.array([[True] * 4, [False, True, True, False], [True, False, False, True]])
    assert P.between(at, good, tau).tolist() == [9.0, 5.0, 60.0]
    assert np.isnan(P.between(at[:1], good[:1], np.array([np.nan]))).all()
    assert isinstance(pd.Series(P.between(at, good, tau)).iloc[0], float)
