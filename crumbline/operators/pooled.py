"""Pooled demand models: one regression over all items with an intercept for each, fitted anew every week on all earlier days.

What is fitted is a row of shared coefficients and one number per item, for every week (and quantile) at once. A step of Newton's method
needs sums over rows only: each item's rows make their part of them in one task, items' numbers are eliminated there (their part of
the matrix is diagonal), and the shared coefficients are solved from what the tasks' sums add up to. So no task holds more than the
rows of one item at a time, and the driver gets one small matrix per fit, however many rows and items there are.
"""

from __future__ import annotations

import io
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crumbline.functions.scalars import refit_bucket
from crumbline.shared import removed, written

from .checkloss import censored_quantile_fit, with_one
from .policies import features, weekday_quantile

COLUMNS = ["level", "trend", *[f"dow{k}" for k in range(2, 8)]]
#: Quantiles that are fitted; others lie between. Rows that a fit needs, by model. Most that is ever advised. (Fixed values.)
GRID, LEAST_QUANTILE, LEAST_POISSON, MOST = (0.55, 0.65, 0.75, 0.85), 200, 60, 60
#: Rows up to which an exact solver gets all of a quarter's past in one task; more are fitted by sums. Weeks that such a task fits.
WHOLE, WEEKS = 2_000_000, 13
#: Fits whose rows are looked at together in a task.
CHUNK = 64
OUT = "d date, item string, q double, modelled boolean, converged boolean"
HEAD = ("own", "day", "sold", "limit", "censored", "cr", "fallback")


def designed(obs: DataFrame) -> DataFrame:
    """Rows of the design with the week they are decided in and the fallback quantile."""
    f = features(obs.withColumn("fallback", weekday_quantile(8, 3, 0)))
    return f.select("d", "item", F.col("sold").cast("double").alias("sold"), F.col("supply").cast("double").alias("limit"), "censored", "cr", "fallback", *COLUMNS, refit_bucket(F.col("d")).alias("own"))


# ---- what is fitted ---------------------------------------------------------------------------------------------------------------


@dataclass
class Weeks:
    """Weeks with rows, in order; for each: rows and items before it, and the first item before it, whose intercept is the common one."""

    weeks: np.ndarray
    rows: np.ndarray
    items: np.ndarray
    first: list[str | None]


def weeks_of(design: DataFrame) -> Weeks:
    """One row per week reaches the driver."""
    by_week = {r.own: r.n for r in design.groupBy("own").agg(F.count("*").alias("n")).collect()}
    new = {r.own: r for r in design.groupBy("item").agg(F.min("own").alias("own")).groupBy("own").agg(F.count("*").alias("n"), F.min("item").alias("first")).collect()}
    weeks, rows, items, first, seen, known, least = sorted(by_week), [], [], [], 0, 0, None
    for w in weeks:
        rows.append(seen)
        items.append(known)
        first.append(least)
        seen += by_week[w]
        if w in new:
            known += new[w].n
            least = new[w]["first"] if least is None else min(least, new[w]["first"])
    return Weeks(np.array(weeks), np.array(rows), np.array(items), first)


def packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def unpacked(b: bytes) -> np.ndarray:
    return np.load(io.BytesIO(b), allow_pickle=False)


RECORD = "item string, data binary, state binary"


def records(design: DataFrame, columns: list[str], fits: int) -> DataFrame:
    """One row per item: its rows by day, and its numbers for each fit, all 0. An item has one row a day."""
    width = len(columns) + 1 + CROSS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d", ignore_index=True)
        day = pd.to_datetime(pdf["d"]).map(pd.Timestamp.toordinal)
        made = pdf.assign(day=day, limit=pdf["limit"].fillna(np.inf), censored=pdf["censored"].fillna(False))
        data = made[[*HEAD, *columns]].to_numpy(dtype=np.float64)
        return pd.DataFrame({"item": [pdf["item"].iloc[0]], "data": [packed(data)], "state": [packed(np.zeros((width, fits)))]})

    # A set number of partitions, so that few items aren't put into one task because their rows are few: the work is per item and fit.
    return design.repartition(design.sparkSession.sparkContext.defaultParallelism, "item").groupBy("item").applyInPandas(run, RECORD)


# ---- sums of one item -------------------------------------------------------------------------------------------------------------


@dataclass
class Task:
    """What tasks are told: for each fit its week, first item, coefficients, the direction in which they change, how far they go along it, whether
    the last such point was taken, how far away that was, and whether the fit goes on."""

    weeks: np.ndarray
    first: list[str | None]
    theta: np.ndarray
    change: np.ndarray
    active: np.ndarray
    ridge: float
    share: np.ndarray
    taken: np.ndarray
    before: np.ndarray
    tau: np.ndarray | None = None
    smooth: float = 0.0
    chosen: np.ndarray | None = None  # coefficients whose predictions choose rows
    choose: bool = False  # the coefficients choose now


#: Rows of an item's state: its number at the last point taken and its direction; the matrix and right side where it was last looked at; the
#: number whose predictions choose rows; the cross part.
GAMMA, ALONG, DIAGONAL, SIDE, CHOSEN, CROSS = 0, 1, 2, 3, 4, 5


def tail(rate: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score and information by log rate of "least or more" of a Poisson variable, and log R: with R the sum of its upper tail over its first term,
    the mean of the tail is rate + least / R. Where R is too large to tell (the tail is almost all there is) log R is infinite."""
    term, total, slope = np.ones_like(rate), np.ones_like(rate), np.zeros_like(rate)
    j = 0
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        while True:
            j += 1
            term *= rate / (least + j)
            total += term
            slope += j * term
            if j % 8 == 0:
                if not ((term > 1e-17 * total) & (total < 1e100)).any():
                    break
                term[total >= 1e100] = 0.0
        score = least / total
    told = total < 1e100
    return score, np.where(told, score * slope / total, 0.0), np.where(told, np.log(total), np.inf)


def poisson_kernel(task: Task, data: np.ndarray, eta: np.ndarray, fits: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, score, loss) of rows by fits: censored rows say "sold or more". The loss leaves out what doesn't change."""
    rate = np.exp(np.clip(eta, -20, 20))
    y, censored = data[:, HEAD.index("sold")], data[:, HEAD.index("censored")] > 0
    weight, score, lost = rate.copy(), y[:, None] - rate, rate - y[:, None] * eta
    if censored.any():
        mine, least = rate[censored], y[censored][:, None]
        score[censored], info, log_r = tail(mine, np.broadcast_to(least, mine.shape))
        weight[censored] = np.maximum(info, 1e-3 * mine)
        constant = np.array([-math.lgamma(n + 1) for n in y[censored]])[:, None]
        lost[censored] = np.where(np.isinf(log_r), constant, lost[censored] - np.where(np.isinf(log_r), 0.0, log_r))
    return weight, score, lost


def quantile_kernel(task: Task, data: np.ndarray, eta: np.ndarray, fits: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weight, score, 0) of the parabolas that touch the smoothed check loss from above, of log(1 + sold), on the rows that are chosen. Their
    lowest points never raise that loss, so each is taken."""
    y, limit = np.log1p(data[:, HEAD.index("sold")]), np.log1p(data[:, HEAD.index("limit")])
    r = y[:, None] - eta
    weight = 0.5 / (task.smooth + np.abs(r))
    score = r * weight + task.tau[fits][None, :] - 0.5
    if task.chosen is not None:
        x = with_one(data[:, len(HEAD) :])
        out = x @ task.chosen[fits].T + state[CHOSEN, fits][None, :] >= limit[:, None] - 1e-9
        weight[out], score[out] = 0.0, 0.0
    return weight, score, np.zeros_like(eta)


def moved_on(task: Task, kernel: Callable, item: str, data: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, sums, how far its numbers are moved) of one item: its numbers follow the coefficients, then its sums are made anew."""
    m = task.theta.shape[1]
    own = np.array([f != item for f in task.first])
    go = task.active & task.taken
    state[GAMMA, go] += task.before[go] * state[ALONG, go]
    state[ALONG, go] = 0.0
    go &= own & (state[DIAGONAL] > 0)
    state[ALONG, go] = (state[SIDE, go] - (state[CROSS:, go] * task.change[go].T).sum(axis=0)) / state[DIAGONAL, go]
    gamma = state[GAMMA] + np.where(task.active, task.share, 0.0) * state[ALONG]
    theta = task.theta + (np.where(task.active, task.share, 0.0))[:, None] * task.change
    x = with_one(data[:, len(HEAD) :])
    sums = np.zeros((state.shape[1], m * m + m + 3))
    before = np.searchsorted(data[:, 0], task.weeks, side="left")
    live = np.flatnonzero(task.active & (before > 0))
    pairs = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    if task.choose:
        state[CHOSEN, task.active] = gamma[task.active]
        # Two random numbers a row, the same in every step: their sums over chosen rows tell choices apart.
        token = np.random.default_rng(zlib.crc32(item.encode())).integers(0, 2**30, (2, len(x))).astype(np.float64)
    for i in range(0, len(live), CHUNK):
        fits = live[i : i + CHUNK]
        n = int(before[fits].max())
        eta = x[:n] @ theta[fits].T + gamma[fits][None, :]
        there = np.arange(n)[:, None] < before[fits][None, :]
        if task.choose:
            picked = (there & (eta < np.log1p(data[:n, HEAD.index("limit")])[:, None] - 1e-9)).astype(np.float64)
            sums[fits, -3:] = np.column_stack([picked.sum(axis=0), token[0, :n] @ picked, token[1, :n] @ picked])
            continue
        weight, score, lost = (np.where(there, v, 0.0) for v in kernel(task, data[:n], eta, fits, state))
        a, b, h = pairs[:n].T @ weight, x[:n].T @ weight, x[:n].T @ score
        mine = own[fits]
        side = score.sum(axis=0) - 2 * task.ridge * gamma[fits]
        diagonal = weight.sum(axis=0) + 2 * task.ridge
        state[DIAGONAL, fits], state[SIDE, fits], state[CROSS:, fits] = diagonal, side, b
        less = mine / diagonal
        sums[fits, : m * m] = (a - (b[:, None, :] * b[None, :, :]).reshape(m * m, -1) * less).T
        sums[fits, m * m : m * m + m] = (h - b * side * less).T
        sums[fits, -1] = lost.sum(axis=0) + task.ridge * mine * gamma[fits] ** 2
    return state, sums, np.abs(gamma - state[GAMMA])


STEP = RECORD + ", sums binary, moved binary"


def step(found: DataFrame, task: Task, kernel: Callable) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(records, sums by fit, how far numbers moved by fit) of one step over all items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = far = None
        for b in batches:
            out = []
            for item, data, state in zip(b["item"], b["data"], b["state"]):
                state, sums, moved = moved_on(task, kernel, item, unpacked(data), unpacked(state))
                total = sums if total is None else total + sums
                far = moved if far is None else np.maximum(far, moved)
                out.append((item, data, packed(state), None, None))
            yield pd.DataFrame(out, columns=["item", "data", "state", "sums", "moved"])
        if total is not None:
            yield pd.DataFrame([(None, None, None, packed(total), packed(far))], columns=["item", "data", "state", "sums", "moved"])

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = far = None
        for b in batches:
            for s, m in zip(b["sums"], b["moved"]):
                s, m = unpacked(s), unpacked(m)
                total, far = (s, m) if total is None else (total + s, np.maximum(far, m))
        if total is not None:
            yield pd.DataFrame({"sums": [packed(total)], "moved": [packed(far)]})

    made = written(found.mapInPandas(run, STEP), "pooled-step")
    parts = made.where("sums is not null").select("sums", "moved")
    rows = parts.repartition(8).mapInPandas(added, "sums binary, moved binary").collect()  # eight rows at most
    after = made.where("sums is null").select("item", "data", "state")
    after.written_at = made.written_at
    return after, sum(unpacked(r.sums) for r in rows), np.max([unpacked(r.moved) for r in rows], axis=0)


def solved(task: Task, theta: np.ndarray, sums: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The directions in which the coefficients of the fits which change, from the sums at theta."""
    m = theta.shape[1]
    change = np.zeros_like(theta)
    penalty = 2 * task.ridge * np.array([0.0] + [1.0] * (m - 1))
    for f in np.flatnonzero(which):
        a, h = sums[f, : m * m].reshape(m, m) + np.diag(penalty), sums[f, m * m : m * m + m] - penalty * theta[f]
        change[f] = np.linalg.lstsq(a, h, rcond=1e-13)[0]
    return change


# ---- the two models ---------------------------------------------------------------------------------------------------------------


@dataclass
class Fitted:
    found: DataFrame
    task: Task
    converged: np.ndarray
    weeks: Weeks
    columns: list[str]


def poisson_fits(design: DataFrame, columns: list[str] = COLUMNS, least: int = LEAST_POISSON, ridge: float = 1e-3, rounds: int = 40) -> Fitted:
    """Censored Poisson regressions of all weeks, log-linear with an intercept per item, by Newton steps that all weeks take together."""
    w = weeks_of(design)
    fits, m = len(w.weeks), len(columns) + 1
    found = written(records(design, columns, fits), "pooled-records")
    flat = lambda v, kind=float: np.full(fits, v, dtype=kind)
    task = Task(w.weeks, w.first, np.zeros((fits, m)), np.zeros((fits, m)), w.rows >= least, ridge, flat(0), flat(False, bool), flat(0))
    converged, old, lowest = flat(False, bool), found, flat(np.inf)
    for _ in range(rounds):
        if not task.active.any():
            break
        found, sums, moved = step(found, task, poisson_kernel)
        removed(old)
        old = found
        tried = task.theta + task.share[:, None] * task.change
        value = sums[:, -1] + ridge * (tried[:, 1:] ** 2).sum(axis=1)
        moved = np.maximum(moved, np.abs(tried - task.theta).max(axis=1))
        # A point that isn't lower is given up for one half as far; a step too short to change anything is the last one.
        good = task.active & (value <= lowest + 1e-10 * np.abs(value))
        done = task.active & (task.share > 0) & ((good & (moved < 1e-6)) | (task.share < 1e-6))
        task.theta = np.where(good[:, None], tried, task.theta)
        lowest = np.where(good, value, lowest)
        converged |= done
        task.taken, task.before = good, task.share.copy()
        task.change = np.where(good[:, None], solved(task, tried, sums, good), task.change)
        longest = np.abs(task.change).max(axis=1)
        task.share = np.where(good, np.minimum(1.0, 3.0 / np.maximum(longest, 1e-300)), task.share / 2)
        # Items' numbers of a fit that ends stay where they were; the last move was shorter than matters.
        task.active = task.active & ~done
    return Fitted(found, task, converged, w, columns)


def poisson_quantiles(rate: np.ndarray, tau: np.ndarray, most: int = MOST) -> np.ndarray:
    """The smallest count with at least the chance tau at or below it, most at the utmost."""
    k = np.arange(1, most + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(k))])
    chance = np.exp(np.arange(most + 1)[None, :] * np.log(rate)[:, None] - rate[:, None] - logs[None, :])
    return np.minimum((np.cumsum(chance, axis=1) < tau[:, None]).sum(axis=1), most).astype(float)


def answered(fitted: Fitted, answer: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Decisions of all rows. answer(predictions of the row's fits, usable fits, critical ratio) gives q, NaN for none; an item that the fit
    hasn't seen, or a week without a usable fit, gets the fallback."""
    task, per, usable = fitted.task, len(fitted.task.weeks) // max(1, len(fitted.weeks.weeks)), fitted.converged
    weeks = fitted.weeks.weeks

    def run(batches):
        for b in batches:
            for item, data, state in zip(b["item"], b["data"], b["state"]):
                data, state = unpacked(data), unpacked(state)
                x, at = with_one(data[:, len(HEAD) :]), np.searchsorted(weeks, data[:, 0])
                fits = at[:, None] * per + np.arange(per)[None, :]
                first = np.array([f == item for f in task.first])[fits]
                at_all = np.einsum("nm,npm->np", x, task.theta[fits]) + np.where(first, 0.0, state[GAMMA][fits])
                seen = np.searchsorted(data[:, 0], data[:, 0], side="left") > 0
                tau, q = data[:, HEAD.index("cr")], data[:, HEAD.index("fallback")].copy()
                good = usable[fits] & seen[:, None]
                modelled = good.any(axis=1)
                if modelled.any():
                    q[modelled] = answer(at_all[modelled], good[modelled], tau[modelled])
                days = [pd.Timestamp.fromordinal(int(d)).date() for d in data[:, HEAD.index("day")]]
                yield pd.DataFrame({"d": days, "item": item, "q": pd.Series(q).where(np.isfinite(q), None), "modelled": modelled, "converged": good.any(axis=1)})

    return fitted.found.mapInPandas(run, OUT)


def poisson_decisions(obs: DataFrame, columns: list[str] = COLUMNS, least: int = LEAST_POISSON) -> DataFrame:
    """(d, item, q, modelled, converged): the critical-ratio quantile of a Poisson variable with the fitted rate, MOST at the utmost. Fewer than
    least earlier rows, an item without earlier rows or a fit that doesn't converge: the fallback quantile, null where that has no opinion."""

    def answer(at, good, tau):
        known = np.isfinite(tau)
        q = poisson_quantiles(np.exp(np.clip(at[:, 0], -20, 20)), np.where(known, tau, 0.5))
        return np.where(known, q, np.nan)

    return answered(poisson_fits(designed(obs), columns, least), answer)


def poisson_dispersion(obs: DataFrame, columns: list[str] = COLUMNS, least: int = LEAST_POISSON) -> DataFrame:
    """(week, n, dispersion) of each weekly fit on its own rows: the mean of squared errors over rates, 1 if the sales are Poisson; as sold,
    so sold-out days count with what was sold. week is its first day."""
    fitted = poisson_fits(designed(obs), columns, least)
    task, ok = fitted.task, np.flatnonzero(fitted.converged)

    def run(batches):
        n, s = np.zeros(len(ok)), np.zeros(len(ok))
        for b in batches:
            for item, data, state in zip(b["item"], b["data"], b["state"]):
                data, state = unpacked(data), unpacked(state)
                x, y = with_one(data[:, len(HEAD) :]), data[:, HEAD.index("sold")]
                before = np.searchsorted(data[:, 0], task.weeks[ok], side="left")
                for i in range(0, len(ok), CHUNK):
                    f = ok[i : i + CHUNK]
                    rate = np.maximum(np.exp(np.clip(x @ task.theta[f].T + state[GAMMA, f], -20, 20)), 1e-9)
                    there = np.arange(len(x))[:, None] < before[None, i : i + CHUNK]
                    s[i : i + CHUNK] += np.where(there, (y[:, None] - rate) ** 2 / rate, 0.0).sum(axis=0)
                n += before
        yield pd.DataFrame({"week": task.weeks[ok].astype(int), "n": n, "s": s})

    sums = fitted.found.mapInPandas(run, "week long, n double, s double").groupBy("week").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    start = F.date_add(F.lit("0001-01-01").cast("date"), (F.col("week") * 7 - 1).cast("int"))
    return sums.select(start.alias("week"), F.col("n").cast("long").alias("n"), (F.col("s") / F.col("n")).alias("dispersion"))


def between(at: np.ndarray, good: np.ndarray, tau: np.ndarray, most: int = MOST) -> np.ndarray:
    """Quantities at the critical ratios: of the usable fits each at least the one below it, straight lines between them."""
    q = np.full(len(tau), np.nan)
    for i in np.flatnonzero(np.isfinite(tau)):
        grid = np.array(GRID)[good[i]]
        q[i] = np.interp(tau[i], grid, np.maximum.accumulate(np.expm1(at[i][good[i]])))
    return np.where(np.isnan(q), q, np.floor(np.clip(q, 0, most) + 0.5))


def quantile_fits(design: DataFrame, first_rounds: int = 48, rounds: int = 18, turns: int = 25, least: int = LEAST_QUANTILE) -> Fitted:
    """Censored quantile regressions of log(1 + sold), all weeks and GRID, by sums: parabolas that touch the check loss, smoothed by less and
    less, then rows whose prediction is below their limit are chosen and fitted again, until the choice stays or repeats an earlier one."""
    w = weeks_of(design)
    per, m = len(GRID), len(COLUMNS) + 1
    fits = len(w.weeks) * per
    each = lambda a: np.repeat(np.asarray(a), per)
    found = written(records(design, COLUMNS, fits), "pooled-records")
    enough = each(w.rows >= least)
    one = np.ones(fits)
    task = Task(each(w.weeks), [f for f in w.first for _ in GRID], np.zeros((fits, m)), np.zeros((fits, m)), enough.copy(), 1e-6, 0 * one, one > 1, one, np.tile(GRID, len(w.weeks)))
    converged, seen, last, old = one > 1, [set() for _ in range(fits)], None, found
    need = np.maximum(10, each(w.items) + len(COLUMNS) + 2)

    def advanced(choose=False):
        """The sums at the point that the coefficients and items' numbers have come to, which is taken."""
        nonlocal found, old
        task.choose = choose
        found, sums, _ = step(found, task, quantile_kernel)
        removed(old)
        old = found
        task.theta = task.theta + np.where(task.active, task.share, 0.0)[:, None] * task.change
        task.before, task.taken = task.share, task.active.copy()
        return sums

    for turn in range(turns + 1):
        if not task.active.any():
            break
        n = rounds if turn else first_rounds
        for i in range(n):
            task.smooth = 10.0 ** -(1 + 6 * (i + 1) / n) if not turn else 10.0 ** -(3 + 4 * (i + 1) / n)
            sums = advanced()
            task.change, task.share = solved(task, task.theta, sums, task.active), one
        sums = advanced(choose=True)
        # The choice was made where the last directions led; from there the next turn starts, standing still first.
        task.change, task.share = np.zeros_like(task.change), 0 * one
        task.chosen = task.theta.copy() if task.chosen is None else np.where(task.active[:, None], task.theta, task.chosen)
        for f in np.flatnonzero(task.active):
            token = tuple(sums[f, -3:])
            if token[0] < need[f] or turn == turns:
                task.active[f] = False
            elif token in seen[f]:
                converged[f], task.active[f] = token == last[f], False
            seen[f].add(token)
        last = [tuple(v) for v in sums[:, -3:]]
    return Fitted(found, task, converged, w, COLUMNS)


def quantiles_in_tasks(design: DataFrame, least: int = LEAST_QUANTILE) -> DataFrame:
    """The same fits, exact: a task gets the past of WEEKS weeks, all items of it, and fits them one after another."""
    quarter = F.floor(F.col("own") / WEEKS)
    last = design.agg(F.max(quarter)).first()[0]
    if last is None:
        return design.limit(0).select("d", "item", *[F.lit(None).cast(t).alias(c) for c, t in (("q", "double"), ("modelled", "boolean"), ("converged", "boolean"))])
    spread = design.withColumn("quarter", F.explode(F.sequence(quarter, F.lit(last))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "d", "item"], ignore_index=True)
        own = pdf["own"].to_numpy()
        items, codes = np.unique(pdf["item"].to_numpy(dtype=object), return_inverse=True)
        shared, y, limit = pdf[COLUMNS].to_numpy(float), np.log1p(pdf["sold"].to_numpy(float)), np.log1p(pdf["limit"].fillna(np.inf).to_numpy(float))
        tau, out, starts = pdf["cr"].to_numpy(float), [], {}
        quarter = int(pdf["quarter"].iloc[0])
        for week in np.unique(own[own // WEEKS == quarter]):
            n, rows = int((own < week).sum()), np.flatnonzero(own == week)
            q, modelled = pdf["fallback"].to_numpy(float)[rows], np.zeros(len(rows), dtype=bool)
            if n >= least:
                known = np.unique(codes[:n])
                dummies = lambda at: (codes[at][:, None] == known[1:][None, :]).astype(float)
                x, z = np.hstack([shared[:n], dummies(slice(0, n))]), np.hstack([shared[rows], dummies(rows)])
                at, good = np.full((len(rows), len(GRID)), np.nan), np.zeros((len(rows), len(GRID)), dtype=bool)
                for j, t in enumerate(GRID):
                    start = starts.get(j)
                    beta, ok, base = censored_quantile_fit(x, y[:n], limit[:n], t, start=start if start is not None and len(start) == x.shape[1] + 1 else None)
                    starts[j] = base
                    if ok:
                        at[:, j], good[:, j] = with_one(z) @ beta, np.isin(codes[rows], known)
                modelled = good.any(axis=1)
                if modelled.any():
                    q[modelled] = between(at[modelled], good[modelled], tau[rows][modelled])
            out.append(pd.DataFrame({"d": pdf["d"].iloc[rows], "item": pdf["item"].iloc[rows], "q": pd.Series(q, index=rows).where(np.isfinite(q), None), "modelled": modelled, "converged": modelled}))
        return pd.concat(out) if out else pd.DataFrame(columns=["d", "item", "q", "modelled", "converged"])

    return spread.repartition(design.sparkSession.sparkContext.defaultParallelism, "quarter").groupBy("quarter").applyInPandas(run, OUT)


def quantile_decisions(obs: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(d, item, q, modelled, converged): between the fits at GRID that converged, at the row's critical ratio, MOST at the utmost. Without such a
    fit, and for an item without earlier rows, the fallback quantile, null where that has no opinion.

    Up to whole rows are fitted by the exact solver, a quarter's weeks in a task; more by sums, which hold one item at a time and come within about a
    thousandth of the least loss, so that which rows are chosen, and with it whether a fit converges, may differ.
    """
    design = written(designed(obs), "pooled-design")
    if design.count() <= whole:
        return quantiles_in_tasks(design)
    return answered(quantile_fits(design), between)
