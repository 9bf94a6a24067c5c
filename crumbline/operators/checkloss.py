"""Exact quantile regression: the coefficients that minimise the check loss, plain and with censored rows.

The loss is a linear programme. Its dual has one bounded variable per row and is solved by a primal-dual interior point method; then
the rows that the optimum passes through give the coefficients to machine precision. A start near the optimum makes a fit of many
rows one of few: rows far from the start's plane are known to stay on their side and only count by their sums, and that is verified.
"""

from __future__ import annotations

import numpy as np

#: Size of the rows that pull slopes towards 0, so that of several optima one is chosen (columns without rows, collinear ones).
PULL = 1e-7


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def loss(r: np.ndarray, tau: float) -> float:
    return float(np.maximum(tau * r, (tau - 1) * r).sum())


def _longest(v: np.ndarray, dv: np.ndarray) -> float:
    """The longest step along dv that keeps v positive."""
    down = dv < 0
    return min(1.0, 0.99995 * float((-v[down] / dv[down]).min())) if down.any() else 1.0


def interior(x: np.ndarray, y: np.ndarray, target: np.ndarray, top: np.ndarray, rounds: int = 80, close: float = 1e-11) -> np.ndarray:
    """Coefficients b of: maximise y'a over 0 <= a <= top with x'a = target; b belongs to the equations. target is x'(t * top) for a t in (0, 1)."""
    eye = np.eye(x.shape[1])
    b = np.linalg.solve(x.T @ x + 1e-9 * eye, x.T @ y)
    t = float(target[0] / (x[:, 0] @ top)) if abs(x[:, 0] @ top) > 0 else 0.5
    a = min(max(t, 1e-9), 1 - 1e-9) * top
    s = top - a
    r = y - x @ b
    shift = max(1e-3, float(np.abs(r).mean())) * 0.1
    w, z = np.maximum(r, 0) + shift, np.maximum(-r, 0) + shift
    for _ in range(rounds):
        gap = float(z @ a + w @ s)
        if gap <= close * (1 + abs(float(y @ a))):
            break
        q = 1 / (z / a + w / s)
        gram = (x * q[:, None]).T @ x
        gram += eye * (1e-14 * np.trace(gram) + 1e-300)
        miss = target - x.T @ a

        def direction(push):
            """Steps of a and b that keep the equations and change the products of pairs as push says."""
            db = np.linalg.solve(gram, x.T @ (q * (z - w - push)) + miss)
            return q * (x @ db + push - (z - w)), db

        da, db = direction(0.0)
        dz, dw = -z * (1 + da / a), -w * (1 - da / s)
        pa, pd = min(_longest(a, da), _longest(s, -da)), min(_longest(z, dz), _longest(w, dw))
        if min(pa, pd) < 1:
            ahead = float((z + pd * dz) @ (a + pa * da) + (w + pd * dw) @ (s - pa * da))
            mu = gap * (ahead / gap) ** 3 / (2 * len(y))
            push_z, push_w = (mu - da * dz) / a, (mu + da * dw) / s
            da, db = direction(push_z - push_w)
            dz, dw = push_z - z - z * da / a, push_w - w + w * da / s
            pa, pd = min(_longest(a, da), _longest(s, -da)), min(_longest(z, dz), _longest(w, dw))
        a, s, b, z, w = a + pa * da, s - pa * da, b - pd * db, z + pd * dz, w + pd * dw
    return b


def _vertex(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> np.ndarray:
    """b moved onto the rows that it almost passes through, if those tell all coefficients."""
    near = np.argsort(np.abs(y - x @ b), kind="stable")[: 3 * x.shape[1]]
    near = near[np.abs(y - x @ b)[near] < 1e-6 * (1 + np.abs(y).max())]
    if len(near) < x.shape[1]:
        return b
    exact, _, rank, _ = np.linalg.lstsq(x[near], y[near], rcond=1e-10)
    return exact if rank == x.shape[1] else b


def _solved(x: np.ndarray, y: np.ndarray, tau: float, far: np.ndarray | None = None) -> np.ndarray:
    """The optimum over the rows of x, and, with far, over rows that stand for many: far has their slope of the loss, summed (sum of x times
    tau above, of x times tau - 1 below)."""
    k = x.shape[1]
    pull = PULL * np.eye(k)[1:]
    rows, ys = np.vstack([x, pull, -pull]), np.concatenate([y, np.zeros(2 * (k - 1))])
    # The dual of sum of check losses: maximise y'a, -(1 - tau) <= a <= tau, x'a = 0; far rows are constants of the equations. Shifted by 1 - tau.
    target = (1 - tau) * rows.sum(axis=0) - (0 if far is None else far)
    return interior(rows, ys, target, np.ones(len(ys)))


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, the intercept first, that minimise the check loss."""
    x = with_one(x)
    n, k = x.shape
    band = int((n * k) ** (2 / 3))
    if start is not None and 3 * band < n:
        r = y - x @ start
        place = np.searchsorted(np.sort(r), 0.0)
        order = np.argsort(np.abs(np.argsort(np.argsort(r, kind="stable"), kind="stable") - place), kind="stable")
        near = np.zeros(n, dtype=bool)
        near[order[:band]] = True
        above = r > 0
        for _ in range(6):
            up, down = ~near & above, ~near & ~above
            b = _solved(x[near], y[near], tau, tau * x[up].sum(axis=0) - (1 - tau) * x[down].sum(axis=0))
            wrong = ~near & ((y - x @ b > 0) != above)
            if not wrong.any():
                return _better(x, y, tau, b)
            near |= wrong
            if 3 * near.sum() > 2 * n:
                break
    return _better(x, y, tau, _solved(x, y, tau))


def _better(x: np.ndarray, y: np.ndarray, tau: float, b: np.ndarray) -> np.ndarray:
    exact = _vertex(x, y, b)
    return exact if loss(y - x @ exact, tau) <= loss(y - x @ b, tau) * (1 + 1e-12) + 1e-12 else b


def censored_quantile_fit(x: np.ndarray, y: np.ndarray, limit: np.ndarray, tau: float, rounds: int = 25, least: int = 10, start: np.ndarray | None = None) -> tuple[np.ndarray, bool, np.ndarray]:
    """(coefficients, whether it converged, coefficients of the plain fit): repeated fits on the rows whose predicted quantile is below their
    limit, until those stay the same; each row has one, sold out or not. Too few rows: the plain fit, not converged. start only makes it faster."""
    base = beta = quantile_fit(x, y, tau, start)
    kept, before = None, set()
    for _ in range(rounds):
        now = with_one(x) @ beta < limit - 1e-9
        if now.sum() < max(least, x.shape[1] + 2):
            return base, False, base
        if kept is not None and (now == kept).all():
            return beta, True, base
        if now.tobytes() in before:  # it goes round in circles
            return beta, False, base
        before.add(now.tobytes())
        kept, beta = now, quantile_fit(x[now], y[now], tau, beta)
    return beta, False, base
