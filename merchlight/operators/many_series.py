"""Array kernels that fit many day series at once: smoothing, and trend with bends.

A batch of ragged series is padded into one array, and every step of the time loop
works on (series x parameters). Only numpy, no Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Series that one call of the kernel holds as arrays, and days of one product step.
SERIES, CHUNK = 200, 64
#: Shared cells, and pairs of a series and weights of its own, whose arrays stay in cache.
CELLS, TOGETHER = 50, 512
#: Rounds of refinement after the grid.
ROUNDS = 10


# -- Holt-Winters ----------------------------------------------------------------------


class Smoothing:
    """Runs of additive smoothing from zero states, and their responses to the states.

    For given weights the one-step errors are linear in the starting states. The runs
    give the errors of the data from zero states, and the responses to a unit of
    level, trend and the first season slot; that to a later slot is the same, as many
    days later. Their products, added up day by day, are the normal equations.
    """

    def __init__(self, y: np.ndarray, n: np.ndarray, season: int):
        self.y, self.n, self.season = y, n, season

    def solve(self, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least squared error and best starting states for every series and parameter.

        ``params`` is (series or 1, cells, 3): weights of level, trend and season. With
        1 the cells, and so the responses, are those of all series.
        """
        s, (p, c, _) = len(self.y), params.shape
        if p == 1 and s > 1:
            found = [self._solve_shared(params[0, lo:lo + CELLS]) for lo in range(0, c, CELLS)]
            return tuple(np.concatenate(x, axis=1) for x in zip(*found))
        cost, starts = self.solve_own(np.repeat(np.arange(s), c), params.reshape(-1, 3))
        return cost.reshape(s, c), starts.reshape(s, c, -1)

    def _solve_shared(self, params):
        s, days = self.y.shape
        c, _ = params.shape
        season, width = self.season, 2 + self.season
        alpha, beta, gamma = params.T
        trendy = alpha * beta
        # rows 0 to 2: responses of the cells; data are kept apart
        r_level, r_trend = np.zeros((3, c)), np.zeros((3, c))
        r_slots = np.zeros((season, 3, c))
        r_level[0] = r_trend[1] = r_slots[0, 2] = 1.0
        level, trend = np.zeros((s, c)), np.zeros((s, c))
        slots = np.zeros((season, s, c))
        before = np.zeros((c, season - 1))
        gram = np.zeros((c, width, width))
        lengths = np.unique(self.n)
        at_length = np.zeros((len(lengths), c, width, width))
        target, square = np.zeros((s, c, width)), np.zeros((s, c))
        for t0 in range(0, days, CHUNK):
            steps = min(CHUNK, days - t0)
            runs, errors = np.empty((steps, 3, c)), np.empty((steps, s, c))
            for k in range(steps):
                slot = slots[(t0 + k) % season]
                e = errors[k]
                np.subtract(self.y[:, t0 + k, None], level + trend + slot, out=e)
                level = level + trend + alpha * e
                trend = trend + trendy * e
                slot += gamma * e
                slot = r_slots[(t0 + k) % season]
                r = runs[k]
                np.negative(r_level + r_trend + slot, out=r)
                r_level = r_level + r_trend + alpha * r
                r_trend = r_trend + trendy * r
                slot += gamma * r
            valid = np.arange(t0, t0 + steps) < self.n[:, None]         # series, steps
            errors = np.where(valid.T[:, :, None], errors, 0.0).transpose(1, 2, 0)
            square += (errors ** 2).sum(axis=2)
            late = np.concatenate((before, runs[:, 2].T), axis=1)
            before = late[:, steps:]
            full = np.empty((c, steps, width))
            full[..., 0], full[..., 1] = runs[:, 0].T, runs[:, 1].T
            for j in range(season):
                full[..., 2 + j] = late[:, season - 1 - j:season - 1 - j + steps]
            for i in np.flatnonzero((lengths > t0) & (lengths <= t0 + steps)):
                part = full[:, :lengths[i] - t0]
                at_length[i] = gram + part.transpose(0, 2, 1) @ part
            gram += full.transpose(0, 2, 1) @ full
            target += (errors.transpose(1, 0, 2) @ full).transpose(1, 0, 2)
        inverse = _inverse(at_length)[np.searchsorted(lengths, self.n)]
        starts = -(inverse @ target[..., None])[..., 0]
        return np.maximum(square + (starts * target).sum(axis=2), 0.0), starts

    def solve_own(self, rows: np.ndarray, params: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs of a series, by its row, and weights (pairs, 3)."""
        found = [self._solve_own(rows[lo:lo + TOGETHER], params[lo:lo + TOGETHER])
                 for lo in range(0, len(rows), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*found))

    def _solve_own(self, rows, params):
        n, season, p = self.n[rows], self.season, len(rows)
        y, days = np.ascontiguousarray(self.y[rows].T), int(n.max())
        alpha, beta, gamma = np.ascontiguousarray(params.T)
        trendy, width = alpha * beta, 2 + season
        # rows 0 to 2: responses; the last one: the data from zero states
        level, trend, slots = np.zeros((4, p)), np.zeros((4, p)), np.zeros((season, 4, p))
        level[0] = trend[1] = slots[0, 2] = 1.0
        before = np.zeros((p, season - 1))
        gram, target, square = np.zeros((p, width, width)), np.zeros((p, width)), np.zeros(p)
        guess, step = np.empty((4, p)), np.empty((4, p))
        for t0 in range(0, days, CHUNK):
            steps = min(CHUNK, days - t0)
            runs = np.empty((steps, 4, p))
            for k in range(steps):
                slot, e = slots[(t0 + k) % season], runs[k]
                np.add(level, trend, out=level)
                np.add(level, slot, out=guess)
                np.negative(guess, out=e)
                e[3] += y[t0 + k]
                level += np.multiply(alpha, e, out=step)
                trend += np.multiply(trendy, e, out=step)
                slot += np.multiply(gamma, e, out=step)
            late = np.concatenate((before, runs[:, 2].T), axis=1)
            before = late[:, steps:]
            errors = np.ascontiguousarray(runs[:, 3].T)
            full = np.empty((p, steps, width))
            full[..., 0], full[..., 1] = runs[:, 0].T, runs[:, 1].T
            for j in range(season):
                full[..., 2 + j] = late[:, season - 1 - j:season - 1 - j + steps]
            for i in np.flatnonzero(n < t0 + steps):
                full[i, max(n[i] - t0, 0):] = errors[i, max(n[i] - t0, 0):] = 0.0
            square += (errors ** 2).sum(axis=1)
            gram += full.transpose(0, 2, 1) @ full
            target += (errors[:, None, :] @ full)[:, 0]
        starts = -(_inverse(gram) @ target[..., None])[..., 0]
        return np.maximum(square + (starts * target).sum(axis=1), 0.0), starts

    def run(self, params: np.ndarray, starts: np.ndarray):
        """Errors (series, days), and level, trend and slots after each series' last day."""
        s, days = self.y.shape
        alpha, beta, gamma = params.T
        level, trend = starts[:, 0].copy(), starts[:, 1].copy()
        slots = starts[:, 2:].T.copy()
        errors = np.zeros((s, days))
        for t in range(days):
            live = self.n > t
            slot = slots[t % self.season]
            e = np.where(live, self.y[:, t] - (level + trend + slot), 0.0)
            errors[:, t] = e
            level = np.where(live, level + trend, level) + alpha * e
            trend = trend + alpha * beta * e
            slot += gamma * e
        return errors, level, trend, slots


def _inverse(gram: np.ndarray) -> np.ndarray:
    """Pseudo-inverses of the scaled normal equations, scaled back."""
    scale = np.sqrt(np.einsum("...ii->...i", gram))
    scale[scale < 1e-12] = 1.0
    both = scale[..., :, None] * scale[..., None, :]
    return np.linalg.pinv(gram / both, rcond=1e-10, hermitian=True) / both


def _weights(shares: np.ndarray) -> np.ndarray:
    """Weights from shares: of level, of the level's for trend, of the rest for season."""
    a, b, c = (shares[..., i] for i in range(3))
    return np.stack([a, a * b, (1 - a) * c], -1)


def _grid(*axes) -> np.ndarray:
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)


def fit_holt_winters(series: Sequence[np.ndarray], season: int,
                     horizon: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forecast and one-step residuals of every series (each of two seasons at least).

    A common grid of weights, then a search around each series' best cell whose steps
    halve when the centre is best. The result of a series does not depend on others.
    """
    out: list = [None] * len(series)
    order = sorted(range(len(series)), key=lambda i: len(series[i]))
    for lo in range(0, len(order), SERIES):
        some = order[lo:lo + SERIES]
        for i, fitted in zip(some, _fit_some([np.asarray(series[i], float) for i in some],
                                             season, horizon)):
            out[i] = fitted
    return out


def _fit_some(series, season, horizon):
    n = np.array([len(y) for y in series])
    unit = np.array([np.abs(y).max() or 1.0 for y in series])
    padded = np.zeros((len(series), int(n.max())))
    for i, y in enumerate(series):
        padded[i, :n[i]] = y / unit[i]
    smoothing = Smoothing(padded, n, season)
    noise = 1e-11 * (padded ** 2).sum(axis=1)   # what rounding may add to a cost
    rows = np.arange(len(series))

    def first_best(cost):
        least = cost.min(axis=1)
        return np.argmax(cost <= (least * (1 + 1e-9) + noise)[:, None], axis=1)

    shares = _grid([0.0, .05, .1, .2, .35, .5, .7, .9], [0.0, .05, .2, .5, 1.0],
                   [0.0, .05, .2, .5, 1.0])
    weights, same = np.unique(_weights(shares), axis=0, return_inverse=True)
    cost = smoothing.solve(weights[None])[0][:, same.ravel()]
    best = shares[first_best(cost)]
    width = np.tile([0.1, 0.15, 0.15], (len(series), 1))
    around = _grid(*[[-1.0, 0.0, 1.0]] * 3)
    around = around[np.argsort(np.abs(around).sum(axis=1), kind="stable")]      # centre first
    known: list[dict[bytes, float]] = [{} for _ in series]      # costs by weights
    for _ in range(ROUNDS):
        cells = np.clip(best[:, None] + width[:, None] * around, 0.0, 1.0)
        weights = _weights(cells)
        # shares at their bounds, and cells of earlier rounds, give the same weights again
        raw = weights.tobytes()
        keys = [raw[k:k + 24] for k in range(0, len(raw), 24)]
        owner = np.repeat(rows, len(around))
        new = {(i, w): k for k, (i, w) in enumerate(zip(owner.tolist(), keys)) if w not in known[i]}
        if new:
            at = np.fromiter(new.values(), np.int64, len(new))
            costs, _ = smoothing.solve_own(owner[at], weights.reshape(-1, 3)[at])
            for (i, w), x in zip(new, costs.tolist()):
                known[i][w] = x
        cost = np.array([known[i][w] for i, w in zip(owner.tolist(), keys)]) \
            .reshape(len(series), len(around))
        chosen = first_best(cost)
        best = cells[rows, chosen]
        width = np.where((chosen == 0)[:, None], width / 2, width)
    params = _weights(best)
    _, starts = smoothing.solve_own(rows, params)
    errors, level, trend, slots = smoothing.run(params, starts)
    steps = np.arange(1, horizon + 1)
    for i in rows:
        seasonal = slots[(n[i] + steps - 1) % season, i]
        yield ((level[i] + steps * trend[i] + seasonal) * unit[i], errors[i, :n[i]] * unit[i])


# -- trend with bends ------------------------------------------------------------------


def waves(day: np.ndarray, weekly: int, yearly: int) -> np.ndarray:
    """Sine and cosine columns of the week and the year."""
    columns = [f(2 * np.pi * k * day / length)
               for length, terms in ((7.0, weekly), (365.25, yearly))
               for k in range(1, terms + 1) for f in (np.sin, np.cos)]
    return np.column_stack(columns) if columns else np.zeros((len(day), 0))


def soft_path(gram: np.ndarray, target: np.ndarray, penalties: np.ndarray,
              sweeps: int = 40, exact: float = 1e-4) -> np.ndarray:
    """Coefficients of the L1-penalised least squares for falling penalties.

    Coordinate descent on the normal equations, each penalty from the last solution,
    until no step changes the fit by more than ``exact`` of the strongest pull.
    """
    size = np.diag(gram).tolist()
    weights, pull = [0.0] * len(size), target.copy()
    usable = [j for j, g in enumerate(size) if g > 1e-12]
    least = exact * float(np.abs(target).max(initial=0.0))
    out = np.zeros((len(penalties), len(size)))
    for i, penalty in enumerate(penalties.tolist()):
        for _ in range(sweeps):
            most = 0.0
            for j in usable:
                old = weights[j]
                free = float(pull[j]) + size[j] * old
                new = (free - penalty) / size[j] if free > penalty else \
                    (free + penalty) / size[j] if free < -penalty else 0.0
                if new != old:
                    weights[j] = new
                    pull -= gram[j] * (new - old)
                    most = max(most, abs(new - old) * size[j])
            if most <= least:
                break
        out[i] = weights
    return out


def fit_bends(y: np.ndarray, periods: int, candidates: int, weekly: int, yearly: int,
              level: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forecast, its lower and upper bound, and the chosen bends (days, change of slope).

    A linear trend may bend at evenly spaced days of the first 90 %. An L1 penalty
    along a path proposes sets of bends; each set is fitted again without
    penalty, and the set of the least Bayesian criterion is kept, near neighbours being
    merged where that lowers it. The interval takes the quantiles of the residuals,
    each divided by what its own day left it free, and widens with the distance of
    the new day from the fitted ones.
    """
    n = len(y)
    unit = float(np.abs(y).max()) or 1.0
    scaled, day = y / unit, np.arange(n, dtype=float)
    base = np.column_stack([np.ones(n), day / n, waves(day, weekly, yearly)])
    places = np.unique(np.round(np.linspace(0, 0.9 * n, candidates + 2)[1:-1]))
    hinges = np.maximum(day[:, None] - places, 0.0) / n
    q = np.linalg.qr(base)[0]
    left, free = scaled - q @ (q.T @ scaled), hinges - q @ (q.T @ hinges)
    gram, target = free.T @ free, free.T @ left
    top = np.abs(target).max(initial=0.0)
    path = soft_path(gram, target, top * np.geomspace(0.8, 2e-3, 12)) if top > 1e-9 else \
        np.zeros((1, len(places)))

    total, known = float(left @ left), {}

    def criterion(columns: tuple[int, ...]) -> float:
        if columns not in known:
            known[columns] = measure(list(columns))
        return known[columns]

    def measure(columns: list[int]) -> float:
        error = total
        if columns:
            own = target[columns]
            error -= own @ np.linalg.lstsq(gram[np.ix_(columns, columns)], own, rcond=1e-12)[0]
        error = max(float(error), 1e-13 * total, 1e-18 * n)
        return n * np.log(error / n) + 2 * np.log(n) * len(columns)     # a bend: place and slope

    def improved(columns: tuple[int, ...]) -> tuple[float, tuple[int, ...]]:
        score = criterion(columns)
        while True:
            moves = [tuple(sorted({*columns} - {j})) for j in columns]
            moves += [tuple(sorted({*columns} - {j} | {j + d})) for j in columns for d in (-1, 1)
                      if 0 <= j + d < len(places) and j + d not in columns]
            found = min(((criterion(m), m) for m in moves), default=(score, columns))
            if found[0] >= score - 1e-9:
                return score, columns
            score, columns = found

    # only sets that the data can carry, and each only once
    sets = {tuple(np.flatnonzero(np.abs(w) > 1e-9)) for w in path}
    sets = sorted({s for s in sets if len(s) <= max(1, min(8, n // 20))} | {()})
    rough = sorted((criterion(s), s) for s in sets)[:3]
    _, chosen = min(improved(s) for _, s in rough)
    chosen = list(chosen)

    def design(d: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(d)), d / n, waves(d, weekly, yearly),
                                np.maximum(d[:, None] - places[chosen], 0.0) / n])

    past, future = design(day), design(np.arange(n, n + periods, dtype=float))
    weights = np.linalg.lstsq(past, scaled, rcond=None)[0]
    inverse = np.linalg.pinv(past.T @ past, hermitian=True)
    leverage = np.clip(np.einsum("ij,jk,ik->i", past, inverse, past), 0, 0.99)
    reach = np.sqrt(1 + np.einsum("ij,jk,ik->i", future, inverse, future))
    residuals = (scaled - past @ weights) / np.sqrt(1 - leverage)
    low, high = np.quantile(residuals, [(1 - level) / 2, (1 + level) / 2])
    yhat = future @ weights
    bends = np.column_stack([places[chosen], weights[len(weights) - len(chosen):] / n * unit]) \
        if chosen else np.zeros((0, 2))
    return yhat * unit, (yhat + low * reach) * unit, (yhat + high * reach) * unit, bends
