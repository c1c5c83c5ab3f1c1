"""The fits of series: the one step that runs Python on the executors.

Rows come sorted by series and period and pass once. What expanding folds have in common is summed once:
the regressions of all folds, and the one of the whole series, come from moments of the blocks between
the folds' starts, merged one after the other; the boosted trees of all folds and series of a batch grow
together from one histogram of gradients a level.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from tallyframe.functions.fixed_values import (
    BOOSTED, BOOSTED_DEPTH, BOOSTED_MIN_ROWS, BOOSTING_BINS, BOOSTING_LEAF_ROWS, BOOSTING_RATE, BOOSTING_ROUNDS, FEATURE_COLUMNS, LINEAR,
    MODELS, NAIVE, RIDGE, RIDGE_ALPHA, SEASONAL,
)

FEATURES = list(FEATURE_COLUMNS)
_LAG_1 = FEATURES.index("lag_1")
#: Rows of whole series that are fitted together.
BATCH_ROWS = 16_384
#: Training rows of fits whose trees grow together; some arrays of 15 doubles a row then fit into the cache.
GROUP_ROWS = 8_192
#: Share of the largest eigenvalue, of moments in units of each feature's spread, below which a direction has none.
_NO_SPREAD = 1e-11


@dataclass(frozen=True)
class Moments:
    """What least squares needs of some rows: how many, their means, and products of the distances from these.

    The last column is the target. Moments of two sets of rows merge into those of both.
    """

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, features: np.ndarray, target: np.ndarray) -> Moments:
        rows = np.column_stack([features, target])
        if not len(rows):
            return cls(0, np.zeros(rows.shape[1]), np.zeros((rows.shape[1], rows.shape[1])))
        mean = rows.mean(axis=0)
        apart = rows - mean
        return cls(len(rows), mean, apart.T @ apart)

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if other.n == 0 else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def solve(self, algorithm: str) -> tuple[np.ndarray, float]:
        """Slope and intercept. Ridge shrinks the slope only; least squares takes the shortest of the best slopes."""
        square, cross = self.products[:-1, :-1], self.products[:-1, -1]
        if algorithm == RIDGE:
            square = square + RIDGE_ALPHA * np.eye(len(square))
        spread = np.sqrt(np.diag(square))
        unit = np.where(spread > 0, spread, 1.0)
        scaled, aim = square / np.outer(unit, unit), cross / unit
        if algorithm == RIDGE:
            slope = np.linalg.solve(scaled, aim) / unit
        else:
            size, axes = np.linalg.eigh(scaled)
            real = size > _NO_SPREAD * max(size[-1], 0.0) if len(size) else np.zeros(0, bool)
            slope = axes[:, real] @ ((axes[:, real].T @ aim) / size[real]) / unit
            if not real.all():  # what the rows leave open is chosen so that the slope is shortest
                free = axes[:, ~real] / unit[:, None]
                length = np.sqrt((free * free).sum(axis=0))
                slope = slope - free / length @ np.linalg.lstsq(free / length, slope, rcond=None)[0]
        slope = np.where(spread > 0, slope, 0.0)
        return slope, float(self.mean[-1] - self.mean[:-1] @ slope)


def coefficients(features: np.ndarray, target: np.ndarray, algorithm: str) -> tuple[np.ndarray, float]:
    """Slope and intercept by least squares or ridge over all rows."""
    return Moments.of(features, target).solve(algorithm)


def fold_bounds(n: int) -> list[tuple[int, int]]:
    """First row and end of the test block of each expanding fold over n rows; what comes before it trains."""
    if n < 3:
        return []
    k = min(5, max(2, n // 6), n - 1)
    size = n // (k + 1)
    return [(n - (k - f) * size, n - (k - f - 1) * size) for f in range(k)]


def fold_coefficients(features: np.ndarray, target: np.ndarray, bounds: list[tuple[int, int]], algorithms: Sequence[str]) -> dict:
    """(algorithm, fold) to slope and intercept of the rows before the fold; each row is summed once."""
    out, known, done = {}, Moments.of(features[:0], target[:0]), 0
    for fold, (start, _) in enumerate(bounds):
        known, done = known.merge(Moments.of(features[done:start], target[done:start])), start
        for algorithm in algorithms:
            out[algorithm, fold] = known.solve(algorithm)
    return out


@dataclass
class Trees:
    """Boosted trees of one fit: a start value, and trees of 31 places, the children of place i at 2 i and 2 i + 1."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, row: np.ndarray) -> float:
        tree, place = np.arange(len(self.feature)), np.ones(len(self.feature), np.int64)
        for _ in range(BOOSTED_DEPTH):
            feature = self.feature[tree, place]
            place = np.where(feature < 0, place, 2 * place + (row[feature] > self.threshold[tree, place]))
        return float(self.start + self.value[tree, place].sum())


def bin_edges(column: np.ndarray) -> np.ndarray:
    """Upper ends of the bins of a feature: halfway between its values, or between percentiles of many."""
    known = np.unique(column)
    if len(known) <= BOOSTING_BINS:
        return (known[:-1] + known[1:]) / 2
    return np.unique(np.percentile(column, np.linspace(0, 100, BOOSTING_BINS + 1)[1:-1], method="midpoint"))


def _alike(sizes: Sequence[int], rows: int) -> Iterator[list[int]]:
    """Numbers of the sizes in groups: the largest is at most a third above the least, and all together hold some `rows`."""
    held: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        if held and (3 * sizes[i] > 4 * sizes[held[0]] or (len(held) + 1) * sizes[i] > rows):
            yield held
            held = []
        held.append(i)
    if held:
        yield held


def boost(
    fits: list[tuple[np.ndarray, np.ndarray, int]], keep: bool = False, rounds: int = BOOSTING_ROUNDS,
) -> tuple[list[np.ndarray], list[Trees]]:
    """Boosted trees of many fits at once: predictions of all their rows, and the trees if they are to be kept.

    A fit is (features, target, how many rows at its front train). Fits of like sizes grow together, as
    many as the processor's cache holds.
    """
    starts = [float(y[:n].mean()) for _, y, n in fits]
    live = [i for i, (_, _, n) in enumerate(fits) if n >= 2 * BOOSTING_LEAF_ROWS]  # others have one leaf, their mean
    predictions = [np.full(len(x), start) for (x, _, _), start in zip(fits, starts)]
    places = 1 << (BOOSTED_DEPTH + 1)
    trees = [Trees(start, np.full((0, places), -1, np.int16), np.zeros((0, places)), np.zeros((0, places))) for start in starts]
    for group in _alike([fits[i][2] for i in live], GROUP_ROWS):
        chosen = [live[g] for g in group]
        raw, kept = _grow([fits[i] for i in chosen], [starts[i] for i in chosen], keep, rounds)
        for own, i in enumerate(chosen):
            predictions[i] = raw[own]
            if keep:
                trees[i] = Trees(starts[i], *kept[own])
    return predictions, trees


def _running(values: np.ndarray) -> np.ndarray:
    """Running sums along the first axis, in place."""
    for i in range(1, len(values)):
        np.add(values[i - 1], values[i], out=values[i])
    return values


def _grow(fits: list[tuple[np.ndarray, np.ndarray, int]], starts: list[float], keep: bool, rounds: int) -> tuple[list[np.ndarray], list]:
    """Predictions and trees of fits that all have rows for a split.

    Features are put into bins once, and the training rows of a fit sorted once by the bin of each feature.
    In each round the trees of all fits grow level by level: running sums of the gradients in that order
    give the gain of every split between two bins, and the best one of each node is taken, the first
    feature and lowest bin among equals. Leaves hold 20 rows or more, so most fits stop early.
    """
    n_features, n_fits = fits[0][0].shape[1], len(fits)
    places, least = 1 << (BOOSTED_DEPTH + 1), BOOSTING_LEAF_ROWS
    edges = [[bin_edges(x[:n, f]) for f in range(n_features)] for x, _, n in fits]
    codes = [np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(own)]) for (x, _, _), own in zip(fits, edges)]
    sizes, trained = np.array([len(x) for x, _, _ in fits]), np.array([n for _, _, n in fits])
    begins, longest = np.cumsum(sizes) - sizes, int(trained.max())
    code = np.concatenate(codes)
    total_rows = len(code)
    unit = np.repeat(np.arange(n_fits), sizes)
    train = np.arange(total_rows) - begins[unit] < trained[unit]
    target = np.concatenate([y for _, y, _ in fits])
    raw = np.repeat(starts, sizes)
    # rows of each fit in the order of each feature; behind the last comes a row that weighs nothing
    order = np.full((longest, n_fits, n_features), total_rows, np.int64)
    sorted_code = np.full((longest, n_fits, n_features), -1, np.int64)
    for i, own in enumerate(codes):
        n = trained[i]
        rank = np.argsort(own[:n], axis=0, kind="stable")
        order[:n, i] = begins[i] + rank
        sorted_code[:n, i] = np.take_along_axis(own[:n], rank, axis=0)
    # splits lie behind the places from least - 1 to longest - least - 1, between rows of different bins
    span = slice(least - 1, longest - least)
    cut = sorted_code[span] < sorted_code[least : longest - least + 1]
    kept = [(np.full((rounds, places), -1, np.int16), np.zeros((rounds, places)), np.zeros((rounds, places))) for _ in fits] if keep else []
    gradient = np.zeros(total_rows + 1)
    place = np.zeros(total_rows + 1, np.int64)
    learning = np.flatnonzero(train)

    def weights(left_n: np.ndarray, n: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right_n = n[:, None] - left_n
        fair = between & (left_n >= least) & (right_n >= least)
        return fair / np.maximum(left_n, 1.0), fair / np.maximum(right_n, 1.0)

    root_left = np.broadcast_to(np.arange(float(least), longest - least + 1)[:, None, None], cut.shape)
    root_weights = weights(root_left, trained, cut)
    for step in range(rounds):
        gradient[:-1] = (raw - target).astype(np.float32)
        place[:-1] = 1
        owner, spot, n = np.arange(n_fits), np.ones(n_fits, np.int64), trained  # of every node: its fit, its place, its rows
        for depth in range(BOOSTED_DEPTH):
            if depth:
                mine = order.take(owner, axis=1)
                inside = (place.take(mine) == spot[:, None]).astype(np.float64)
                sums = gradient.take(mine)
                sums *= inside
                left_n = _running(inside)[span]
                weight = weights(left_n, n, cut.take(owner, axis=1))
            else:
                left_n, weight = root_left, root_weights
                sums = gradient.take(order)
            total = _running(sums)[-1, :, 0]
            left = sums[span]
            right = total[:, None] - left
            np.multiply(right, right, out=right)
            right *= weight[1]
            gain = left * left
            gain *= weight[0]
            gain += right  # what the squared error falls by, but for the node's own share
            every, by_feature = np.arange(len(owner)), gain.max(axis=0)
            feature = by_feature.argmax(axis=1)
            taken = np.flatnonzero(by_feature[every, feature] > total * total / n)
            if not len(taken):
                break
            feature = feature[taken]
            at = gain[:, taken, feature].argmax(axis=0)
            fit, parent = owner[taken], spot[taken]
            bins = sorted_code[at + least - 1, fit, feature]
            if keep:
                for i, p, f, b in zip(fit.tolist(), parent.tolist(), feature.tolist(), bins.tolist()):
                    kept[i][0][step, p], kept[i][1][step, p] = f, edges[i][f][b]
            number = np.full(n_fits * places, -1)
            number[fit * places + parent] = np.arange(len(taken))
            split = number[unit * places + place[:-1]]
            moved = np.flatnonzero(split >= 0)
            split = split[moved]
            place[moved] = 2 * place[moved] + (code[moved, feature[split]] > bins[split])
            lefts = left_n[at, taken, feature].astype(np.int64)
            rights = n[taken] - lefts
            owner, spot, n = np.concatenate([fit, fit]), np.concatenate([2 * parent, 2 * parent + 1]), np.concatenate([lefts, rights])
            large = n >= 2 * least
            owner, spot, n = owner[large], spot[large], n[large]
            if not len(owner):
                break
        leaf = unit * places + place[:-1]
        size = n_fits * places
        learnt = leaf[learning]
        count = np.bincount(learnt, minlength=size)
        value = -BOOSTING_RATE * np.bincount(learnt, gradient[learning], size) / np.maximum(count, 1)
        raw = raw + value[leaf]
        if keep:
            for own in range(n_fits):
                kept[own][2][step] = value[own * places : (own + 1) * places]
    return np.split(raw, np.cumsum(sizes)[:-1]), kept


def in_batches(
    batches: Iterator[pa.RecordBatch], names: list[str], function: Callable[[pa.Table, list[int]], pa.Table], rows: int = BATCH_ROWS,
) -> Iterator[pa.RecordBatch]:
    """Apply a function to whole series, many at a time, in batches that are sorted by the names.

    It is given a table and the places where its series begin, and the table's length. A series may go on
    into the next batch, so the last one always waits for it.
    """
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += len(batch)
        if size >= rows:
            table = pa.concat_tables(held).combine_chunks()
            starts = _starts(table, names)
            if len(starts) > 1:
                yield from function(table.slice(0, starts[-1]).combine_chunks(), starts).combine_chunks().to_batches()
            held, size = [table.slice(starts[-1])], len(table) - starts[-1]
    if size:
        table = pa.concat_tables(held).combine_chunks()
        yield from function(table, [*_starts(table, names), len(table)]).combine_chunks().to_batches()


def _starts(table: pa.Table, names: list[str]) -> list[int]:
    changes = np.zeros(max(len(table) - 1, 0), dtype=bool)
    for name in names:
        column = table.column(name).combine_chunks()
        before, after = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        gap = pc.is_null(before).to_numpy(zero_copy_only=False) != pc.is_null(after).to_numpy(zero_copy_only=False)
        changes |= differs | gap
    return [0, *(np.flatnonzero(changes) + 1).tolist()]


def matrix(rows: pa.Table) -> np.ndarray:
    return np.column_stack([rows.column(c).to_numpy().astype(float) for c in FEATURES])


def series_predictions(features: np.ndarray, target: np.ndarray, starts: list[int], algorithms: Sequence[str]) -> Iterator[tuple]:
    """(series, fold, algorithm, first row, end, predictions) of every test block of every series.

    Regressions and trees have none where the rows that train are constant, trees none in short series.
    """
    fits, of = [], []
    for series, (a, b) in enumerate(zip(starts, starts[1:])):
        x, y = features[a:b], target[a:b]
        bounds = fold_bounds(b - a)
        varied = [f for f, (start, _) in enumerate(bounds) if start and y[:start].min() != y[:start].max()]
        solved = fold_coefficients(x, y, bounds, [m for m in algorithms if m in (LINEAR, RIDGE)])
        for fold, (start, end) in enumerate(bounds):
            if NAIVE in algorithms:
                yield series, fold, NAIVE, a + start, a + end, np.full(end - start, y[start - 1])
            if SEASONAL in algorithms:
                yield series, fold, SEASONAL, a + start, a + end, x[start:end, _LAG_1]
            if fold not in varied:
                continue
            for algorithm in (LINEAR, RIDGE):
                if algorithm in algorithms:
                    slope, intercept = solved[algorithm, fold]
                    yield series, fold, algorithm, a + start, a + end, x[start:end] @ slope + intercept
            if BOOSTED in algorithms and b - a >= BOOSTED_MIN_ROWS:
                fits.append((x[:end], y[:end], start))
                of.append((series, fold, BOOSTED, a + start, a + end))
    for (*place, start, end), predicted in zip(of, boost(fits)[0] if fits else ()):
        yield *place, start, end, predicted[start - end :]


def fold_predictions(rows: pa.Table, starts: list[int], kept: list[str], algorithms: Sequence[str]) -> pa.Table:
    """Predictions of the test rows of every fold: the kept columns, fold (from 1), actual, algorithm and predicted."""
    features, target = matrix(rows), rows.column("value").to_numpy().astype(float)
    found = list(series_predictions(features, target, starts, algorithms))
    at = np.concatenate([np.arange(a, b) for *_, a, b, _ in found]) if found else np.zeros(0, np.int64)
    sizes = [len(p) for *_, p in found]
    out = rows.select(kept).take(pa.array(at))
    out = out.append_column("fold", pa.array(np.repeat([f + 1 for _, f, *_ in found], sizes).astype(np.int64)))
    out = out.append_column("actual", pa.array(target[at]))
    out = out.append_column("algorithm", pa.array(np.repeat([m for _, _, m, *_ in found], sizes).astype(object), pa.string()))
    return out.append_column("predicted", pa.array(np.concatenate([p for *_, p in found]) if found else np.zeros(0)))


def _errors(actual: np.ndarray, predicted: np.ndarray) -> tuple[float, float, float | None, float | None]:
    n, error, size = len(actual), np.abs(predicted - actual), np.abs(actual) + np.abs(predicted)
    squares = (error * error).sum()
    apart, real = actual - actual.sum() / n, size[size != 0]
    r2 = 1 - squares / (apart * apart).sum() if actual.min() != actual.max() else None
    return error.sum() / n, math.sqrt(squares / n), r2, (2 * error[size != 0] / real).sum() / len(real) * 100 if len(real) else None


def fold_scores(rows: pa.Table, starts: list[int], kept: list[str], algorithms: Sequence[str] = MODELS, states: bool = False) -> pa.Table:
    """For each series and model the means of its folds' errors: mae, rmse, r2, smape and n_folds.

    With states also the periods and feature rows of the series and the state to forecast from. Trees are
    fitted on all rows only where no other model has a lower error, as they could not be chosen.
    """
    features, target = matrix(rows), rows.column("value").to_numpy().astype(float)
    errors: dict[tuple[int, str], list] = {}
    for series, _, algorithm, a, b, predicted in series_predictions(features, target, starts, algorithms):
        errors.setdefault((series, algorithm), []).append(_errors(target[a:b], predicted))
    keys = sorted(errors)
    out = rows.select(kept).take(pa.array([starts[s] for s, _ in keys], pa.int64()))
    out = out.append_column("algorithm", pa.array([m for _, m in keys], pa.string()))
    for i, name in enumerate(("mae", "rmse", "r2", "smape")):
        means = [[e[i] for e in errors[k] if e[i] is not None] for k in keys]
        out = out.append_column(name, pa.array([float(np.mean(m)) if m else None for m in means], pa.float64()))
    out = out.append_column("n_folds", pa.array([len(errors[k]) for k in keys], pa.int64()))
    if not states:
        return out
    error = {k: float(np.mean([e[0] for e in errors[k]])) for k in keys}
    best: dict[int, float] = {}
    for (s, m), v in error.items():
        if m != BOOSTED:
            best[s] = min(v, best.get(s, v))
    trees = all_trees(features, target, starts, sorted(s for s, m in keys if m == BOOSTED and error[s, m] <= best.get(s, np.inf) + 1e-3))
    periods = rows.column("period").take(pa.array([b - 1 for b in starts[1:]], pa.int64())).to_pylist()
    made = [
        fitted_state(features[(a := starts[s]) : (b := starts[s + 1])], target[a:b], periods[s], m, trees.get(s) if m == BOOSTED else None)
        if m != BOOSTED or s in trees else None for s, m in keys
    ]
    out = out.append_column("periods", pa.array([int(features[starts[s + 1] - 1, 0]) + 1 for s, _ in keys], pa.int64()))
    out = out.append_column("history_periods", pa.array([starts[s + 1] - starts[s] for s, _ in keys], pa.int64()))
    return out.append_column("state", pa.array(made, pa.binary()))


def next_period(period: pd.Timestamp, granularity: str) -> pd.Timestamp:
    step = {"day": pd.DateOffset(days=1), "week": pd.DateOffset(days=7), "month": pd.DateOffset(months=1)}
    return period + step[granularity]


def next_features(values: list[float], mean: float, t: int, period: pd.Timestamp) -> list[float]:
    """Features of the coming period from the values before it, in FEATURE_COLUMNS order."""
    first, second, third = values[-1], values[-2], values[-3]
    recent = np.array(values[-3:])
    return [
        t, first, second, third, recent.mean(), float(np.mean(values[-7:])), recent.std(ddof=1),
        (first - second) / second * 100 if second else 0.0, (second - third) / third * 100 if third else 0.0, mean,
        period.month, period.quarter, period.weekday(), period.isocalendar().week, period.year,
    ]


def fitted_state(features: np.ndarray, target: np.ndarray, period: object, algorithm: str, trees: Trees | None) -> bytes:
    """All that a forecast needs of a series: its latest values, position and running mean, and the model fitted on all rows.

    Plain arrays, so that a task can read it without this package.
    """
    t = features[-1, FEATURES.index("t")]
    mean = (features[-1, FEATURES.index("cumulative_trend")] * t + target[-1]) / (t + 1)
    values = [*features[0, [_LAG_1 + 2, _LAG_1 + 1, _LAG_1]].tolist(), *target.tolist()][-7:]
    model = coefficients(features, target, algorithm) if algorithm in (LINEAR, RIDGE) else None
    if trees is not None:
        model = (trees.start, trees.feature, trees.threshold, trees.value)
    return pickle.dumps((values, int(t), float(mean), str(period), model))


def steps_ahead(state: bytes, algorithm: str, granularity: str, horizon: int, non_negative: bool) -> list[tuple[object, float]]:
    """Period and prediction of each step; each prediction becomes history for the next one.

    Position and running mean go on from the whole series, as they did in training.
    """
    values, t, mean, period, model = pickle.loads(state)
    if model is None and algorithm not in (NAIVE, SEASONAL):
        raise ValueError(f"the state holds no {algorithm} model")
    trees = Trees(*model) if algorithm == BOOSTED else None
    out, period = [], pd.Timestamp(period)
    for _ in range(horizon):
        period = next_period(period, granularity)
        t += 1
        if algorithm in (NAIVE, SEASONAL):
            predicted = values[-1]  # repeated, so both baselines are the last value
        else:
            row = np.array(next_features(values, mean, t, period), float)
            predicted = trees.predict(row) if trees else float(row @ model[0] + model[1])
        if non_negative:
            predicted = max(0.0, predicted)
        out.append((period.date(), predicted))
        values.append(predicted)
        mean = (mean * t + predicted) / (t + 1)
    return out


def all_trees(features: np.ndarray, target: np.ndarray, starts: list[int], wanted: Sequence[int]) -> dict[int, Trees]:
    """Boosted trees over all rows of the wanted series."""
    fits = [(features[a:b], target[a:b], b - a) for a, b in ((starts[i], starts[i + 1]) for i in wanted)]
    return dict(zip(wanted, boost(fits, keep=True)[1])) if fits else {}


def forecast_rows(rows: pa.Table, granularity: str, kept: list[str]) -> pa.Table:
    """Forecasts of series given as one row each: algorithm, state, horizon and non_negative."""
    given = [rows.column(c).to_pylist() for c in ("state", "algorithm", "horizon", "non_negative")]
    ahead = [steps_ahead(state, algorithm, granularity, horizon, non_negative) for state, algorithm, horizon, non_negative in zip(*given)]
    out = rows.select(kept).take(pa.array(np.repeat(np.arange(len(ahead)), [len(a) for a in ahead]), pa.int64()))
    return (
        out.append_column("period", pa.array([p for a in ahead for p, _ in a], pa.date32()))
        .append_column("step", pa.array([i for a in ahead for i in range(1, len(a) + 1)], pa.int64()))
        .append_column("predicted", pa.array([v for a in ahead for _, v in a], pa.float64()))
    )


def forecast_series(rows: pa.Table, starts: list[int], granularity: str, kept: list[str]) -> pa.Table:
    """The same for series given by all their rows, on which the chosen model of each is fitted first."""
    features, target = matrix(rows), rows.column("value").to_numpy().astype(float)
    last = rows.take(pa.array([b - 1 for b in starts[1:]], pa.int64()))
    algorithms, periods = last.column("algorithm").to_pylist(), last.column("period").to_pylist()
    trees = all_trees(features, target, starts, [i for i, algorithm in enumerate(algorithms) if algorithm == BOOSTED])
    states = [
        fitted_state(features[a:b], target[a:b], periods[i], algorithms[i], trees.get(i)) for i, (a, b) in enumerate(zip(starts, starts[1:]))
    ]
    return forecast_rows(last.append_column("state", pa.array(states, pa.binary())), granularity, kept)
