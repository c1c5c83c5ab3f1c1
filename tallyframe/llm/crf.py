"""A linear-chain conditional random field over sequences of rows with binary features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """weights: one row a feature, one column a label; steps: from label (row) to label (column)."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """features: for each row the numbers of its features, as many for every row."""
        total = np.zeros((len(features), self.weights.shape[1]))
        for j in range(features.shape[1]):  # one column at a time, so that memory stays that of the scores
            total += self.weights[features[:, j]]
        return total


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the sequences, longest first, and how many sequences reach each step."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    reach = np.bincount(lengths, minlength=int(lengths.max(initial=0)) + 1)[::-1].cumsum()[::-1][1:]
    return starts, reach


def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def _passes(scores: np.ndarray, steps: np.ndarray, lengths: np.ndarray):
    """Forward and backward log sums of all rows, all sequences advancing together."""
    starts, reach = _order(lengths)
    ahead, back = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(reach)):
        rows = starts[: reach[t]] + t
        ahead[rows] += _summed(ahead[rows - 1][:, :, None] + steps, 1)
    for t in range(len(reach) - 1, 0, -1):
        rows = starts[: reach[t]] + t
        back[rows - 1] = _summed(steps + (scores[rows] + back[rows])[:, None, :], 2)
    return ahead, back


def marginals(model: Crf, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The probability of each label of each row, given its whole sequence."""
    if not len(features):
        return np.zeros((0, len(model.steps)))
    ahead, back = _passes(model.scores(features), model.steps, lengths)
    both = ahead + back
    return np.exp(both - _summed(both, 1)[:, None])


def best_labels(model: Crf, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The most probable labels of each sequence (Viterbi)."""
    scores = model.scores(features)
    starts, reach = _order(lengths)
    best, came = scores.copy(), np.zeros(scores.shape, np.int64)
    for t in range(1, len(reach)):
        rows = starts[: reach[t]] + t
        options = best[rows - 1][:, :, None] + model.steps
        came[rows] = options.argmax(axis=1)
        best[rows] += options.max(axis=1)
    labels = np.zeros(len(scores), np.int64)
    lasts = (np.cumsum(lengths) - 1)[lengths > 0]
    labels[lasts] = best[lasts].argmax(axis=1)
    for t in range(len(reach) - 1, 0, -1):
        rows = starts[: reach[t]] + t
        labels[rows - 1] = came[rows, labels[rows]]
    return labels


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int,
        rounds: int = 80, rate: float = 0.2, penalty: float = 1.0, row_weights: np.ndarray | None = None) -> Crf:
    """Penalised maximum likelihood by Adam over all sequences at once; deterministic. No rows: all zero.

    row_weights: how much the features of a row count, one by default.
    """
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)))
    if not len(features):
        return model
    n = len(features)
    same = np.ones(n, bool)
    same[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
    inner = np.flatnonzero(same)
    truth = np.eye(n_labels)[labels]
    weight = np.ones(n) if row_weights is None else row_weights
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (labels[inner - 1], labels[inner]), 1.0)
    moments = [np.zeros(0)] * 2
    for i in range(1, rounds + 1):
        scores = model.scores(features)
        ahead, back = _passes(scores, model.steps, lengths)
        both = ahead + back
        total = _summed(both, 1)
        gap = (truth - np.exp(both - total[:, None])) * weight[:, None]
        up = np.stack([
            sum(np.bincount(features[:, j], gap[:, k], n_features) for j in range(features.shape[1])) for k in range(n_labels)
        ], axis=1)
        pair = np.exp(ahead[inner - 1][:, :, None] + model.steps + (scores[inner] + back[inner])[:, None, :] - total[inner][:, None, None])
        slope = np.concatenate(((up - penalty * model.weights).ravel(), (seen - pair.sum(axis=0) - penalty * model.steps).ravel())) / n
        first, second = (np.zeros_like(slope), np.zeros_like(slope)) if i == 1 else moments
        moments = [0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope]
        move = rate * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.99**i)) + 1e-8)
        model.weights += move[: up.size].reshape(up.shape)
        model.steps += move[up.size :].reshape(model.steps.shape)
    return model
