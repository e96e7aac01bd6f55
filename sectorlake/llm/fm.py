"""Factorisation machine over sets of features, with logistic loss.

score = w0 + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2), the sums over the features of a document: linear time.

Fitting goes in three steps.  The linear weights are fitted over all features with a lasso penalty, so that most become zero.  Then
each pair of the features that are frequent or have large weights is tested: how much more often the pair stands in documents whose
label the weights miss than chance would have it.  Features of such pairs, whatever their own weights, get factors, and weights and
factors are fitted together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PAIRED = 2048  # features whose pairs are tested: half the most frequent ones, half those with the largest weights
FACTORED = 256  # features with factors at most
EVIDENCE = 4.0  # standard deviations that a pair must stand out by


@dataclass
class Machine:
    bias: float
    weight: np.ndarray  # (features,)
    factored: np.ndarray  # the features with factors, sorted
    factor: np.ndarray  # (factored features, rank)

    def raw(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """rows: sorted row numbers, one for each feature of a document; a document may have none."""
        out = self.bias + np.bincount(rows, self.weight[features], n)
        pairs, _ = self.pairs(rows, features, n)
        return out + pairs

    def pairs(self, rows: np.ndarray, features: np.ndarray, n: int) -> tuple[np.ndarray, tuple]:
        """The part of pairs, by the identity, and what its gradient needs: rows, factored features, sums."""
        if not len(self.factored):
            return np.zeros(n), (np.empty(0, np.int64), np.empty(0, np.int64), np.zeros((n, self.factor.shape[1])))
        at = np.minimum(np.searchsorted(self.factored, features), len(self.factored) - 1)
        own = self.factored[at] == features
        rows, at = rows[own], at[own]
        total = np.stack([np.bincount(rows, c[at], n) for c in self.factor.T], 1)
        square = np.bincount(rows, (self.factor**2).sum(1)[at], n)
        return 0.5 * ((total * total).sum(1) - square), (rows, at, total)

    def score(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows, features, n), -30, 30)))


def fit(sets: list[np.ndarray], y: np.ndarray, n_features: int, rank: int = 8, steps: int = 400, epochs: int = 10, rate: float = 0.1, lasso: float = 5e-4, positive_weight: float = 1.0, seed: int = 7, batch: int = 256) -> Machine:
    """Adagrad over mini-batches, in an order that the seed fixes: ``epochs`` of each of both fits, or ``steps`` if that is more."""
    m = Machine(0.0, np.zeros(n_features), np.empty(0, np.int64), np.zeros((0, rank)))
    if not len(y) or y.min() == y.max():  # one class only: a constant
        m.bias = 0.0 if not len(y) else 4.0 if y[0] else -4.0
        return m
    rng = np.random.default_rng(seed)
    count = np.array([len(s) for s in sets])
    begin, flat = np.cumsum(count) - count, np.concatenate(sets).astype(np.int32)
    share = y.mean()
    m.bias = float(np.log(share / (1 - share)))
    cost = np.where(y == 1, positive_weight, 1.0)
    g0, gw, gv = 1e-8, np.full(n_features, 1e-8), np.zeros((0, rank))
    for joint in (False, True):
        if joint:
            m.factored = _interacting(m, flat, begin, count, y, cost)
            if not len(m.factored):
                break
            m.factor = rng.normal(0, 0.01, (len(m.factored), rank))
            gv = np.full(m.factor.shape, 1e-8)
        for _ in range(max(epochs, -(-steps * batch // len(y)))):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                k = count[some]
                features = flat[np.repeat(begin[some] - np.cumsum(k) + k, k) + np.arange(k.sum())]
                rows = np.repeat(np.arange(len(some)), k)
                pairs, (own, at, total) = m.pairs(rows, features, len(some))
                z = m.bias + np.bincount(rows, m.weight[features], len(some)) + pairs
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * cost[some] / len(some)
                m.bias -= rate * (g := error.sum()) / np.sqrt(g0 := g0 + g * g)
                dw = np.bincount(features, error[rows], n_features)
                gw += dw * dw
                step = rate / np.sqrt(gw)
                m.weight -= step * dw
                m.weight = np.sign(m.weight) * np.maximum(np.abs(m.weight) - step * lasso * (dw != 0), 0)
                for f in range(rank if joint else 0):
                    d = np.bincount(at, error[own] * (total[own, f] - m.factor[at, f]), len(m.factored))
                    gv[:, f] += d * d
                    m.factor[:, f] -= rate * d / np.sqrt(gv[:, f])
    return m


def _interacting(m: Machine, flat: np.ndarray, begin: np.ndarray, count: np.ndarray, y: np.ndarray, cost: np.ndarray, block: int = 1024) -> np.ndarray:
    """The features (sorted) of the pairs that stand out most in what the weights miss."""
    n_features = len(m.weight)
    often = np.lexsort((np.arange(n_features), -np.bincount(flat, minlength=n_features)))[: PAIRED // 2]
    large = np.lexsort((np.arange(n_features), -np.abs(m.weight)))[: PAIRED // 2]
    asked = np.union1d(often, large)
    place = np.full(n_features, -1, np.int32)
    place[asked] = np.arange(len(asked))
    sums, squares, held = (np.zeros((len(asked), len(asked)), np.float32) for _ in range(3))
    for lo in range(0, len(y), block):
        k = count[lo : lo + block]
        features = flat[begin[lo] : begin[lo] + k.sum()]
        rows = np.repeat(np.arange(len(k)), k)
        error = ((m.score(rows, features, len(k)) - y[lo : lo + block]) * cost[lo : lo + block]).astype(np.float32)[:, None]
        at = place[features]
        x = np.zeros((len(k), len(asked)), np.float32)
        x[rows[at >= 0], at[at >= 0]] = 1
        held += x.T @ x
        sums += (x * error).T @ x
        squares += (x * error * error).T @ x
    np.sqrt(squares + 1e-6, out=squares)
    out = np.abs(sums, out=sums)
    out /= squares
    out[held < 10] = 0  # too rare to tell
    np.fill_diagonal(out, 0)
    best = out.max(1)
    order = np.lexsort((asked, -best))[:FACTORED]
    return np.sort(asked[order[best[order] >= EVIDENCE]])
