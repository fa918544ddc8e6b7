"""Boosted trees and ridge logistic regression in numpy, step for step as pyspark.ml fits them, for rows that one task
holds. Without sampling the probabilities are pyspark.ml's; with it only the draws differ."""

from __future__ import annotations

import math

import numpy as np

#: Bins of a feature, as GBTClassifier has by default.
BINS = 32
EPSILON = float(np.finfo(float).eps)


def split_points(x: np.ndarray, w: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Ascending thresholds of one feature at about equal weights: halfway between all its values where those are few,
    else between the two whose running weight passes the next share."""
    values, at = np.unique(x, return_inverse=True)
    most = min(bins, len(x)) - 1
    between = (values[1:] + values[:-1]) / 2
    if len(between) <= most:
        return between
    upto = np.cumsum(np.bincount(at, w))
    stride = target = float(w.sum()) / (most + 1)
    found = []
    for k in range(1, len(values)):
        if abs(upto[k - 1] - target) < abs(upto[k] - target):
            found.append(between[k - 1])
            target += stride
    return np.array(found)


def columns_per_node(columns: str, n: int) -> int:
    """How many of n features a node may split on, by featureSubsetStrategy."""
    named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if columns in named:
        return named[columns]
    return min(n, int(columns)) if columns.isdigit() else math.ceil(float(columns) * n)


def _variance(s: np.ndarray) -> np.ndarray:
    """Of (weight, sum, sum of squares) along the first axis; 0 where nothing weighs."""
    n = np.where(s[0] == 0, 1.0, s[0])
    return np.where(s[0] == 0, 0.0, (s[2] - s[1] * s[1] / n) / n)


def _mean(s: np.ndarray) -> np.ndarray:
    return np.where(s[0] == 0, 0.0, s[1] / np.where(s[0] == 0, 1.0, s[0]))


def grow(binned: np.ndarray, cuts: np.ndarray, target: np.ndarray, w: np.ndarray, seen: np.ndarray, depth: int, least: int, k: int, rng: np.random.Generator) -> np.ndarray:
    """A regression tree grown on the rows seen, level by level, as its value at every row.

    binned: (row, feature) bins, cuts: thresholds of each feature. A split has `least` rows on both sides and the
    largest gain in variance among the k features its node drew.
    """
    f, at = binned.shape[1], np.arange(binned.shape[1])
    rows = np.flatnonzero(seen)
    inner, held = binned[rows], np.repeat(np.stack([w[rows], w[rows] * target[rows], w[rows] * target[rows] ** 2]), f, axis=1)
    whole = held[:, ::f].sum(axis=1)
    size = 2 << depth
    value, impurity, split_on, split_at = np.zeros(size), np.zeros(size), np.full(size, -1), np.zeros(size, int)
    still = np.zeros(size, bool)
    value[1], impurity[1], still[1] = _mean(whole), _variance(whole), depth > 0
    node = np.ones(len(binned), int)
    for level in range(depth):
        first = 1 << level
        if not still[first : 2 * first].any():
            break
        own = node[rows]
        live = np.repeat(still[own] & (own >= first), f)
        key = (((own - first)[:, None] * f + at) * BINS + inner).ravel()[live]
        shape = (first, f, BINS)
        left = np.stack([np.bincount(key, x[live], first * f * BINS).reshape(shape) for x in held]).cumsum(axis=3)
        count = np.bincount(key, minlength=first * f * BINS).reshape(shape).cumsum(axis=2)
        right = left[..., -1:] - left
        n = np.where(left[0, ..., -1:] == 0, 1.0, left[0, ..., -1:])
        low, high = _variance(left), _variance(right)
        gain = impurity[first : 2 * first, None, None] - left[0] / n * low - right[0] / n * high
        able = (count >= least) & (count[..., -1:] - count >= least) & (np.arange(BINS) < cuts[:, None])
        if k < f:
            drawn = rng.random((first, f)).argsort(axis=1) < k
            able &= drawn[..., None]
        best = np.where(able, gain, -np.inf).reshape(first, -1)
        place = best.argmax(axis=1)
        for j in np.flatnonzero(still[first : 2 * first] & (best.max(axis=1) > 0)):
            on, cut = divmod(int(place[j]), BINS)
            split_on[first + j], split_at[first + j] = on, cut
            for child, part, spread in ((2 * (first + j), left, low), (2 * (first + j) + 1, right, high)):
                value[child], impurity[child] = _mean(part[:, j, on, cut]), spread[j, on, cut]
                still[child] = abs(impurity[child]) >= EPSILON and level + 1 < depth
        split = np.flatnonzero((split_on[node] >= 0) & (node >= first))
        at_node = node[split]
        node[split] = 2 * at_node + (binned[split, split_on[at_node]] > split_at[at_node])
    return value[node]


def boosted(x: np.ndarray, y: np.ndarray, learn: np.ndarray, trees) -> np.ndarray:
    """Probability of y at every row of x by trees (models.Trees) boosted on the rows to learn from, positives
    weighing negatives / positives."""
    n = int(learn.sum())
    p = int(y[learn].sum())
    w = np.where(y == 1, (n - p) / p if p else 1.0, 1.0)
    sign = np.where(y == 1, 1.0, -1.0)
    points = [split_points(c, w[learn]) for c in x[learn].T]
    binned = np.stack([np.searchsorted(p, c) for p, c in zip(points, x.T)], axis=1)
    cuts = np.array([len(p) for p in points])
    rng, k = np.random.default_rng(trees.seed), columns_per_node(trees.columns, x.shape[1])
    margin = np.zeros(len(x))
    for turn in range(trees.rounds):
        with np.errstate(over="ignore"):
            target = sign if turn == 0 else 4 * sign / (1 + np.exp(2 * sign * margin))
        seen = learn & (rng.random(len(x)) < trees.rows) if trees.rows < 1 else learn
        margin = margin + (1.0 if turn == 0 else trees.rate) * grow(binned, cuts, target, w, seen, trees.depth, trees.least, k, rng)
    return 1 / (1 + np.exp(-2 * margin))


def logistic(x: np.ndarray, y: np.ndarray, learn: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Probability of y at every row of x by logistic regression on standardised features with balanced classes and a
    unit ridge on the slopes: Newton's steps, halved where the loss would grow. One class alone is certain."""
    own, t = x[learn], y[learn].astype(float)
    n, p = len(t), t.sum()
    if p in (0, n):
        return np.full(len(x), float(p > 0))
    spread = own.std(axis=0, ddof=1)
    z = np.where(spread > 0, (x - own.mean(axis=0)) / np.where(spread > 0, spread, 1.0), 0.0)
    z = np.column_stack([np.ones(len(x)), z])
    own, w = z[learn], np.where(t == 1, n / (2 * p), n / (2 * (n - p)))
    ridge = np.append(0.0, np.ones(x.shape[1]))

    def loss(b: np.ndarray) -> float:
        m = own @ b
        return float(w @ (np.logaddexp(0, m) - t * m) + (ridge * b * b).sum() / 2)

    b = np.zeros(z.shape[1])
    now = loss(b)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(own @ b, -700, 700)))
        step = np.linalg.solve((own.T * (w * q * (1 - q))) @ own + np.diag(ridge), own.T @ (w * (q - t)) + ridge * b)
        while (then := loss(b - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if then > now:
            break
        b, now = b - step, then
        if np.abs(step).max() < 1e-10:
            break
    return 1 / (1 + np.exp(-np.clip(z @ b, -700, 700)))
