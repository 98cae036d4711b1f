"""A maximum-entropy (logistic) classifier over hashed features, small enough to ship to every task."""

from __future__ import annotations

import numpy as np
import xxhash


def slot(feature: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(feature) % slots


def fit(x: list, y: list[int], slots: int, *, epochs: int = 12, rate: float = 0.3, decay: float = 1e-5, seed: int = 11) -> np.ndarray:
    """Weights by AdaGrad over minibatches; both classes weigh the same.

    Rows of ``x`` (slots) may differ in length.  No rows give weights of 0.
    """
    weights = np.zeros(slots)
    if not x:
        return weights
    flat, size = flattened(x)
    begin = np.cumsum(size) - size
    b = np.array(y, float)
    share = b.mean()
    w = np.where(b == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    square = np.full(slots, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(b))
        for at in range(0, len(b), 256):
            i = order[at : at + 256]
            n = size[i]
            own = flat[np.repeat(begin[i] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            row = np.repeat(np.arange(len(i)), n)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=weights[own], minlength=len(i)), -30, 30)))
            g = np.bincount(own, weights=((p - b[i]) * w[i] / len(i))[row], minlength=slots)
            touched = np.flatnonzero(np.bincount(own, minlength=slots))
            g = g[touched] + decay * weights[touched]
            square[touched] += g * g
            weights[touched] -= rate * g / np.sqrt(square[touched])
    return weights


def flattened(x: list) -> tuple[np.ndarray, np.ndarray]:
    """(all slots one after another, how many each row has)."""
    size = np.fromiter(map(len, x), np.int64, len(x))
    flat = np.concatenate(x) if isinstance(x[0], np.ndarray) else np.fromiter((s for row in x for s in row), np.int64, size.sum())
    return flat, size


def score(x: list, weights: np.ndarray) -> np.ndarray:
    """Log odds of class 1."""
    if not x:
        return np.zeros(0)
    flat, size = flattened(x)
    return np.bincount(np.repeat(np.arange(len(x)), size), weights=weights[flat], minlength=len(x))
