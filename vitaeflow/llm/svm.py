"""Linear support vector machines on a bounded matrix, by gradient steps with momentum."""

import numpy as np


def train_svm(rows: np.ndarray, sign: np.ndarray, steps: int = 250, penalty: float = 1e-4) -> np.ndarray:
    """Weights, the last for a constant, that least exceed the squared hinge; classes count alike.

    ``sign`` is 1 or -1 for each row. With one class only, the constant alone decides.
    """
    return train_svms(rows, sign[:, None], steps, penalty)[0]


def train_svms(rows: np.ndarray, signs: np.ndarray, steps: int = 250, penalty: float = 1e-4) -> np.ndarray:
    """A row of weights for each column of ``signs``, as ``train_svm`` makes them, from matrix products."""
    n, width = rows.shape
    weight = np.zeros((width + 1, signs.shape[1]), np.float32)
    plus = (signs > 0).sum(0)
    one = (plus == 0) | (plus == n)
    weight[-1, one] = signs[0, one] if n else 0.0
    two = np.flatnonzero(~one)
    if not len(two):
        return weight.T.copy()
    sign, plus = signs[:, two], plus[two]
    share = np.where(sign > 0, 0.5 / plus, 0.5 / (n - plus)).astype(np.float32)
    # rows have length 1 and a constant beside, which bounds the curvature by 4
    rate, momentum, now = 0.25, 0.9, weight[:, two]
    step = np.zeros_like(now)
    for _ in range(steps):
        ahead = now + momentum * step
        short = np.maximum(0.0, 1.0 - sign * (rows @ ahead[:-1] + ahead[-1]))
        pull = -2.0 * share * short * sign
        slope = np.concatenate([rows.T @ pull, pull.sum(0)[None]]).astype(np.float32)
        slope[:-1] += penalty * ahead[:-1]
        step = momentum * step - rate * slope
        now = now + step
    weight[:, two] = now
    return weight.T.copy()
