"""Weibull accelerated failure times with a penalty, by damped Newton rounds on sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vulnlake.operators.moments import added, matrix

#: Steps that a round tries at once.
STEPS = [1.0, 0.5, 0.2, 0.05, 0.01, 0.001]


def read(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covariates with a first column of ones, log times, events."""
    return np.column_stack([np.ones(batch.num_rows), matrix(batch["x"], width)]), np.log(batch["t"].to_numpy(zero_copy_only=False)), batch["e"].to_numpy(zero_copy_only=False)


def fit(rows: DataFrame, deviations: np.ndarray, penalizer: float, rounds: int = 60, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Intercept with coefficients, and the shape, of rows (x, t, e) at the optimum of

    mean log-likelihood - penalizer / 2 * sum((coefficient * deviation)^2).

    Neither the intercept nor the shape is penalised.
    """
    width = len(deviations)
    size = width + 2  # intercept, coefficients, log of the shape
    penalty = penalizer * np.array([0.0, *np.asarray(deviations) ** 2, 0.0])

    def likelihoods(at: np.ndarray) -> np.ndarray:
        """Rows, and the log-likelihood at each of several parameter vectors."""

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x, t, e = read(batch, width)
            z = np.exp(at[:, -1:]) * (t - at[:, :-1] @ x.T)
            with np.errstate(over="ignore"):
                return np.concatenate([[len(t)], (e * (z + at[:, -1:] - t) - np.exp(z)).sum(axis=1)])

        return added(rows, part, len(at) + 1)

    def slopes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the log-likelihood."""

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x, t, e = read(batch, width)
            shape = np.exp(at[-1])
            z = shape * (t - x @ at[:-1])
            w = np.exp(z)
            gradient = np.concatenate([-shape * (e - w) @ x, [((e - w) * z + e).sum()]])
            hessian = np.zeros((size, size))
            hessian[:-1, :-1] = -(shape**2) * (x * w[:, None]).T @ x
            hessian[:-1, -1] = hessian[-1, :-1] = (-shape * (e - w) + shape * w * z) @ x
            hessian[-1, -1] = ((e - w) * z - w * z**2).sum()
            return np.concatenate([gradient, hessian.ravel()])

        s = added(rows, part, size + size**2)
        return s[:size], s[size:].reshape(size, size)

    def start(batch: pa.RecordBatch) -> np.ndarray:
        _, t, e = read(batch, width)
        return np.array([len(t), np.exp(t).sum(), e.sum()])

    n, total, events = added(rows, start, 3)
    at = np.zeros(size)
    if not n:
        return at[:-1], 1.0
    at[0] = np.log(total / max(events, 1.0))
    best = -np.inf
    for _ in range(rounds):
        gradient, hessian = slopes(at)
        gradient, hessian = gradient / n - penalty * at, hessian / n - np.diag(penalty)
        values, axes = np.linalg.eigh(hessian)  # steps go up, also where the curve is not concave
        step = axes @ ((axes.T @ gradient) / np.maximum(np.abs(values), 1e-10))
        tried = np.array([at + s * step for s in STEPS])
        found = likelihoods(tried)[1:] / n - (penalty * tried**2).sum(axis=1) / 2
        i = int(np.nanargmax(found))
        if not found[i] > best:
            break
        at, best = tried[i], found[i]
        if np.abs(step).max() < tolerance:
            break
    return at[:-1], float(np.exp(at[-1]))
