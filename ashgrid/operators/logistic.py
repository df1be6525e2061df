"""Logistic regression by Newton steps from summed gradients and Hessians.

Each step is one pass: every task adds up its rows' share of the gradient and the Hessian with a matrix
product, the shares are added by position, and the driver solves one small system per model.  The
number of steps is fixed, so any engine can repeat the fit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["newton_fit", "fire_probability"]


def _shares(batches, models: dict[int, np.ndarray], size: int):
    """Per model, one row of summed [gradient | Hessian | weight] of the rows of this task."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        cells = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])  # null is NaN
        cells = cells[~np.isnan(cells).any(axis=1)]
        model, y, w = cells[:, 0].astype(int), cells[:, 1], cells[:, 2]
        x = np.column_stack([np.ones(len(y)), cells[:, 3:]])
        for m in np.unique(model):
            i = model == m
            beta = models.get(int(m), np.zeros(size))
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(x[i] @ beta)))
            g = x[i].T @ (w[i] * (y[i] - p))
            h = (x[i] * (w[i] * p * (1 - p))[:, None]).T @ x[i]
            part = np.concatenate([g, h.ravel(), [w[i].sum()]])
            sums[int(m)] = sums[int(m)] + part if int(m) in sums else part
    for m, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([part.tolist()], pa.list_(pa.float64()))], ["model", "part"])


def newton_fit(rows: DataFrame, features: Sequence[str], *, label: str = "label", weight: str = "weight",
               model: str = "model", steps: int = 5, ridge: float = 1e-3) -> dict[int, np.ndarray]:
    """Coefficients (intercept first) per value of ``model``: ``steps`` Newton steps from zero on the mean
    weighted log loss plus ridge / 2 times the squared coefficients.

    Rows with a null or NaN in any used column take no part.  What reaches the driver is one
    gradient and Hessian per model, whatever the rows; a model without rows is absent."""
    size = len(features) + 1
    used = rows.select(F.col(model).cast("int").alias("model"), F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"),
                       *[F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)])
    models: dict[int, np.ndarray] = {}
    for _ in range(steps):
        now = dict(models)
        parts = used.mapInArrow(lambda b: _shares(b, now, size), "model int, part array<double>")
        sums: dict[int, np.ndarray] = {}
        for r in parts.select("model", F.posexplode("part").alias("at", "v")).groupBy("model", "at").agg(F.sum("v").alias("v")).collect():
            sums.setdefault(r.model, np.zeros(size + size * size + 1))[r["at"]] = r.v
        for m, s in sums.items():
            beta = models.get(m, np.zeros(size))
            if s[-1] > 0:
                h = s[size:-1].reshape(size, size) / s[-1] + ridge * np.eye(size)
                models[m] = beta + np.linalg.solve(h, s[:size] / s[-1] - ridge * beta)
    return models


def fire_probability(beta: Column, features: Sequence[str]) -> Column:
    """Probability under the coefficients in the array column ``beta`` (intercept first)."""
    z = beta[0]
    for k, f in enumerate(features):
        z = z + beta[k + 1] * F.col(f).cast("double")
    return 1 / (1 + F.exp(-z))
