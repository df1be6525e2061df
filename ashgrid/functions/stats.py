"""Aggregate expressions with defined results on degenerate groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ashgrid.functions.columns import col_of

__all__ = ["present", "safe_corr", "safe_slope", "rmse", "mean_bias", "paired", "weighted_corr", "weighted_slope", "weighted_mean"]


def present(c) -> Column:
    """A numeric column with NaN read as null, so that aggregates skip it."""
    c = col_of(c)
    return F.when(~F.isnan(c.cast("double")), c)


def paired(x, y):
    """Both columns restricted to rows where both are present (NaN counts as missing)."""
    x, y = present(x), present(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def safe_corr(x, y) -> Column:
    """Pearson correlation over paired non-null rows; null for constant or one-row groups.

    ``corr`` under ANSI raises on zero variance, so the ratio is taken with ``try_divide``.
    """
    px, py = paired(x, y)
    return F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))


def safe_slope(y, x) -> Column:
    """Least-squares slope of y on x (with intercept); null when x is constant."""
    py, px = paired(y, x)
    return F.try_divide(F.covar_pop(px, py), F.var_pop(px))


def rmse(truth, est) -> Column:
    return F.sqrt(F.avg(F.pow(present(truth) - present(est), 2)))


def mean_bias(truth, est) -> Column:
    return F.avg(present(truth) - present(est))


def weighted_mean(c, w) -> Column:
    """Mean of ``c`` where every row counts ``w`` times."""
    c = present(c)
    return F.try_divide(F.sum(c * w), F.sum(F.when(c.isNotNull(), w)))


def _centred(x, y, w):
    """Weighted sums of the products of deviations (xx, yy, xy), and whether each side varies."""
    px, py = paired(x, y)
    n = F.sum(F.when(px.isNotNull(), w))
    sx, sy = F.sum(px * w), F.sum(py * w)
    dev = lambda a, b, sa, sb: F.sum(a * b * w) - F.try_divide(sa * sb, n)
    return (dev(px, px, sx, sx), dev(py, py, sy, sy), dev(px, py, sx, sy)), (F.min(px) < F.max(px)), (F.min(py) < F.max(py))


def weighted_corr(x, y, w) -> Column:
    """``safe_corr`` where every row counts ``w`` times."""
    (xx, yy, xy), x_varies, y_varies = _centred(x, y, w)
    return F.when(x_varies & y_varies, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))


def weighted_slope(y, x, w) -> Column:
    """``safe_slope`` where every row counts ``w`` times."""
    (_, xx, xy), _, x_varies = _centred(y, x, w)
    return F.when(x_varies, F.try_divide(xy, xx))
