"""Windows, sequences, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ashgrid.functions.columns import col_of


def cube_key(lat, lon, time, dlat: float = 1.0, dlon: float = 1.0) -> Column:
    """``row_col_yyyyMM`` key of the dlat x dlon degree, one-month cube of a reading."""
    row = F.floor((col_of(lat) + 90) / dlat).cast("long")
    col = F.floor((col_of(lon) + 180) / dlon).cast("long")
    return F.concat_ws("_", row.cast("string"), col.cast("string"), F.date_format(col_of(time), "yyyyMM"))


def best_per_time(images, time: str, forecast_hour: str, tie: list[str]):
    """Per valid time, the image with the lowest forecast hour (ties broken by ``tie``).

    An aggregate (``min_by``) rather than a ranking window, so a busy valid time is combined
    map-side instead of being sorted in one task."""
    order = F.struct(F.col(forecast_hour), *[F.col(c) for c in tie])
    cols = [c for c in images.columns if c != time]
    best = images.groupBy(time).agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_b"))
    return best.select(time, "_b.*")


def sample_n(df, n: int, key: str, seed: int = 42):
    """A fixed-size pseudo-random sample: the ``n`` rows with the smallest seeded modular hash of
    the integer key (ties by key; a top-n, so only n rows per task reach the final merge).  The
    hash is plain integer arithmetic, so any engine draws the same rows.  A table with fewer than
    ``n`` rows is returned whole."""
    prime = 2147483647
    k = F.pmod(F.col(key).cast("long"), F.lit(prime))
    h = F.pmod(F.pmod(k * 48271 + seed * 69621, F.lit(prime)) * 16807 + 12345, F.lit(prime))
    return df.orderBy(h, F.col(key)).limit(n)
