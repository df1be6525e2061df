"""Aggregations.

All of them are one ``groupBy`` (partial aggregation on the map side, then a shuffle of
partial states keyed by the group), optionally followed by a small join.  Scalars that a
whole table needs (minimum, maximum, counts) are computed as scalar subqueries, which
Spark runs once and substitutes as literals, so no cross join or driver round-trip is used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.functions.columns import abs_error, ntz_lit, positive_pairs, valid_pairs
from ashgrid.functions.stats import (mean_bias, present, rmse, safe_corr, safe_slope, weighted_corr, weighted_mean,
                                     weighted_slope)
from ashgrid.operators.joins import FirePairs
from ashgrid.operators.ranks import HELD_ROWS, _group_metrics, rank_correlation, rank_correlation_of_groups
from ashgrid.session import cut_lineage

__all__ = [
    "station_spans", "station_count", "unpivot_estimates", "agreement", "agreement_by_year", "agreement_by",
    "log_correlation_by_year", "correlation_by_bin", "count_by_bin", "correlation_above",
    "fires_per_year", "mean_error_by_hour", "mean_by_group", "first_location_by_group",
    "histogram", "density", "share_at_least", "daily_mean_grid", "missing_by_column",
    "band_statistics", "positive_weight", "collect_areas", "fires_in_range", "METRIC_COLUMNS",
]

METRIC_COLUMNS = ["pearson", "log_pearson", "spearman", "rmse", "bias", "slope", "n", "stations"]


def station_spans(df: DataFrame, lat: str = "lat", lon: str = "lon", time: str = "time") -> DataFrame:
    """First and last reading time per station location."""
    return df.groupBy(lat, lon).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def station_count(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Number of distinct (lat, lon) locations, as a one-row table."""
    return df.agg(F.count_distinct(F.col(lat), F.col(lon)).alias("stations"))


def unpivot_estimates(df: DataFrame, truth: str, estimates: Sequence[str],
                      keep: Sequence[str] = ("lat", "lon", "time")) -> DataFrame:
    """Wide readings (one column per estimate) -> long (source, truth, est, keep...)."""
    ids = [truth, *keep]
    long = df.select(*ids, *estimates).unpivot(ids, list(estimates), "source", "est")
    return long.withColumnRenamed(truth, "truth")


def _metric_aggs(lat: str, lon: str, weight: str | None = None):
    t, e = F.col("truth"), F.col("est")
    stations = F.count_distinct(F.col(lat), F.col(lon)).alias("stations")
    if weight is None:
        return [
            safe_corr(t, e).alias("pearson"),
            safe_corr(F.ln(t), F.ln(e)).alias("log_pearson"),
            rmse(t, e).alias("rmse"),
            mean_bias(t, e).alias("bias"),
            safe_slope(t, e).alias("slope"),
            F.count(F.lit(1)).alias("n"),
            stations,
        ]
    w = F.col(weight)
    return [
        weighted_corr(t, e, w).alias("pearson"),
        weighted_corr(F.ln(t), F.ln(e), w).alias("log_pearson"),
        F.sqrt(weighted_mean(F.pow(present(t) - present(e), 2), w)).alias("rmse"),
        weighted_mean(present(t) - present(e), w).alias("bias"),
        weighted_slope(t, e, w).alias("slope"),
        F.sum(w).alias("n"),
        stations,
    ]


def _metrics(long: DataFrame, keys: list[str], lat: str, lon: str, buckets: int | None, weight: str | None = None) -> DataFrame:
    base = long.groupBy(*keys).agg(*_metric_aggs(lat, lon, weight))
    sp = rank_correlation(long, keys, "truth", "est", buckets, weight)
    return base.join(sp, keys, "left")


def agreement(df: DataFrame, truth: str, estimates: Sequence[str], lo: float = 2.0,
              hi: float = 1000.0, lat: str = "lat", lon: str = "lon", buckets: int | None = None,
              weight: str | None = None) -> DataFrame:
    """D3: one row per estimate column: pearson, log_pearson, spearman, rmse,
    bias = mean(truth - est), slope of truth on est, n, stations.

    Rows enter an estimate's subset when truth, estimate and location are present and
    both values lie in [lo, hi].  An estimate with an empty subset keeps its row, all nulls.
    ``weight`` names a whole-number column that says how often a row counts (1 or more).
    """
    keep = (lat, lon) if weight is None else (lat, lon, weight)
    long = unpivot_estimates(df, truth, estimates, keep=keep)
    long = valid_pairs(long, "truth", "est", lo, hi, extra_not_null=(lat, lon))
    m = _metrics(long, ["source"], lat, lon, buckets, weight)
    spark = df.sparkSession
    sources = spark.createDataFrame([(s,) for s in estimates], "source string")
    return sources.join(m, "source", "left").select("source", *METRIC_COLUMNS)


def agreement_by_year(df: DataFrame, truth: str, est: str, time: str = "time", lo: float = 2.0,
                      hi: float = 1000.0, lat: str = "lat", lon: str = "lon",
                      buckets: int | None = None) -> DataFrame:
    """The D3 metrics of one estimate per calendar year; years with no valid rows are
    absent; ordered by year."""
    base = df.select(F.year(time).alias("year"), F.col(truth).alias("truth"), F.col(est).alias("est"), lat, lon)
    base = valid_pairs(base, "truth", "est", lo, hi, extra_not_null=(lat, lon))
    return _metrics(base, ["year"], lat, lon, buckets).select("year", *METRIC_COLUMNS).orderBy("year")


def agreement_by(df: DataFrame | FirePairs, truth: str, est: str, keys: Sequence[str], lo: float = 2.0,
                 hi: float = 1000.0, lat: str = "lat", lon: str = "lon", buckets: int | None = None,
                 most: int = HELD_ROWS) -> DataFrame:
    """D3 metrics of one estimate per arbitrary group (fire, station, season...); groups with
    no valid rows are absent.  Ranks of a large group are computed in ranges of its rows, so a group
    holding most rows is still split across tasks; small groups are ranked whole, many in a task.

    Pairs that are not made yet (``FirePairs``) are made fire by fire in the tasks that work out the fires: no pair is
    shuffled or stored, and a task holds the pairs of a few fires.  Only fires with more than ``most`` pairs
    are worked out as rows are."""
    keys = list(keys)
    if isinstance(df, FirePairs) and keys == df.keys and {truth, est, lat, lon} <= set(df.obs.columns):
        obs = valid_pairs(df.obs.select(*dict.fromkeys([*df.position, lat, lon, truth, est])), truth, est, lo, hi, extra_not_null=(lat, lon))
        schema = T.StructType([*[df.fires.schema[k] for k in keys],
                               *[T.StructField(c, T.LongType() if c in ("n", "stations") else T.DoubleType()) for c in METRIC_COLUMNS]])
        done = cut_lineage(replace(df, obs=obs).each(lambda b: _group_metrics(b, keys, truth, est, [lat, lon], most), schema,
                                                     list(dict.fromkeys([lat, lon, truth, est])), [truth, est]))
        large = done.filter(F.col("n").isNull()).select(*keys)
        if large.isEmpty():
            return done
        rest = agreement_by(df.rows(large), truth, est, keys, lo, hi, lat, lon, buckets)
        return done.filter(F.col("n").isNotNull()).unionByName(rest)
    if isinstance(df, FirePairs):
        df = df.rows()
    base = df.select(*keys, F.col(truth).alias("truth"), F.col(est).alias("est"), lat, lon)
    base = valid_pairs(base, "truth", "est", lo, hi, extra_not_null=(lat, lon))
    sized = cut_lineage(base.groupBy(*keys).agg(*_metric_aggs(lat, lon)))  # one row a group; tells the large ones
    sp = rank_correlation_of_groups(base, keys, "truth", "est", sized, "n", buckets)
    return sized.join(sp, keys, "left").select(*keys, *METRIC_COLUMNS)


def log_correlation_by_year(df: DataFrame, truth: str, est: str, time: str = "time",
                            lo: float = 0.0, hi: float = 100000.0,
                            before_year: int | None = None) -> DataFrame:
    """Pearson correlation of log values per year over the open range (lo, hi)."""
    f = positive_pairs(df, truth, est, time, before_year, lo, hi)
    return (f.groupBy(F.year(time).alias("year"))
             .agg(safe_corr(F.ln(truth), F.ln(est)).alias("log_correlation"))
             .orderBy("year"))


def _bin(c: str, width: float):
    return (F.floor(F.col(c) / width) * width).cast("double")


def correlation_by_bin(df: DataFrame, truth: str, est: str, width: float = 50.0) -> DataFrame:
    """Pearson correlation per truth bin floor(truth / width) * width; undefined bins dropped."""
    return (df.filter(present(truth).isNotNull())
              .groupBy(_bin(truth, width).alias("bin"))
              .agg(safe_corr(est, truth).alias("correlation"))
              .filter(F.col("correlation").isNotNull())
              .orderBy("bin"))


def count_by_bin(df: DataFrame, truth: str, width: float = 50.0) -> DataFrame:
    """Rows per truth bin, ordered by bin."""
    return (df.filter(present(truth).isNotNull())
              .groupBy(_bin(truth, width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy("bin"))


def correlation_above(df: DataFrame, truth: str, est: str, threshold: float = 100.0) -> DataFrame:
    """Pearson correlation over rows with truth > threshold (one row)."""
    return df.filter(present(truth) > threshold).agg(safe_corr(truth, est).alias("correlation"),
                                                  F.count(F.lit(1)).alias("n"))


def fires_per_year(df: DataFrame, fire: str, time: str) -> DataFrame:
    """Distinct fires per year."""
    return (df.groupBy(F.year(time).alias("year"))
              .agg(F.count_distinct(fire).alias("fires")).orderBy("year"))


def mean_error_by_hour(df: DataFrame, truth: str, est: str, time: str = "time") -> DataFrame:
    """Mean absolute error by hour of day."""
    return (df.groupBy(F.hour(time).alias("hour"))
              .agg(F.avg(present(abs_error(truth, est))).alias("mean_abs_error")).orderBy("hour"))


def mean_by_group(df: DataFrame, group: str, truth: str, est: str) -> DataFrame:
    """Mean absolute error, mean truth and mean estimate per fire (or any group)."""
    return df.groupBy(group).agg(
        F.avg(present(abs_error(truth, est))).alias("mean_abs_error"),
        F.avg(present(truth)).alias("mean_truth"),
        F.avg(present(est)).alias("mean_est"))


def first_location_by_group(df: DataFrame, group: str, order: str, lat: str = "lat",
                            lon: str = "lon") -> DataFrame:
    """Per group, the first non-null lat and the first non-null lon in ``order``.

    Row order is made explicit by ``order`` (``first()`` after a shuffle is not deterministic).
    """
    o = F.col(order)
    return df.groupBy(group).agg(
        F.min_by(F.col(lat), F.when(F.col(lat).isNotNull(), o)).alias(lat),
        F.min_by(F.col(lon), F.when(F.col(lon).isNotNull(), o)).alias(lon))


def _scalar(df: DataFrame, expr):
    return df.select(expr).scalar()


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Equal-width counts between min and max of ``c`` (null and NaN skipped); the last bin
    is closed, and a constant column spans [v - 0.5, v + 0.5].  Every bin is returned, empty
    ones with count 0: (bin, lo, hi, n)."""
    vals = df.select(present(c).alias("v")).filter(F.col("v").isNotNull())
    st = vals.select(F.struct(F.min("v").alias("mn"), F.max("v").alias("mx"))).scalar()   # one subquery
    same = st["mn"] == st["mx"]          # constant data: the range is widened by 0.5 each side
    mn = F.when(same, st["mn"] - 0.5).otherwise(st["mn"])
    mx = F.when(same, st["mx"] + 0.5).otherwise(st["mx"])
    width = (mx - mn) / bins
    idx = F.least(F.floor(F.try_divide(F.col("v") - mn, width)), F.lit(bins - 1))
    idx = F.coalesce(idx, F.lit(0)).cast("int")
    counts = vals.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(F.broadcast(counts), "bin", "left")   # at most ``bins`` rows
                .select("bin", (mn + F.col("bin") * width).alias("lo"),
                        (mn + (F.col("bin") + 1) * width).alias("hi"),
                        F.coalesce(F.col("n"), F.lit(0)).alias("n")))


# Kernel sums: moments kept per bin, bins per bandwidth, reach of the kernel in bandwidths.
KERNEL_TERMS, KERNEL_BINS, KERNEL_REACH = 6, 16, 9.0


def density(df: DataFrame, c: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth (sample std * n^(-1/5)) on an even
    grid from min - cut*bw to max + cut*bw: (g, x, density).

    Values are combined into bins a sixteenth of the bandwidth wide; a bin keeps the sums of the first
    six powers of the distance to its middle, from which the kernel sums follow by the Hermite series
    of the Gaussian.  The rest of the series is below 1e-11 / bw and what lies beyond nine
    bandwidths below 1e-17 / bw, so the density is exact to about eleven digits of its scale.  The
    work is n + bins * gridsize; only bins are shuffled and meet grid points.
    """
    vals = df.select(present(c).cast("double").alias("v")).filter(F.col("v").isNotNull())
    st = vals.select(F.struct(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"),
                              F.min("v").alias("mn"), F.max("v").alias("mx"))).scalar()   # one subquery
    n = st["n"]
    bw = st["sd"] * F.pow(n, F.lit(-0.2))
    lo = st["mn"] - bw * cut
    step = (st["mx"] + bw * cut - lo) / (gridsize - 1)
    # in bandwidths from the minimum; a zero bandwidth (constant or single value) has no bins
    gap = (F.try_divide(st["mx"] - st["mn"], bw) + 2 * cut) / (gridsize - 1)
    placed = vals.select(F.try_divide(F.col("v") - st["mn"], bw).alias("u")).select(
        "u", F.round(F.col("u") * KERNEL_BINS).try_cast("long").alias("bin"))
    off = F.col("u") - F.col("bin") / KERNEL_BINS
    power = [F.lit(1.0)]
    for _ in range(1, KERNEL_TERMS):
        power.append(power[-1] * off)
    bins = placed.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        *[(F.sum(p) / math.factorial(k)).alias(f"m{k}") for k, p in enumerate(power)])
    at = F.col("bin") / KERNEL_BINS + cut
    first = F.greatest(F.lit(0), F.ceil((at - KERNEL_REACH) / gap).cast("int"))
    last = F.least(F.lit(gridsize - 1), F.floor((at + KERNEL_REACH) / gap).cast("int"))
    near = (bins.withColumns({"_from": first, "_to": last}).filter(F.col("_from") <= F.col("_to"))
                .withColumn("g", F.explode(F.sequence("_from", "_to"))).withColumn("d", F.col("g") * gap - at))
    d = F.col("d")
    hermite = [F.lit(1.0), d]
    for k in range(1, KERNEL_TERMS - 1):
        hermite.append(d * hermite[k] - k * hermite[k - 1])
    total = sum((h * F.col(f"m{k}") for k, h in enumerate(hermite)), F.lit(0.0))
    sums = near.groupBy("g").agg(F.sum(F.exp(-0.5 * d * d) * total).alias("s"))
    grid = df.sparkSession.range(gridsize).select(F.col("id").cast("int").alias("g")).filter(n > 0)
    scale = n * bw * math.sqrt(2 * math.pi)
    return grid.join(sums, "g", "left").select(
        "g", (lo + F.col("g") * step).alias("x"),
        F.when(bw != 0, F.try_divide(F.coalesce(F.col("s"), F.lit(0.0)), scale)).alias("density")).orderBy("g")


def share_at_least(df: DataFrame, c: str, threshold: float = 100.0) -> DataFrame:
    """Count of values >= threshold, all rows, and their share; missing values stay in
    the denominator."""
    return df.agg(F.count_if(F.col(c) >= threshold).alias("n_at_least"),
                  F.count(F.lit(1)).alias("n_total")).withColumn(
        "share", F.try_divide(F.col("n_at_least").cast("double"), F.col("n_total").cast("double")))


def daily_mean_grid(df: DataFrame, time: str, cell: Sequence[str], value: str) -> DataFrame:
    """Hourly grid -> daily mean per cell, missing values skipped."""
    return df.groupBy(F.to_date(time).alias("date"), *cell).agg(F.avg(present(value)).alias(value))


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column, missing, rows) ordered by missing count descending, then column name.

    One pass computes every column's null count (doubles also count NaN as missing).
    """
    dtypes = dict(df.dtypes)

    def miss(c):
        x = F.col(f"`{c}`")
        cond = x.isNull() | F.isnan(x) if dtypes[c] in ("double", "float") else x.isNull()
        return F.count_if(cond).alias(c)

    counts = df.agg(*[miss(c) for c in df.columns], F.count(F.lit(1)).alias("__rows"))
    long = counts.unpivot(["__rows"], df.columns, "column", "missing")
    return (long.select("column", "missing", F.col("__rows").alias("rows"))
                .orderBy(F.desc("missing"), "column"))


# Bands that are angles in degrees, and the land-cover class band.
DEGREE_BANDS = (7, 13, 19)
LANDCOVER_BAND = 16


def band_statistics(pixels_long: DataFrame, years: Sequence[int], band: str = "band",
                    value: str = "v", year: str = "year",
                    not_standardised: Sequence[int] = (*DEGREE_BANDS, LANDCOVER_BAND),
                    folds: DataFrame | None = None) -> DataFrame:
    """Per band mean, population std and missing rate over the training years.

    With ``folds`` (fold, year, split) per fold and band, over the fold's own training years among ``years``.

    Bands that must not be standardised (angles, land cover) get mean 0 and std 1.
    Input is the long pixel table (year, band, v) with nulls for missing pixels.
    """
    f, keys = pixels_long.filter(F.col(year).isin(list(years))), [band]
    if folds is not None:  # a few (fold, year) rows
        train = folds.filter("split = 'train'").select("fold", F.col("year").alias(year))
        f, keys = f.join(F.broadcast(train), year), ["fold", band]
    s = f.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                            F.avg(F.col(value).isNull().cast("double")).alias("missing_rate"))
    keep = ~F.col(band).isin(list(not_standardised))
    return s.select(*keys, F.when(keep, F.col("mean")).otherwise(F.lit(0.0)).alias("mean"),
                    F.when(keep, F.col("std")).otherwise(F.lit(1.0)).alias("std"), "missing_rate")


def positive_weight(stats: DataFrame, fire_band: int = 22, band: str = "band",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Positive-class weight 1 / (1 - missing rate of the active-fire band), per ``keys`` of the statistics."""
    return stats.filter(F.col(band) == fire_band).select(
        *keys, F.try_divide(F.lit(1.0), 1 - F.col("missing_rate")).alias("pos_weight"))


def collect_areas(fires: DataFrame, start, end, min_area: float, area: str = "area",
                  idate: str = "idate") -> DataFrame:
    """Areas of fires with area >= min_area and ignition in [start, end), with their number.

    Returned as rows ordered by area (no list is gathered in one task); ``n_fires`` is the
    same on every row.
    """
    f = fires.filter((F.col(area) >= min_area) & (F.col(idate) >= ntz_lit(start)) & (F.col(idate) < ntz_lit(end)))
    n = _scalar(f, F.count(F.lit(1)))
    return f.select(F.col(area), n.alias("n_fires")).orderBy(area)


def fires_in_range(fires: DataFrame, min_size: float, start, end, area: str = "area",
                   idate: str = "idate", max_size: float = 1e20) -> DataFrame:
    """Area in [min_size, max_size) and ignition in [start, end)."""
    return fires.filter((F.col(area) >= min_size) & (F.col(area) < max_size)
                        & (F.col(idate) >= ntz_lit(start)) & (F.col(idate) < ntz_lit(end)))
