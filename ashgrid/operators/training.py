"""Training samples end to end: the 23 bands of a fire raster to the model's channels.

A sample is built from expressions on its pixels: the channels of a pixel are computed in its own
row, the crop is an equi-join on the (small) per-sample crop table, and one aggregation per
(sample, y, x) puts the lags side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.operators import pixels as P

BANDS = 23
# Channel numbers after land cover (band 16) became 17 classes and the binary fire mask
# was appended: 40 channels, of which terrain and land cover do not change from day to day.
CHANNELS = BANDS - 1 + P.N_LANDCOVER_CLASSES + 1
STATIC_CHANNELS = (12, 13, 14, *range(P.LANDCOVER_BAND, P.LANDCOVER_BAND + P.N_LANDCOVER_CLASSES))
DYNAMIC_CHANNELS = tuple(c for c in range(CHANNELS) if c not in STATIC_CHANNELS)

SAMPLE = ("year", "fire_id", "sample_idx")


def kept_channels(keep: Sequence[int] | None = None) -> tuple[list[int], list[int]]:
    """(static, dynamic) channel numbers among ``keep`` (all by default), ascending."""
    chosen = set(range(CHANNELS) if keep is None else keep)
    return sorted(chosen & set(STATIC_CHANNELS)), sorted(chosen & set(DYNAMIC_CHANNELS))


def feature_count(T: int, keep: Sequence[int] | None = None, flatten: bool = True) -> int:
    """Width of a sample: with ``flatten`` the static channels appear once, else per time step."""
    static, dynamic = kept_channels(keep)
    return len(static) + len(dynamic) + (len(dynamic) * (T - 1) if flatten else 0)


def apply_crop(sample_pixels: DataFrame, crops: DataFrame, n: int, keys: Sequence[str] = SAMPLE) -> DataFrame:
    """Cut every sample's pixels to its n x n crop (keys, top, left), re-based to 0."""
    keys = list(keys)
    j = sample_pixels.join(crops.select(*keys, "top", "left"), keys)
    y, x = F.col("y") - F.col("top"), F.col("x") - F.col("left")
    return j.withColumns({"y": y, "x": x}).filter(F.col("y").between(0, n - 1) & F.col("x").between(0, n - 1)).drop("top", "left")


def channels(stats: dict[int, tuple[float, float]], band=lambda i: f"b{i}") -> list[Column]:
    """The 40 channels of one pixel row whose fire band holds the hour (H5): angles as sines (H7),
    standardised bands with missing values at the mean (H8), land cover one-hot in place (H9), and
    the binary mask of the hour at the end (H6)."""
    out: list[Column] = []
    for i in range(BANDS):
        c = F.col(band(i)).cast("double")
        if i == P.LANDCOVER_BAND:
            hot = P.one_hot_landcover(F.when(~F.isnan(c), c))
            out += [F.get(hot, F.lit(k)).cast("double") for k in range(P.N_LANDCOVER_CLASSES)]
            continue
        if i in P.DEGREE_BANDS:
            c = P.degrees_to_sine(c)
        mean, std = stats.get(i, (0.0, 1.0))
        c = F.when(~F.isnan(c), c)
        out.append(F.coalesce(F.try_divide(c - F.lit(mean), F.lit(std)), F.lit(0.0)))
    out.append(F.coalesce(P.binary_mask(band(P.ACTIVE_FIRE_BAND)), F.lit(0)).cast("double"))
    return out


def training_samples(pixels: DataFrame, stats: DataFrame, T: int, skip: int = 0, *, crop: int, height: int, width: int,
                     crops_per_sample: int = 10, seed: int = 42, keep: Sequence[int] | None = None) -> DataFrame:
    """(year, fire_id, sample_idx, y, x, label, features): one row per pixel of every sample.

    ``pixels`` has bands b0..b22 with the fire band as hhmm; ``stats`` is the per-band table of D19,
    read once.  The label is the raw next-day detection (H6).  Each sample is cut to the best of its
    seeded crops; ``features`` holds the dynamic channels of the earlier days and every kept channel
    of the last day (H16), ``feature_count`` numbers.  A pixel absent on some day has zeros there."""
    fire = f"b{P.ACTIVE_FIRE_BAND}"
    s = P.samples(pixels, T, skip)
    hour = P.clean_fire_band(F.when(~F.isnan(F.col(fire).cast("double")), F.col(fire)))
    s = s.withColumns({"label": P.binary_label(fire), "af_hh": hour}).withColumn(fire, F.col("af_hh"))
    best = P.best_of_k_crops(s, crops_per_sample, crop, height, width, seed, T, fire="af_hh", label="label")
    cut = apply_crop(s, best, crop)
    known = {r["band"]: (float(r["mean"]), float(r["std"])) for r in stats.select("band", "mean", "std").collect()
             if r["mean"] is not None and r["std"] is not None}
    static, dynamic = kept_channels(keep)
    all_ = channels(known)
    row = cut.select(*SAMPLE, "y", "x", "lag", "label", F.array(*[all_[c] for c in range(CHANNELS)]).alias("c"))
    at = [F.max(F.when(F.col("lag") == lag, F.col("c"))).alias(f"c{lag}") for lag in range(T)]
    lags = row.groupBy(*SAMPLE, "y", "x").agg(*at, F.max(F.when(F.col("lag") == T, F.col("label"))).alias("label"))
    picked = [F.coalesce(F.get(f"c{lag}", F.lit(c)), F.lit(0.0)) for lag in range(T - 1) for c in dynamic]
    picked += [F.coalesce(F.get(f"c{T - 1}", F.lit(c)), F.lit(0.0)) for c in sorted(static + dynamic)]
    return lags.select(*SAMPLE, "y", "x", F.coalesce("label", F.lit(0)).alias("label"), F.array(*picked).alias("features"))
