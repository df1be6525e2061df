"""Daily fire rasters as pixel tables, and the sample construction around them
(SURVEY A5, A9, C17, E2-E7, H5-H21, D19, D20).

A raster stack is a table ``(year, fire_id, obs_date, y, x, <band columns>)``.  Work that is
per image (indexing dates, counting samples, offsets) runs on the small per-image table;
pixels are touched only by equi-joins and generators with a fixed fan-out (lags, crops,
neighbours), never by a window spanning an image or a fire.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.functions.columns import col_of
from ashgrid.session import cut_lineage
from ashgrid.sources.files import path_exists

# Band layout of the daily fire rasters.
DEGREE_BANDS = (7, 13, 19)
LANDCOVER_BAND = 16
ACTIVE_FIRE_BAND = 22
N_LANDCOVER_CLASSES = 17


# ---------------------------------------------------------------- inventory and samples

def image_index(pixels: DataFrame, keys: Sequence[str] = ("year", "fire_id"), date: str = "obs_date") -> DataFrame:
    """Per-image table (keys, date, img_idx): images of a fire numbered 0.. in date order.

    The window runs over one fire's images (one per day), never over pixels."""
    keys = list(keys)
    imgs = pixels.select(*keys, date).distinct()
    return imgs.withColumn("img_idx", (F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1).cast("long"))


def stack_inventory(files: DataFrame, fires: DataFrame | None = None, *, path: str = "path",
                    fire_key: str = "fire_id", with_dates: bool = False) -> DataFrame:
    """A5: rasters listed as ``<year>/fire_<id>/<yyyy-MM-dd>.tif`` -> per fire: year, number of
    images, first and last date (and, ``with_dates``, the ordered dates: one per day of the fire);
    fires of the catalog without images are flagged."""
    p = F.col(path)
    parsed = files.select(
        F.regexp_extract(p, r"(\d{4})/", 1).try_cast("int").alias("year"),
        F.regexp_extract(p, r"fire_(\d+)/", 1).try_cast("long").alias(fire_key),
        F.try_to_date(F.regexp_extract(p, r"(\d{4}-\d{2}-\d{2})\.tif$", 1), "yyyy-MM-dd").alias("obs_date")).filter(F.col("obs_date").isNotNull())
    inv = parsed.groupBy("year", fire_key).agg(F.count_distinct("obs_date").alias("n_images"),
                                               F.min("obs_date").alias("first_date"),
                                               F.max("obs_date").alias("last_date"),
                                               *([F.array_sort(F.collect_set("obs_date")).alias("dates")] if with_dates else []))
    if fires is None:
        return inv.withColumn("has_images", F.lit(True))
    f = fires.select(fire_key).distinct()
    return (f.join(inv, fire_key, "left")
             .select(fire_key, "year", F.coalesce("n_images", F.lit(0)).alias("n_images"),
                     "first_date", "last_date", *(["dates"] if with_dates else []), F.col("n_images").isNotNull().alias("has_images")))


def sample_counts(images: DataFrame, T: int, skip: int = 0, keys: Sequence[str] = ("year", "fire_id"),
                  date: str = "obs_date") -> DataFrame:
    """Samples per fire: max(0, images - skip - T)."""
    return images.groupBy(*keys).agg(F.count_distinct(date).alias("n_images")).withColumn(
        "n_samples", F.greatest(F.col("n_images") - skip - T, F.lit(0)))


def sample_offsets(counts: DataFrame, keys: Sequence[str] = ("year", "fire_id"), count: str = "n_samples") -> DataFrame:
    """Running start index of each fire, ordered by year then fire.

    Two bounded windows: fires within a year, then the (few) year totals."""
    year, fire = keys[0], keys[1]
    w_in = Window.partitionBy(year).orderBy(fire).rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_in", F.coalesce(F.sum(count).over(w_in), F.lit(0)))
    years = counts.groupBy(year).agg(F.sum(count).alias("_yt"))
    w_y = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)   # one row per year
    years = years.withColumn("_yo", F.coalesce(F.sum("_yt").over(w_y), F.lit(0))).drop("_yt")
    return within.join(years, year).withColumn("offset", F.col("_yo") + F.col("_in")).drop("_in", "_yo")


def samples(pixels: DataFrame, T: int, skip: int = 0, keys: Sequence[str] = ("year", "fire_id"),
            date: str = "obs_date") -> DataFrame:
    """Sample s of a fire takes images s+skip .. s+skip+T-1 as input (lag 0..T-1) and the
    next image as label (lag T).  Consecutive by image order, not calendar.

    Returns the pixel rows with (sample_idx, lag) added; each pixel is emitted once per
    sample it belongs to (at most T + 1 times), via a join on the per-image table.
    """
    keys = list(keys)
    idx = image_index(pixels, keys, date).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))  # same partitioning
    lags = idx.select(*keys, date, "img_idx", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(T).cast("long"))).alias("lag"))
    lags = lags.withColumn("sample_idx", F.col("img_idx") - skip - F.col("lag"))
    lags = lags.filter((F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("_n") - skip - T))
    return pixels.join(lags.select(*keys, date, "sample_idx", "lag"), [*keys, date])


def year_folds(extended: bool = False, years: Sequence[int] = (2018, 2019, 2020, 2021),
               extra_train: Sequence[int] = (2016, 2017, 2022, 2023)):
    """E5: the 12 (train, val, test) year splits as a list of rows (fold, year, split).

    Folds enumerate train pairs in order; the two remaining years are val/test in both orders.
    The extended variant adds ``extra_train`` years to every train split."""
    rows = []
    fold = 0
    for a, b in combinations(sorted(years), 2):
        rest = [y for y in sorted(years) if y not in (a, b)]
        for v, t in ((rest[0], rest[1]), (rest[1], rest[0])):
            train = ([*extra_train] if extended else []) + [a, b]
            rows += [(fold, y, "train") for y in train] + [(fold, v, "val"), (fold, t, "test")]
            fold += 1
    return rows


def fold_table(spark, extended: bool = False) -> DataFrame:
    return spark.createDataFrame(year_folds(extended), "fold int, year int, split string")


def fire_pixel_counts(sample_pixels: DataFrame, mask: str = "af_mask",
                      keys: Sequence[str] = ("year", "fire_id", "sample_idx"), T: int = 1, last_day_only: bool = False) -> DataFrame:
    """Per sample, the number of input pixels (lags < T, or only the last input day's, as in samples
    flattened over time) whose binary fire mask is 1.  A sample without a pixel on its last day has none."""
    inp = sample_pixels.filter(F.col("lag") < T)
    burns = (F.col(mask) == 1) & (F.col("lag") == T - 1) if last_day_only else F.col(mask) == 1
    return inp.groupBy(*keys).agg(F.count_if(burns).alias("n_fire_pixels"))


def keep_ignition(counts: DataFrame) -> DataFrame:
    """Samples with no fire pixel in the input (sum < 1)."""
    return counts.filter(F.col("n_fire_pixels") < 1)


def keep_burning(counts: DataFrame) -> DataFrame:
    """Samples with more than one fire pixel in the input (sum > 1); exactly one is in
    neither subset, as in the source."""
    return counts.filter(F.col("n_fire_pixels") > 1)


def filter_report(counts: DataFrame) -> DataFrame:
    """E6 report: for the ignition and burning subsets, samples kept, total and kept share
    (one aggregation over the per-sample counts)."""
    n = F.col("n_fire_pixels")
    agg = counts.agg(F.count(F.lit(1)).alias("total"), F.count_if(n < 1).alias("ignition"),
                     F.count_if(n > 1).alias("burning"))
    long = agg.unpivot(["total"], ["ignition", "burning"], "subset", "kept")
    return long.select("subset", "kept", "total",
                       F.try_divide(F.col("kept").cast("double"), F.col("total").cast("double")).alias("share"))


def persistence(sample_pixels: DataFrame, T: int, *, hh: str = "af_hh", mask: str = "af_mask",
                keys: Sequence[str] = ("year", "fire_id", "sample_idx"), latest_only: bool = False) -> DataFrame:
    """Predict the label from the last input day: all of its fire pixels, or (latest_only)
    only those detected at the day's latest hour; none when the day's maximum marks no fire.

    The per-sample maximum is a window over the pixels of one image (no second pass)."""
    last = sample_pixels.filter(F.col("lag") == T - 1)
    if not latest_only:
        return last.select(*keys, "y", "x", F.col(mask).cast("int").alias("pred"))
    both = persistence_both(sample_pixels, T, hh=hh, mask=mask, keys=keys)
    return both.select(*keys, "y", "x", F.col("pred_last").alias("pred"))


def persistence_both(sample_pixels: DataFrame, T: int, *, hh: str = "af_hh", mask: str = "af_mask",
                     keys: Sequence[str] = ("year", "fire_id", "sample_idx")) -> DataFrame:
    """Both persistence predictions side by side (pred_all, pred_last) in one pass."""
    last = sample_pixels.filter(F.col("lag") == T - 1)
    top = F.max(hh).over(Window.partitionBy(*keys))
    return last.withColumn("_mx", top).select(
        *keys, "y", "x", F.col(mask).cast("int").alias("pred_all"),
        ((F.col("_mx") > 0) & (F.col(hh) == F.col("_mx"))).cast("int").alias("pred_last"))


# ---------------------------------------------------------------- per-pixel preprocessing

def clean_fire_band(c) -> Column:
    """H5: active-fire time hhmm -> hour; missing (no detection) -> 0."""
    return F.floor(F.coalesce(col_of(c), F.lit(0)) / 100).cast("double")


def binary_mask(c) -> Column:
    """H6: 1 where the value is > 0."""
    return (col_of(c) > 0).cast("int")


def binary_label(c) -> Column:
    """H6: 1 where the raw active-fire value is > 0 (a detection in the first hour counts, which the
    floored hour would lose); missing -> 0."""
    return (F.coalesce(col_of(c), F.lit(0)) > 0).cast("int")


def degrees_to_sine(c) -> Column:
    """H7: sin of an angle given in degrees."""
    return F.sin(F.radians(col_of(c)))


def standardise(df: DataFrame, stats: DataFrame, bands: dict[str, int], *, band: str = "band") -> DataFrame:
    """H8: (x - mean) / std per band, missing (null or NaN) -> 0 after scaling.

    ``stats`` is the per-band table of D19 (band, mean, std).  It is computed once, whatever the number
    of bands: its rows (one per band) come to the driver and go into the plan as constants."""
    known = {r[band]: r for r in stats.select(band, "mean", "std").collect()}
    cols = {}
    for name, b in bands.items():
        r = known.get(b)
        if r is None or r["mean"] is None or r["std"] is None:
            cols[name] = F.lit(0.0)
            continue
        x = F.when(~F.isnan(F.col(name).cast("double")), F.col(name))
        cols[name] = F.coalesce(F.try_divide(x - F.lit(float(r["mean"])), F.lit(float(r["std"]))), F.lit(0.0))
    return df.withColumns(cols)


def one_hot_landcover(c, n_classes: int = N_LANDCOVER_CLASSES) -> Column:
    """H9: land-cover class k (1..n) -> one-hot array with the 1 at index k-1; class 0 (and
    missing, read as 0) lands at index -1, i.e. the last position, as in the source."""
    k = F.coalesce(col_of(c), F.lit(0)).cast("int")
    hot = F.pmod(k - 1, F.lit(n_classes))
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == hot).cast("int"))


def _round_half_even(v: float) -> int:
    return int(round(v))


def center_crop(df: DataFrame, n: int, H: int, W: int, y: str = "y", x: str = "x") -> DataFrame:
    """Centred n x n window (offsets round half to even), re-based to 0."""
    top, left = _round_half_even((H - n) / 2.0), _round_half_even((W - n) / 2.0)
    f = df.filter(F.col(y).between(top, top + n - 1) & F.col(x).between(left, left + n - 1))
    return f.withColumns({y: F.col(y) - top, x: F.col(x) - left})


def crop_offsets(keys: Sequence[str], i: Column, H: int, W: int, n: int, seed: int) -> list[Column]:
    """Deterministic pseudo-random crop offsets for candidate ``i`` (0..k-1) of a sample:
    top, left in [0, H - n) and [0, W - n) from modular arithmetic on the key and seed."""
    h = F.lit(0).cast("long")
    for c in keys:
        h = F.pmod(h * 1000003 + F.col(c).cast("long"), F.lit(2147483647))
    i = i.cast("long")
    top = F.pmod(h * 31 + i * 7919 + seed * 104729, F.lit(H - n))
    left = F.pmod(h * 17 + i * 6007 + seed * 15485863, F.lit(W - n))
    return [top.alias("top"), left.alias("left")]


def best_of_k_crops(sample_pixels: DataFrame, k: int, n: int, H: int, W: int, seed: int, T: int, *,
                    keys: Sequence[str] = ("year", "fire_id", "sample_idx"), fire: str = "af_hh",
                    label: str = "label") -> DataFrame:
    """K candidate crops per sample scored mean(input fire band) + 1000 * mean(label);
    the first candidate with the best score wins.  Returns (keys, crop_i, top, left).

    Offsets follow from the keys, so a pixel knows which of its sample's crops hold it: the scores are
    2 k conditional sums per sample, combined before the one shuffle, with no row per candidate and no
    join.  Samples without fire or label keep candidate 0."""
    if H - n <= 0 or W - n <= 0:
        raise ValueError("crop must be smaller than the image")
    keys = list(keys)
    inputs = (F.col("lag") < T) & (F.col(fire) != 0)
    labels = (F.col("lag") == T) & (F.col(label) != 0)
    sums, scored = [], []
    for i in range(k):
        top, left = crop_offsets(keys, F.lit(i), H, W, n, seed)
        inside = F.col("y").between(top, top + (n - 1)) & F.col("x").between(left, left + (n - 1))
        sums += [F.sum(F.when(inputs & inside, F.col(fire))).alias(f"_f{i}"), F.sum(F.when(labels & inside, F.col(label))).alias(f"_l{i}")]
        score = F.coalesce(f"_f{i}", F.lit(0)) / (T * n * n) + 1000 * F.coalesce(f"_l{i}", F.lit(0)) / (n * n)
        scored.append(F.struct(score.alias("s"), F.lit(-i).alias("i"), F.lit(i).cast("long").alias("crop_i"), top, left))
    best = F.greatest(*scored) if k > 1 else scored[0]
    return sample_pixels.groupBy(*keys).agg(*sums).select(*keys, best.alias("_b")).select(*keys, "_b.crop_i", "_b.top", "_b.left")


def flip_h(df: DataFrame, W: int, degree_cols: Sequence[str] = (), x: str = "x") -> DataFrame:
    """Mirror left-right; angles a -> 360 - a."""
    return df.withColumns({x: W - 1 - F.col(x), **{c: 360 - F.col(c) for c in degree_cols}})


def flip_v(df: DataFrame, H: int, degree_cols: Sequence[str] = (), y: str = "y") -> DataFrame:
    """Mirror top-bottom; angles a -> (180 - a) mod 360."""
    return df.withColumns({y: H - 1 - F.col(y), **{c: F.pmod(180 - F.col(c), F.lit(360)) for c in degree_cols}})


def rotate_90(df: DataFrame, k: int, n: int, degree_cols: Sequence[str] = (), y: str = "y", x: str = "x") -> DataFrame:
    """Rotate a square n x n image by k * 90 degrees counter-clockwise; angles
    a -> (a - 90k) mod 360.  One quarter turn maps (y, x) to (n - 1 - x, y)."""
    k = k % 4
    yy, xx = F.col(y), F.col(x)
    m = n - 1
    ny, nx = {0: (yy, xx), 1: (m - xx, yy), 2: (m - yy, m - xx), 3: (xx, m - yy)}[k]
    out = df.withColumns({"_ny": ny, "_nx": nx}).withColumns({y: F.col("_ny"), x: F.col("_nx")}).drop("_ny", "_nx")
    if k:
        out = out.withColumns({c: F.pmod(F.col(c) - 90 * k, F.lit(360)) for c in degree_cols})
    return out


def zero_pad(df: DataFrame, H: int, W: int, size: int, keys: Sequence[str], values: Sequence[str],
             y: str = "y", x: str = "x") -> DataFrame:
    """Pad each image to size x size with zeros; the extra row / column goes to the
    bottom / right.  Every output pixel is materialised (dense).  Only the border is zero: a value
    missing inside the image stays missing, so that scaling (H8) reads it as the mean."""
    ph, pw = max(0, size - H), max(0, size - W)
    top, left = ph // 2, pw // 2
    keys = list(keys)
    owners = df.select(*keys).distinct()
    oh, ow = H + ph, W + pw
    grid = (owners.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(oh - 1).cast("long"))).alias(y))
                  .select(*keys, y, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ow - 1).cast("long"))).alias(x)))
    src = df.select(*keys, (F.col(y) + top).alias(y), (F.col(x) + left).alias(x), *values)
    j = grid.join(src, [*keys, y, x], "left")
    inside = F.col(y).between(top, top + H - 1) & F.col(x).between(left, left + W - 1)
    return j.select(*keys, y, x, *[F.when(inside, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values])


def select_bands(df: DataFrame, keep: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Keep the listed channels."""
    return df.select(*keys, *keep)


def flatten_time(sample_pixels: DataFrame, T: int, dynamic: Sequence[str], static: Sequence[str], *,
                 keys: Sequence[str] = ("year", "fire_id", "sample_idx")) -> DataFrame:
    """One row per (sample, pixel): dynamic channels of lags 0..T-2 and every kept channel
    of the last lag; width = len(dynamic) * (T - 1) + len(dynamic) + len(static).

    A single group-by on (sample, y, x) pivots the lags (each cell has one value)."""
    inp = sample_pixels.filter(F.col("lag") < T)
    aggs = [F.max(F.when(F.col("lag") == l, F.col(c))).alias(f"{c}_t{l}") for l in range(T - 1) for c in dynamic]
    aggs += [F.max(F.when(F.col("lag") == T - 1, F.col(c))).alias(f"{c}_t{T - 1}") for c in (*dynamic, *static)]
    return inp.groupBy(*keys, "y", "x").agg(*aggs)


def tile_cover(pixels: DataFrame, H: int, W: int, th: int, tw: int, y: str = "y", x: str = "x") -> DataFrame:
    """The tile each pixel's final value comes from when an image is covered by th x tw
    tiles whose last row / column is aligned to the edge and later tiles overwrite earlier
    ones; with the pixel's offset inside that tile.  Closed form, no join."""
    n_h, n_w = math.ceil(H / th), math.ceil(W / tw)
    ti = F.when(F.col(y) >= H - th, F.lit(n_h - 1)).otherwise(F.floor(F.col(y) / th))
    tj = F.when(F.col(x) >= W - tw, F.lit(n_w - 1)).otherwise(F.floor(F.col(x) / tw))
    y0 = F.when(ti == n_h - 1, F.lit(H - th)).otherwise(ti * th)
    x0 = F.when(tj == n_w - 1, F.lit(W - tw)).otherwise(tj * tw)
    return pixels.withColumns({"tile_i": ti.cast("int"), "tile_j": tj.cast("int"),
                               "tile_y": (F.col(y) - y0).cast("int"), "tile_x": (F.col(x) - x0).cast("int")})


def focal_3x3(df: DataFrame, keys: Sequence[str], value: str, H: int, W: int,
              y: str = "y", x: str = "x") -> DataFrame:
    """The 3 x 3 neighbourhood of every pixel as nine columns n_{dy}{dx} (zero padding).

    Separable: each pixel goes to the rows above and below it (three copies), one group-by makes the
    column triple of every position, and a window along the image row reads the triples to the
    left and right.  Targets are the positions that received their own centre."""
    keys = list(keys)
    side = {-1: "m", 0: "z", 1: "p"}
    sent = df.select(*keys, y, x, value, F.explode(F.array(*[F.lit(d) for d in side])).alias("_d")).withColumn(
        y, F.col(y) - F.col("_d")).filter(F.col(y).between(0, H - 1) & F.col(x).between(0, W - 1))
    column = sent.groupBy(*keys, y, x).agg(
        *[F.max(F.when(F.col("_d") == d, F.col(value))).alias(f"_{s}") for d, s in side.items()],
        F.max(F.col("_d") == 0).alias("_own"))
    line = Window.partitionBy(*keys, y).orderBy(x)
    near = {-1: F.lag(x).over(line) == F.col(x) - 1, 1: F.lead(x).over(line) == F.col(x) + 1}

    def at(s, dx):
        c = F.col(f"_{s}")
        v = c if dx == 0 else F.when(near[dx], (F.lag(c) if dx < 0 else F.lead(c)).over(line))
        return F.coalesce(v, F.lit(0.0)).alias(f"n_{s}{side[dx]}")

    out = column.select(*keys, y, x, "_own", *[at(s, dx) for s in side.values() for dx in side])
    return out.filter("_own").drop("_own")


def train_fire_classifier(features: DataFrame, feature_cols: Sequence[str], label: str = "label",
                          pos_weight: float | None = None, max_iter: int = 50):
    """Logistic regression on the focal features with a positive-class weight."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
    d = va.transform(features)
    if pos_weight is not None:
        d = d.withColumn("_w", F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter,
                            weightCol="_w" if pos_weight is not None else None)
    return va, lr.fit(d)


def predict_fire(va, model, features: DataFrame) -> DataFrame:
    """Fire probability per pixel from a trained model."""
    from pyspark.ml.functions import vector_to_array
    p = model.transform(va.transform(features))
    return p.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def prediction_table(sample_pixels: DataFrame, T: int, *, mask: str = "af_mask", pred: str | None = None,
                     keys: Sequence[str] = ("year", "fire_id", "sample_idx")) -> DataFrame:
    """Input fire mask, prediction and label side by side per (sample, y, x), from one aggregation
    over the sample pixels.  The prediction is column ``pred`` of the last input day, by default the
    persistence of its mask."""
    at = lambda lag, c: F.max(F.when(F.col("lag") == lag, F.col(c))).cast("int")
    return (sample_pixels.filter(F.col("lag") >= T - 1).groupBy(*keys, "y", "x")
            .agg(at(T - 1, mask).alias("input_mask"), at(T - 1, pred or mask).alias("pred"), at(T, mask).alias("label")))


def pack_fire_stack(pixels: DataFrame, existing: DataFrame | None = None, *,
                    keys: Sequence[str] = ("year", "fire_id"), date: str = "obs_date",
                    lat: str | None = None, lon: str | None = None) -> DataFrame:
    """One summary record per fire (ordered image dates, pixel count, centre) for fires
    not yet written (left-anti on ``existing`` keys).  The pixel rows themselves are written
    with ``write_fire_stacks``; the date list holds one entry per day of the fire."""
    keys = list(keys)
    p = pixels if existing is None else pixels.join(existing.select(*keys), keys, "left_anti")
    aggs = [F.sort_array(F.collect_set(date)).alias("dates"), F.count(F.lit(1)).alias("n_pixels")]
    if lat and lon:
        aggs += [((F.min(lat) + F.max(lat)) / 2).alias("centre_lat"), ((F.min(lon) + F.max(lon)) / 2).alias("centre_lon")]
    return p.groupBy(*keys).agg(*aggs)


def fire_images(pixels: DataFrame, bands: Sequence[str], width: int, keys: Sequence[str] = ("year", "fire_id"),
                date: str = "obs_date") -> DataFrame:
    """One row per image (fire and date): ``pixel``, the row-major indexes (y * width + x) of its pixels in
    ascending order, and per band an array of their values.  An image's size is that of its raster."""
    keys = list(keys)
    one = F.struct((F.col("y") * width + F.col("x")).cast("int").alias("pixel"), *bands)
    got = pixels.groupBy(*keys, date).agg(F.sort_array(F.collect_list(one)).alias("_p"))
    return got.select(*keys, date, *[F.col(f"_p.{n}").alias(n) for n in ("pixel", *bands)])


def write_fire_stacks(pixels: DataFrame, path: str, bands: Sequence[str], width: int, keys: Sequence[str] = ("year", "fire_id"),
                      date: str = "obs_date", rewrite: bool = False) -> None:
    """A9 sink: the images of every fire that ``path`` does not hold yet (or, with ``rewrite``, of all), one folder
    per fire.  A folder appears, or replaces the old one, as a whole when the job commits (dynamic
    partition overwrite), so a job that is run again skips what is written and never doubles it, and
    a job that failed leaves nothing behind.  Images are range-partitioned by (fire, date): a long fire
    is written by several tasks."""
    keys = list(keys)
    spark = pixels.sparkSession
    todo = pixels
    if not rewrite and path_exists(spark, path):
        held = T.StructType([pixels.schema[k] for k in keys])
        done = cut_lineage(spark.read.schema(held).parquet(path).distinct())  # the folders' names
        todo = pixels.join(done, keys, "left_anti")
    images = fire_images(todo, bands, width, keys, date)
    (images.repartitionByRange(*keys, date).sortWithinPartitions(*keys, date)
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def first_step_of_day(df: DataFrame, time: str, cell: Sequence[str], values: Sequence[str]) -> DataFrame:
    """H3: per (day, cell) the values at the day's first time step (``min_by`` aggregate)."""
    return df.groupBy(F.to_date(time).alias("date"), *cell).agg(
        *[F.min_by(F.col(v), F.col(time)).alias(v) for v in values])


def axes_from_grid(cells: DataFrame, y: str = "y", x: str = "x", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """H4: 1-D latitude axis from the first column and longitude axis from the first row of
    2-D coordinate fields: (axis, idx, coord)."""
    a = cells.filter(F.col(x) == 0).select(F.lit("lat").alias("axis"), F.col(y).alias("idx"), F.col(lat).alias("coord"))
    b = cells.filter(F.col(y) == 0).select(F.lit("lon").alias("axis"), F.col(x).alias("idx"), F.col(lon).alias("coord"))
    return a.unionByName(b)


def resample_nearest(pixels: DataFrame, coarse: DataFrame, factor: int, values: Sequence[str], *,
                     keys: Sequence[str] = (), y: str = "y", x: str = "x", cy: str = "gy", cx: str = "gx") -> DataFrame:
    """H2: nearest-cell resampling of a coarse grid (cells ``factor`` pixels wide, aligned at
    the origin) onto the pixel grid: index arithmetic and an equi-join."""
    keys = list(keys)
    p = pixels.withColumns({"_gy": F.floor(F.col(y) / factor), "_gx": F.floor(F.col(x) / factor)})
    c = coarse.select(*keys, F.col(cy).alias("_gy"), F.col(cx).alias("_gx"), *values)
    return p.join(c, [*keys, "_gy", "_gx"], "left").drop("_gy", "_gx")


def resample_bilinear(pixels: DataFrame, cells: DataFrame, lat_axis, lon_axis, value: str,
                      lat: str = "lat", lon: str = "lon") -> DataFrame:
    """H1: bilinear resampling of a coarse grid at each pixel's coordinates (see C6)."""
    from ashgrid.operators.joins import sample_linear
    return sample_linear(pixels, cells, lat_axis, lon_axis, value, lat=lat, lon=lon)
