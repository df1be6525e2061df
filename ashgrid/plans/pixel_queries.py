"""Registered queries over the daily fire rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashgrid.operators import aggregates as agg
from ashgrid.operators import joins as J
from ashgrid.operators import pixels as P
from ashgrid.operators.logistic import fire_probability, newton_fit
from ashgrid.plans.catalog import register, rounded
from ashgrid.session import cut_lineage
from ashgrid.sources.fixtures import raster, table

T, SKIP, HW = 2, 1, 16
KEYS = ["year", "fire_id", "sample_idx"]

_SAMPLES = f"""img as (select year, fire_id, obs_date,
    row_number() over (partition by year, fire_id order by obs_date) - 1 as img_idx,
    count(*) over (partition by year, fire_id) as n
  from (select distinct year, fire_id, obs_date from raster)),
smp as (select i.year, i.fire_id, i.obs_date, i.img_idx - {SKIP} - l.lag as sample_idx, l.lag
  from img i, range(0, {T + 1}) as l(lag)
  where i.img_idx - {SKIP} - l.lag >= 0 and i.img_idx - {SKIP} - l.lag < i.n - {SKIP} - {T}),
sp as (select r.*, s.sample_idx, s.lag, floor(coalesce(r.b22, 0) / 100) as af_hh,
              cast(floor(coalesce(r.b22, 0) / 100) > 0 as int) as af_mask
  from raster r join smp s on r.year = s.year and r.fire_id = s.fire_id and r.obs_date = s.obs_date)"""


def sample_pixels(spark, sf_dir):
    """Raster pixels of every (T=2, skip=1) sample, with the cleaned fire band and its mask."""
    s = P.samples(raster(spark, sf_dir), T, SKIP)
    hh = P.clean_fire_band("b22")
    return s.withColumns({"af_hh": hh, "af_mask": P.binary_mask(hh)})


@register("samples", sql=f"with {_SAMPLES} select year, fire_id, sample_idx, lag, obs_date, y, x from sp")
def q_samples(spark, sf_dir):
    """Input images (lags 0..T-1) and label image (lag T) of every sample, per pixel."""
    return P.samples(raster(spark, sf_dir), T, SKIP).select("year", "fire_id", "sample_idx", "lag", "obs_date", "y", "x")


@register("sample_counts", sql=f"""
select year, fire_id, count(distinct obs_date) as n_images, greatest(count(distinct obs_date) - {SKIP} - {T}, 0) as n_samples
from raster group by 1, 2""")
def q_sample_counts(spark, sf_dir):
    """Samples per fire."""
    return P.sample_counts(raster(spark, sf_dir), T, SKIP)


_COUNTS = f"""cnt as (select year, fire_id, greatest(count(distinct obs_date) - {SKIP} - {T}, 0) as n_samples
  from raster group by 1, 2),
offs as (select year, fire_id, n_samples,
  coalesce(sum(n_samples) over (order by year, fire_id rows between unbounded preceding and 1 preceding), 0) as "offset"
  from cnt)"""


@register("sample_offsets", sql=f"with {_COUNTS} select year, fire_id, n_samples, cast(\"offset\" as bigint) as \"offset\" from offs")
def q_sample_offsets(spark, sf_dir):
    """Running start index of each fire ordered by year and fire."""
    c = P.sample_counts(raster(spark, sf_dir), T, SKIP).drop("n_images")
    return P.sample_offsets(c)


@register("locate_sample", sql=f"""with {_COUNTS},
tot as (select sum(n_samples) as total from cnt),
q as (select event_id, case when event_id % 4 = 0 then -(event_id % total) - 1 else event_id % total end as global_idx
      from events, tot),
qn as (select event_id, global_idx, case when global_idx < 0 then global_idx + total else global_idx end as g from q, tot)
select qn.event_id, cast(qn.global_idx as bigint) as global_idx, o.year, o.fire_id, o.n_samples, cast(qn.g - o."offset" as bigint) as in_fire_idx
from qn join offs o on qn.g >= o."offset" and qn.g < o."offset" + o.n_samples""")
def q_locate_sample(spark, sf_dir):
    """C17: global sample index (negative counts from the end) -> (year, fire, in-fire index)."""
    c = P.sample_counts(raster(spark, sf_dir), T, SKIP).drop("n_images")
    offs = P.sample_offsets(c)
    total = c.select(F.sum("n_samples")).scalar()
    e = table(spark, sf_dir, "events")
    gi = F.when(F.col("event_id") % 4 == 0, -(F.col("event_id") % total) - 1).otherwise(F.col("event_id") % total)
    idx = e.select("event_id", gi.alias("global_idx"))
    return J.locate_sample(idx, offs).select("event_id", "global_idx", "year", "fire_id", "n_samples", "in_fire_idx")


# Fixed values in the oracle below: the twelve (train, val, test) year splits, in fold order.
@register("year_folds", sql=f"""with {_COUNTS},
f as (select * from (values
  (0, 2018, 'train'), (0, 2019, 'train'), (0, 2020, 'val'), (0, 2021, 'test'),
  (1, 2018, 'train'), (1, 2019, 'train'), (1, 2021, 'val'), (1, 2020, 'test'),
  (2, 2018, 'train'), (2, 2020, 'train'), (2, 2019, 'val'), (2, 2021, 'test'),
  (3, 2018, 'train'), (3, 2020, 'train'), (3, 2021, 'val'), (3, 2019, 'test'),
  (4, 2018, 'train'), (4, 2021, 'train'), (4, 2019, 'val'), (4, 2020, 'test'),
  (5, 2018, 'train'), (5, 2021, 'train'), (5, 2020, 'val'), (5, 2019, 'test'),
  (6, 2019, 'train'), (6, 2020, 'train'), (6, 2018, 'val'), (6, 2021, 'test'),
  (7, 2019, 'train'), (7, 2020, 'train'), (7, 2021, 'val'), (7, 2018, 'test'),
  (8, 2019, 'train'), (8, 2021, 'train'), (8, 2018, 'val'), (8, 2020, 'test'),
  (9, 2019, 'train'), (9, 2021, 'train'), (9, 2020, 'val'), (9, 2018, 'test'),
  (10, 2020, 'train'), (10, 2021, 'train'), (10, 2018, 'val'), (10, 2019, 'test'),
  (11, 2020, 'train'), (11, 2021, 'train'), (11, 2019, 'val'), (11, 2018, 'test')) t(fold, year, split))
select f.fold, f.split, cast(coalesce(sum(c.n_samples), 0) as bigint) as n_samples, count(c.fire_id) as n_fires
from f left join cnt c on c.year = f.year group by 1, 2""")
def q_year_folds(spark, sf_dir):
    """E5: samples and fires in the train / val / test years of each of the 12 folds."""
    c = P.sample_counts(raster(spark, sf_dir), T, SKIP)
    folds = P.fold_table(spark)
    j = folds.join(c, "year", "left")
    return j.groupBy("fold", "split").agg(F.coalesce(F.sum("n_samples"), F.lit(0)).cast("long").alias("n_samples"),
                                          F.count("fire_id").alias("n_fires"))


@register("keep_ignition_burning", sql=f"""with {_SAMPLES},
c as (select year, fire_id, sample_idx, count(*) filter (where af_mask = 1 and lag < {T}) as n_fire_pixels
      from sp group by 1, 2, 3)
select year, fire_id, sample_idx, n_fire_pixels, case when n_fire_pixels < 1 then 'ignition' else 'burning' end as kind
from c where n_fire_pixels < 1 or n_fire_pixels > 1""")
def q_keep_ignition_burning(spark, sf_dir):
    """Samples with no input fire pixel (ignition) and with more than one (burning)."""
    c = P.fire_pixel_counts(sample_pixels(spark, sf_dir), T=T)
    ig = P.keep_ignition(c).withColumn("kind", F.lit("ignition"))
    bu = P.keep_burning(c).withColumn("kind", F.lit("burning"))
    return ig.unionByName(bu)


@register("keep_ignition_burning_last_day", sql=f"""with {_SAMPLES},
c as (select year, fire_id, sample_idx, count(*) filter (where af_mask = 1 and lag = {T - 1}) as n_fire_pixels
      from sp where lag < {T} group by 1, 2, 3)
select year, fire_id, sample_idx, n_fire_pixels, case when n_fire_pixels < 1 then 'ignition' else 'burning' end as kind
from c where n_fire_pixels < 1 or n_fire_pixels > 1""")
def q_keep_ignition_burning_last_day(spark, sf_dir):
    """E6 on samples flattened over time: the fire pixels of the last input day decide."""
    c = P.fire_pixel_counts(sample_pixels(spark, sf_dir), T=T, last_day_only=True)
    ig = P.keep_ignition(c).withColumn("kind", F.lit("ignition"))
    bu = P.keep_burning(c).withColumn("kind", F.lit("burning"))
    return ig.unionByName(bu)


@register("ignition_report", sql=f"""with {_SAMPLES},
c as (select year, fire_id, sample_idx, count(*) filter (where af_mask = 1 and lag < {T}) as n from sp group by 1, 2, 3),
a as (select count(*) as total, count(*) filter (where n < 1) as ignition, count(*) filter (where n > 1) as burning from c)
select 'ignition' as subset, ignition as kept, total, round(ignition / total, 6) as share from a
union all select 'burning', burning, total, round(burning / total, 6) from a""")
def q_ignition_report(spark, sf_dir):
    """E6 report: kept / total for the ignition and burning filters."""
    return rounded(P.filter_report(P.fire_pixel_counts(sample_pixels(spark, sf_dir), T=T)))


@register("persistence", sql=f"""with {_SAMPLES},
last as (select * from sp where lag = {T - 1}),
mx as (select year, fire_id, sample_idx, max(af_hh) as mx from last group by 1, 2, 3)
select l.year, l.fire_id, l.sample_idx, l.y, l.x, l.af_mask as pred_all,
       cast(m.mx > 0 and l.af_hh = m.mx as int) as pred_last
from last l join mx m on l.year = m.year and l.fire_id = m.fire_id and l.sample_idx = m.sample_idx""")
def q_persistence(spark, sf_dir):
    """Persistence predictions: all fire pixels of the last input day, and only those of
    its latest detection hour."""
    return P.persistence_both(sample_pixels(spark, sf_dir), T)


_STATS = """long as (select year, 0 as band, b0 as v from raster union all select year, 7, b7 from raster
  union all select year, 16, cast(b16 as double) from raster union all select year, 22, b22 from raster),
st as (select band, case when band in (7, 13, 19, 16) then 0.0 else avg(v) end as mean,
              case when band in (7, 13, 19, 16) then 1.0 else stddev_pop(v) end as std,
              avg(case when v is null then 1.0 else 0.0 end) as missing_rate
       from long where year in (2018, 2019) group by band)"""


def raster_long(spark, sf_dir):
    r = raster(spark, sf_dir)
    return r.select("year", F.col("b0"), F.col("b7"), F.col("b16").cast("double"), F.col("b22")).unpivot(
        ["year"], ["b0", "b7", "b16", "b22"], "bname", "v").select(
        "year", F.regexp_extract("bname", r"b(\d+)", 1).cast("int").alias("band"), "v")


@register("band_statistics", sql=f"with {_STATS} select band, round(mean, 6) as mean, round(std, 6) as std, round(missing_rate, 6) as missing_rate from st")
def q_band_statistics(spark, sf_dir):
    """Per-band mean, std and missing rate over training years 2018 and 2019."""
    return rounded(agg.band_statistics(raster_long(spark, sf_dir), [2018, 2019]))


@register("positive_weight", sql=f"with {_STATS} select round(1.0 / (1 - missing_rate), 6) as pos_weight from st where band = 22")
def q_positive_weight(spark, sf_dir):
    """Positive-class weight from the active-fire missing rate."""
    s = agg.band_statistics(raster_long(spark, sf_dir), [2018, 2019])
    return rounded(agg.positive_weight(s))


@register("preprocess_pixels", sql=f"""with {_STATS}
select r.year, r.fire_id, r.obs_date, r.y, r.x,
  floor(coalesce(r.b22, 0) / 100) as af_hh,
  cast(floor(coalesce(r.b22, 0) / 100) > 0 as int) as af_mask,
  round(sin(radians(r.b7)), 6) as b7_sin,
  round(coalesce((r.b0 - (select mean from st where band = 0)) / (select std from st where band = 0), 0), 6) as b0_std,
  list_transform(range(0, 17), lambda i: cast(i = (((coalesce(r.b16, 0) - 1) % 17) + 17) % 17 as int)) as landcover
from raster r""")
def q_preprocess_pixels(spark, sf_dir):
    """H5-H9: fire band to hours, binary mask, sine of angles, standardised band, land-cover one-hot."""
    r = raster(spark, sf_dir)
    stats = agg.band_statistics(raster_long(spark, sf_dir), [2018, 2019])
    hh = P.clean_fire_band("b22")
    out = r.select("year", "fire_id", "obs_date", "y", "x", hh.alias("af_hh"), P.binary_mask(hh).alias("af_mask"),
                   P.degrees_to_sine("b7").alias("b7_sin"), F.col("b0").alias("b0_std"),
                   P.one_hot_landcover("b16").alias("landcover"))
    return rounded(P.standardise(out, stats, {"b0_std": 0}))


@register("center_crop", sql="select fire_id, obs_date, y - 4 as y, x - 4 as x, b0 from raster where y between 4 and 11 and x between 4 and 11")
def q_center_crop(spark, sf_dir):
    """Centred 8 x 8 crop of the 16 x 16 rasters."""
    return P.center_crop(raster(spark, sf_dir).select("fire_id", "obs_date", "y", "x", "b0"), 8, HW, HW)


@register("best_crop", sql=f"""with {_SAMPLES},
o as (select distinct year, fire_id, sample_idx from sp),
h as (select year, fire_id, sample_idx, (cast(year as bigint) * 1000003 + fire_id) % 2147483647 as h0 from o),
h2 as (select year, fire_id, sample_idx, (h0 * 1000003 + sample_idx) % 2147483647 as h from h),
c as (select year, fire_id, sample_idx, i as crop_i, ((h * 31 + i * 7919 + 42 * 104729) % 8 + 8) % 8 as top,
             ((h * 17 + i * 6007 + 42 * 15485863) % 8 + 8) % 8 as "left" from h2, range(0, 10) as t(i)),
hot as (select year, fire_id, sample_idx, y, x, case when lag < {T} then af_hh else 0.0 end as f,
               case when lag = {T} then af_mask else 0.0 end as l
        from sp where (lag < {T} and af_hh != 0) or (lag = {T} and af_mask != 0)),
s as (select c.year, c.fire_id, c.sample_idx, c.crop_i, c.top, c."left",
        coalesce(sum(hot.f), 0) / ({T} * 64) + 1000 * coalesce(sum(hot.l), 0) / 64 as score
      from c left join hot on hot.year = c.year and hot.fire_id = c.fire_id and hot.sample_idx = c.sample_idx
        and hot.y >= c.top and hot.y < c.top + 8 and hot.x >= c."left" and hot.x < c."left" + 8
      group by 1, 2, 3, 4, 5, 6)
select year, fire_id, sample_idx, arg_max(crop_i, (score, -crop_i)) as crop_i,
       arg_max(top, (score, -crop_i)) as top, arg_max("left", (score, -crop_i)) as "left"
from s group by 1, 2, 3""")
def q_best_crop(spark, sf_dir):
    """Best of 10 seeded 8 x 8 crops per sample."""
    sp = sample_pixels(spark, sf_dir).withColumn("label", F.col("af_mask"))
    return P.best_of_k_crops(sp, 10, 8, HW, HW, 42, T, fire="af_hh", label="label")


@register("flip_rotate", sql="""
select fire_id, obs_date, x as y, 15 - y as x, round((((((180 - (360 - b7)) % 360) + 360) % 360 - 90) % 360 + 360) % 360, 6) as b7
from raster""")
def q_flip_rotate(spark, sf_dir):
    """Horizontal flip, vertical flip, then a quarter turn, with angle corrections."""
    r = raster(spark, sf_dir).select("fire_id", "obs_date", "y", "x", "b7")
    r = P.flip_h(r, HW, ["b7"])
    r = P.flip_v(r, HW, ["b7"])
    return rounded(P.rotate_90(r, 1, HW, ["b7"]))


@register("zero_pad", sql="""
with o as (select distinct fire_id, obs_date from raster),
g as (select fire_id, obs_date, yy.y, xx.x from o, range(0, 20) as yy(y), range(0, 20) as xx(x))
select g.fire_id, g.obs_date, g.y, g.x, case when g.y between 2 and 17 and g.x between 2 and 17 then r.b0 else 0 end as b0
from g left join raster r on r.fire_id = g.fire_id and r.obs_date = g.obs_date and r.y + 2 = g.y and r.x + 2 = g.x""")
def q_zero_pad(spark, sf_dir):
    """Zero padding of the 16 x 16 rasters to 20 x 20."""
    r = raster(spark, sf_dir)
    return P.zero_pad(r, HW, HW, 20, ["fire_id", "obs_date"], ["b0"])


@register("flatten_time", sql=f"""with {_SAMPLES}
select year, fire_id, sample_idx, y, x,
  max(case when lag = 0 then b0 end) as b0_t0, max(case when lag = 0 then af_hh end) as af_hh_t0,
  max(case when lag = 1 then b0 end) as b0_t1, max(case when lag = 1 then af_hh end) as af_hh_t1,
  max(case when lag = 1 then b16 end) as b16_t1
from sp where lag < {T} group by 1, 2, 3, 4, 5""")
def q_flatten_time(spark, sf_dir):
    """Dynamic bands of every lag and static bands of the last lag, one row per pixel."""
    sp = P.select_bands(sample_pixels(spark, sf_dir), ["lag", "y", "x", "b0", "af_hh", "b16"], KEYS)
    return P.flatten_time(sp, T, ["b0", "af_hh"], ["b16"])


@register("tile_cover", sql="""
select fire_id, obs_date, y, x,
  case when y >= 10 then 2 else cast(floor(y / 6) as int) end as tile_i,
  case when x >= 10 then 2 else cast(floor(x / 6) as int) end as tile_j,
  cast(y - case when y >= 10 then 10 else floor(y / 6) * 6 end as int) as tile_y,
  cast(x - case when x >= 10 then 10 else floor(x / 6) * 6 end as int) as tile_x
from raster""")
def q_tile_cover(spark, sf_dir):
    """Tile and in-tile offset of every pixel for 6 x 6 tiles over 16 x 16 images."""
    return P.tile_cover(raster(spark, sf_dir).select("fire_id", "obs_date", "y", "x"), HW, HW, 6, 6)


_FOCAL = """n as (select r.fire_id, r.obs_date, r.y, r.x,
  coalesce(max(case when q.y = r.y - 1 and q.x = r.x - 1 then q.b0 end), 0) as n_mm,
  coalesce(max(case when q.y = r.y - 1 and q.x = r.x then q.b0 end), 0) as n_mz,
  coalesce(max(case when q.y = r.y - 1 and q.x = r.x + 1 then q.b0 end), 0) as n_mp,
  coalesce(max(case when q.y = r.y and q.x = r.x - 1 then q.b0 end), 0) as n_zm,
  coalesce(max(case when q.y = r.y and q.x = r.x then q.b0 end), 0) as n_zz,
  coalesce(max(case when q.y = r.y and q.x = r.x + 1 then q.b0 end), 0) as n_zp,
  coalesce(max(case when q.y = r.y + 1 and q.x = r.x - 1 then q.b0 end), 0) as n_pm,
  coalesce(max(case when q.y = r.y + 1 and q.x = r.x then q.b0 end), 0) as n_pz,
  coalesce(max(case when q.y = r.y + 1 and q.x = r.x + 1 then q.b0 end), 0) as n_pp
from raster r join raster q on q.fire_id = r.fire_id and q.obs_date = r.obs_date
  and q.y between r.y - 1 and r.y + 1 and q.x between r.x - 1 and r.x + 1
group by 1, 2, 3, 4)"""


@register("focal_3x3", sql=f"with {_FOCAL} select * from n")
def q_focal_3x3(spark, sf_dir):
    """Zero-padded 3 x 3 neighbourhood of every pixel."""
    r = raster(spark, sf_dir).select("fire_id", "obs_date", "y", "x", "b0")
    return P.focal_3x3(r, ["fire_id", "obs_date"], "b0", HW, HW)


FIT_STEPS, FIT_RIDGE = 5, 1e-3
_SIDES = [f"{dy}{dx}" for dy in "mzp" for dx in "mzp"]
CLASSIFIER_FEATURES = [f"b0_{s}" for s in _SIDES] + [f"af_{s}" for s in _SIDES] + ["wind_sine", "burnable"]


def classifier_rows(spark, sf_dir):
    """Per pixel of a sample's last input day: 3 x 3 of reflectance and of the fire mask, sine of the wind
    direction, whether the land cover is one of the first eleven classes; the label is the next image's mask."""
    sp = sample_pixels(spark, sf_dir)
    last = sp.filter(F.col("lag") == T - 1)
    at = [*KEYS, "y", "x"]
    wide = last.select(*at, P.degrees_to_sine("b7").alias("wind_sine"), (F.col("b16") < 11).cast("double").alias("burnable"))
    for band, c in (("b0", "b0"), ("af", "af_mask")):
        near = P.focal_3x3(last.select(*at, F.col(c).cast("double").alias("v")), KEYS, "v", HW, HW)
        wide = wide.join(near.withColumnsRenamed({f"n_{s}": f"{band}_{s}" for s in _SIDES}), at)
    label = sp.filter(F.col("lag") == T).select(*at, F.col("af_mask").cast("double").alias("label"))
    return wide.join(label, at, "left").na.fill(0.0, ["label"])


def _classifier_sql() -> str:
    """The same fit in SQL: rows per pair of training years, five Newton steps, elimination without pivots."""
    m = len(CLASSIFIER_FEATURES) + 1
    near = ", ".join(f"coalesce(max(case when q.y = r.y + {dy} and q.x = r.x + {dx} then q.{c} end), 0) as {b}_{s}"
                     for b, c in (("b0", "b0"), ("af", "af_mask"))
                     for s, (dy, dx) in zip(_SIDES, [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    x = ["1.0", *CLASSIFIER_FEATURES]
    ctes = [f"""last as (select * from sp where lag = {T - 1}),
feat as materialized (select r.year, r.fire_id, r.sample_idx, r.y, r.x, any_value(sin(radians(r.b7))) as wind_sine,
  any_value(cast(r.b16 < 11 as int)) as burnable, {near}, any_value(coalesce(l.af_mask, 0)) as label
  from last r join last q on q.year = r.year and q.fire_id = r.fire_id and q.sample_idx = r.sample_idx
    and q.y between r.y - 1 and r.y + 1 and q.x between r.x - 1 and r.x + 1
  left join (select * from sp where lag = {T}) l on l.year = r.year and l.fire_id = r.fire_id
    and l.sample_idx = r.sample_idx and l.y = r.y and l.x = r.x
  group by r.year, r.fire_id, r.sample_idx, r.y, r.x)""",
            """fold as (select * from (values """ + ", ".join(f"({f}, {y}, '{s}')" for f, y, s in P.year_folds()) + """) t(fold, year, split)),
pairs as (select distinct fold // 2 as model, year from fold where split = 'train')""",
            """base as materialized (select p.model, f.*, case when f.label = 1 then count(*) over (partition by p.model)
  / cast(sum(f.label) over (partition by p.model) as double) else 1.0 end as w from feat f join pairs p on p.year = f.year)""",
            f"b0 as materialized (select distinct model, list_value({', '.join(['0.0::double'] * m)}) as beta from base)"]
    for k in range(FIT_STEPS):
        z = " + ".join(f"b.beta[{i + 1}] * {c}" for i, c in enumerate(x))
        sums = ", ".join([f"sum(q * {x[i]} * {x[j]}) as h{i}_{j}" for i in range(m) for j in range(i, m)]
                         + [f"sum(r * {c}) as g{i}" for i, c in enumerate(x)])
        rows = ", ".join("list_value(" + ", ".join(
            [f"h{min(i, j)}_{max(i, j)} / n" + (f" + {FIT_RIDGE}" if i == j else "") for j in range(m)]
            + [f"g{i} / n - {FIT_RIDGE} * beta[{i + 1}]"]) + ")" for i in range(m))
        ctes += [f"""s{k} as materialized (select model, any_value(beta) as beta, sum(w) as n, {sums} from (
  select *, w * p * (1 - p) as q, w * (label - p) as r from (
    select d.*, b.beta, 1 / (1 + exp(-({z}))) as p from base d join b{k} b on b.model = d.model)) group by model)""",
                 f"""e{k} as (select model, beta, 1 as piv, list_value({rows}) as a from s{k}
  union all select model, beta, piv + 1, list_transform(a, lambda u, i: case when i = piv then u
    else list_transform(u, lambda v, j: v - u[piv] / a[piv][piv] * a[piv][j]) end) from e{k} where piv <= {m})""",
                 f"""b{k + 1} as materialized (select model, list_transform(beta, lambda v, i: v + a[i][{m + 1}] / a[i][i]) as beta
  from e{k} where piv = {m + 1})"""]
    z = " + ".join(f"b.beta[{i + 1}] * {c}" for i, c in enumerate(x))
    body = ",\n".join(ctes)
    return f"""with recursive {_SAMPLES},
{body}
select t.fold, f.year, f.fire_id, f.sample_idx, f.y, f.x, cast(f.label as int) as label,
       round(1 / (1 + exp(-({z}))), 6) as score
from feat f join fold t on t.year = f.year and t.split = 'test' left join b{FIT_STEPS} b on b.model = t.fold // 2"""


@register("fire_classifier", sql=_classifier_sql())
def q_fire_classifier(spark, sf_dir):
    """H20 (+H19, E5, D20): next-day fire by logistic regression, fitted on the training years of each of the
    twelve folds with their positive-class weight and scored on the fold's test year."""
    rows = cut_lineage(classifier_rows(spark, sf_dir))
    folds = P.fold_table(spark)
    pairs = folds.filter("split = 'train'").select(F.expr("fold div 2").cast("int").alias("model"), "year").distinct()
    train = rows.join(F.broadcast(pairs), "year")  # twelve rows
    share = train.groupBy("model").agg(F.try_divide(F.count("label"), F.sum("label")).alias("_up"))
    up = F.when(F.col("label") == 1, F.col("_up")).otherwise(1.0).alias("weight")
    train = cut_lineage(train.join(F.broadcast(share), "model").select("model", "label", up, *CLASSIFIER_FEATURES))  # read by every step
    fitted = newton_fit(train, CLASSIFIER_FEATURES, steps=FIT_STEPS, ridge=FIT_RIDGE)
    models = spark.createDataFrame([(m, b.tolist()) for m, b in fitted.items()], "model int, beta array<double>")
    test = rows.join(F.broadcast(folds.filter("split = 'test'")), "year").withColumn("model", F.expr("fold div 2").cast("int"))
    scored = test.join(F.broadcast(models), "model", "left")  # six rows
    return scored.select("fold", *KEYS, "y", "x", F.col("label").cast("int").alias("label"),
                         F.round(fire_probability(F.col("beta"), CLASSIFIER_FEATURES), 6).alias("score"))


@register("prediction_table", sql=f"""with {_SAMPLES},
i as (select year, fire_id, sample_idx, y, x, af_mask as input_mask from sp where lag = {T - 1}),
l as (select year, fire_id, sample_idx, y, x, af_mask as label from sp where lag = {T})
select coalesce(i.year, l.year) as year, coalesce(i.fire_id, l.fire_id) as fire_id,
       coalesce(i.sample_idx, l.sample_idx) as sample_idx, coalesce(i.y, l.y) as y, coalesce(i.x, l.x) as x,
       i.input_mask, i.input_mask as pred, l.label
from i full join l on i.year = l.year and i.fire_id = l.fire_id and i.sample_idx = l.sample_idx and i.y = l.y and i.x = l.x""")
def q_prediction_table(spark, sf_dir):
    """Input mask, persistence prediction and label per (sample, pixel)."""
    return P.prediction_table(sample_pixels(spark, sf_dir), T)


@register("zero_pad_missing", sql="""
with o as (select distinct fire_id, obs_date from raster),
g as (select fire_id, obs_date, yy.y, xx.x from o, range(0, 20) as yy(y), range(0, 20) as xx(x))
select g.fire_id, g.obs_date, g.y, g.x, case when g.y between 2 and 17 and g.x between 2 and 17 then r.b22 else 0 end as b22
from g left join raster r on r.fire_id = g.fire_id and r.obs_date = g.obs_date and r.y + 2 = g.y and r.x + 2 = g.x""")
def q_zero_pad_missing(spark, sf_dir):
    """A band with missing values inside the image: the border is zero, the inside stays missing."""
    r = raster(spark, sf_dir)
    return P.zero_pad(r, HW, HW, 20, ["fire_id", "obs_date"], ["b22"])


@register("binary_label", sql="""
select fire_id, obs_date, y, x, cast(coalesce(hhmm, 0) > 0 as int) as label,
       cast(floor(coalesce(hhmm, 0) / 100) > 0 as int) as floored
from (select fire_id, obs_date, y, x, case when b22 is null then null when x % 2 = 0 then cast(30 as double) else b22 end as hhmm from raster)""")
def q_binary_label(spark, sf_dir):
    """H5, H6: the label from the raw detection time (half past midnight counts) beside the mask of the
    floored hour (where it does not)."""
    hhmm = F.when(F.col("b22").isNotNull(), F.when(F.col("x") % 2 == 0, F.lit(30.0)).otherwise(F.col("b22")))
    r = raster(spark, sf_dir).select("fire_id", "obs_date", "y", "x", hhmm.alias("hhmm"))
    return r.select("fire_id", "obs_date", "y", "x", P.binary_label("hhmm").alias("label"),
                    P.binary_mask(P.clean_fire_band("hhmm")).alias("floored"))


@register("with_band_names", sql="""
with long as (select fire_id, obs_date, y, x, 0 as band, b0 as v from raster
              union all select fire_id, obs_date, y, x, 22, b22 from raster where b22 is not null),
names as (select * from (values (0, 'M11'), (22, 'active fire')) t(band, band_name))
select l.fire_id, l.obs_date, l.y, l.x, cast(l.band as int) as band, l.v, n.band_name from long l left join names n on l.band = n.band""")
def q_with_band_names(spark, sf_dir):
    """Band index -> band name on the long pixel table."""
    r = raster(spark, sf_dir)
    a = r.select("fire_id", "obs_date", "y", "x", F.lit(0).alias("band"), F.col("b0").alias("v"))
    b = r.filter(F.col("b22").isNotNull()).select("fire_id", "obs_date", "y", "x", F.lit(22).alias("band"),
                                                  F.col("b22").alias("v"))
    return J.with_band_names(a.unionByName(b))


def raster_files(spark, sf_dir):
    """File listing of the rasters (one .tif per fire-day) plus unparseable junk names."""
    r = raster(spark, sf_dir)
    good = r.select(F.concat(F.col("year").cast("string"), F.lit("/fire_"), F.col("fire_id").cast("string"),
                             F.lit("/"), F.date_format("obs_date", "yyyy-MM-dd"), F.lit(".tif")).alias("path"))
    junk = r.filter(F.col("x") == 0).select(F.concat(F.col("year").cast("string"), F.lit("/fire_"),
                                                     F.col("fire_id").cast("string"), F.lit("/notes.txt")).alias("path"))
    return good.unionByName(junk)


@register("stack_inventory", sql="""
with files as (select year || '/fire_' || fire_id || '/' || strftime(obs_date, '%Y-%m-%d') || '.tif' as path from raster
               union all select year || '/fire_' || fire_id || '/notes.txt' from raster where x = 0),
p as (select cast(regexp_extract(path, '(\\d{4})/', 1) as int) as year, cast(regexp_extract(path, 'fire_(\\d+)/', 1) as bigint) as fire_id,
             cast(try_strptime(regexp_extract(path, '(\\d{4}-\\d{2}-\\d{2})\\.tif$', 1), '%Y-%m-%d') as date) as obs_date from files),
inv as (select year, fire_id, count(distinct obs_date) as n_images, min(obs_date) as first_date, max(obs_date) as last_date
        from p where obs_date is not null group by 1, 2),
f as (select distinct user_id % 10 as fire_id from events)
select f.fire_id, inv.year, coalesce(inv.n_images, 0) as n_images, inv.first_date, inv.last_date, inv.n_images is not null as has_images
from f left join inv on f.fire_id = inv.fire_id""")
def q_stack_inventory(spark, sf_dir):
    """A5: rasters per fire from a file listing; catalog fires without images flagged."""
    fires = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("fire_id"))
    return P.stack_inventory(raster_files(spark, sf_dir), fires)


@register("write_fire_stacks", sql=f"""
select year, fire_id, obs_date, list(cast(y * {HW} + x as int) order by y * {HW} + x) as pixel, list(round(b0, 6) order by y * {HW} + x) as b0,
  list(b22 order by y * {HW} + x) as b22 from raster group by 1, 2, 3""")
def q_write_fire_stacks(spark, sf_dir):
    """A9 sink: the images of a third of the fires are written, then those of all fires, twice, the last time
    in place; what is read back holds every image once."""
    from ashgrid.plans.io_queries import scratch
    r = raster(spark, sf_dir)
    path = f"{scratch(spark, 'stacks')}/fires"
    P.write_fire_stacks(r.filter(F.col("fire_id") % 3 == 0), path, ["b0", "b22"], HW)
    for again in (False, True):
        P.write_fire_stacks(r, path, ["b0", "b22"], HW, rewrite=again)
    got = spark.read.parquet(path).select("year", F.col("fire_id").cast("long").alias("fire_id"), "obs_date", "pixel", "b0", "b22")
    return got.withColumn("b0", F.transform("b0", lambda v: F.round(v, 6)))


@register("pack_fire_stack", sql="""
select year, fire_id, list_sort(list(distinct obs_date)) as dates, count(*) as n_pixels
from raster where fire_id not in (select fire_id from raster where fire_id < 2) group by 1, 2""")
def q_pack_fire_stack(spark, sf_dir):
    """One record per fire not yet written (fires 0 and 1 count as written)."""
    r = raster(spark, sf_dir)
    done = r.filter(F.col("fire_id") < 2).select("year", "fire_id").distinct()
    return P.pack_fire_stack(r, done)
