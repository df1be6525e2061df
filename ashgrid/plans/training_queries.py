"""Registered query of the end-to-end training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashgrid.operators import aggregates as agg
from ashgrid.operators import training as TR
from ashgrid.plans.catalog import register, rounded
from ashgrid.plans.pixel_queries import HW, SKIP, T
from ashgrid.sources.fixtures import raster

CROP = 8


def _band_sql(i: int) -> str:
    if i == 22:
        return "b22"
    if i == 16:
        return "cast(b16 as double)"
    v = f"((b0 * {i + 1}) % 360 + 360) % 360" if i in (7, 13, 19) else f"(b0 * {i + 1}) % {50 + i}"
    return f"case when (y + x + {i}) % 31 = 0 then null else {v} end"


def raster23(spark, sf_dir):
    """The fire rasters with all 23 bands, some values missing (null or NaN), hours from half past midnight."""
    r = raster(spark, sf_dir)
    v, gap = F.col("b0"), lambda i: (F.col("y") + F.col("x") + i) % 31 == 0
    cols = []
    for i in range(23):
        if i == 22:
            c = F.col("b22")
        elif i == 16:
            c = F.col("b16").cast("double")
        else:
            c = F.pmod(v * (i + 1), F.lit(360.0)) if i in (7, 13, 19) else v * (i + 1) % (50 + i)
            c = F.when(~gap(i), c).otherwise(F.lit(float("nan")) if i % 2 else F.lit(None))
        cols.append(c.alias(f"b{i}"))
    return r.select("year", "fire_id", "obs_date", "y", "x", *cols)


def bands_long(pixels):
    """(year, band, v) of all bands; NaN as missing."""
    return pixels.select("year", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.when(~F.isnan(F.col(f"b{i}")), F.col(f"b{i}")).alias("v"))
                                                     for i in range(23)])).alias("e")).select("year", "e.*")


def _oracle() -> str:
    bands = ",\n".join(f"{_band_sql(i)} as c{i}" for i in range(23))
    union = " union all ".join(f"select year, {i} as band, c{i} as v from px" for i in range(23))
    fixed = "(7, 13, 16, 19)"
    chan = []
    for i in range(23):
        if i == 16:
            chan += [f"cast({k} = (((coalesce(cast(c16 as int), 0) - 1) % 17) + 17) % 17 as double)" for k in range(17)]
            continue
        e = f"sin(radians(c{i}))" if i in (7, 13, 19) else ("hh" if i == 22 else f"c{i}")
        chan.append(f"coalesce(({e} - (select mean from st where band = {i})) / (select std from st where band = {i}), 0.0)")
    chan.append("cast(hh > 0 as double)")
    dyn = TR.DYNAMIC_CHANNELS
    feats = ", ".join([f"coalesce(l0[{c + 1}], 0.0)" for c in dyn] + [f"coalesce(l1[{c + 1}], 0.0)" for c in range(40)])
    return f"""with px as (select year, fire_id, obs_date, y, x, {bands} from raster),
long as ({union}),
st as (select band, case when band in {fixed} then 0.0 else avg(v) end as mean,
              case when band in {fixed} then 1.0 else stddev_pop(v) end as std from long where year in (2018, 2019) group by band),
img as (select year, fire_id, obs_date, row_number() over (partition by year, fire_id order by obs_date) - 1 as img_idx,
    count(*) over (partition by year, fire_id) as n from (select distinct year, fire_id, obs_date from px)),
smp as (select i.year, i.fire_id, i.obs_date, i.img_idx - {SKIP} - l.lag as sample_idx, l.lag
  from img i, range(0, {T + 1}) as l(lag)
  where i.img_idx - {SKIP} - l.lag >= 0 and i.img_idx - {SKIP} - l.lag < i.n - {SKIP} - {T}),
sp as (select r.*, s.sample_idx, s.lag, floor(coalesce(r.c22, 0) / 100) as hh, cast(coalesce(r.c22, 0) > 0 as int) as label
  from px r join smp s on r.year = s.year and r.fire_id = s.fire_id and r.obs_date = s.obs_date),
o as (select distinct year, fire_id, sample_idx from sp),
h as (select year, fire_id, sample_idx, (cast(year as bigint) * 1000003 + fire_id) % 2147483647 as h0 from o),
h2 as (select year, fire_id, sample_idx, (h0 * 1000003 + sample_idx) % 2147483647 as h from h),
c as (select year, fire_id, sample_idx, i as crop_i, ((h * 31 + i * 7919 + 42 * 104729) % 8 + 8) % 8 as top,
             ((h * 17 + i * 6007 + 42 * 15485863) % 8 + 8) % 8 as "left" from h2, range(0, 10) as t(i)),
hot as (select year, fire_id, sample_idx, y, x, case when lag < {T} then hh else 0.0 end as f,
               case when lag = {T} then label else 0.0 end as l
        from sp where (lag < {T} and hh != 0) or (lag = {T} and label != 0)),
sc as (select c.year, c.fire_id, c.sample_idx, c.crop_i, c.top, c."left",
        coalesce(sum(hot.f), 0) / ({T} * 64) + 1000 * coalesce(sum(hot.l), 0) / 64 as score
      from c left join hot on hot.year = c.year and hot.fire_id = c.fire_id and hot.sample_idx = c.sample_idx
        and hot.y >= c.top and hot.y < c.top + 8 and hot.x >= c."left" and hot.x < c."left" + 8 group by 1, 2, 3, 4, 5, 6),
best as (select year, fire_id, sample_idx, arg_max(top, (score, -crop_i)) as top, arg_max("left", (score, -crop_i)) as "left" from sc group by 1, 2, 3),
cut as (select sp.*, sp.y - b.top as cy, sp.x - b."left" as cx from sp
  join best b on b.year = sp.year and b.fire_id = sp.fire_id and b.sample_idx = sp.sample_idx
  where sp.y >= b.top and sp.y < b.top + {CROP} and sp.x >= b."left" and sp.x < b."left" + {CROP}),
ch as (select year, fire_id, sample_idx, cy as y, cx as x, lag, label, [{', '.join(chan)}] as c from cut),
lags as (select year, fire_id, sample_idx, y, x, max(case when lag = 0 then c end) as l0, max(case when lag = 1 then c end) as l1,
                max(case when lag = {T} then label end) as label from ch group by 1, 2, 3, 4, 5)
select year, fire_id, sample_idx, y, x, coalesce(label, 0) as label, list_transform([{feats}], lambda v: round(v, 6)) as features from lags"""


@register("training_samples", sql=_oracle())
def q_training_samples(spark, sf_dir):
    """Samples of all 23 bands to 40 channels, cropped, flattened over time."""
    px = raster23(spark, sf_dir)
    stats = agg.band_statistics(bands_long(px), [2018, 2019])
    return rounded(TR.training_samples(px, stats, T, SKIP, crop=CROP, height=HW, width=HW))


def _names_oracle() -> str:
    from ashgrid.operators.joins import BAND_NAMES
    union = "\nunion all ".join(f"select fire_id, obs_date, y, x, {i} as band, {_band_sql(i)} as v from raster" for i in range(23))
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(BAND_NAMES))
    return f"""with long as ({union}),
names as (select * from (values {names}) t(band, band_name))
select n.band_name, cast(l.band as int) as band, count(*) as n, count(v) as present, round(avg(v), 6) as mean
from long l left join names n on l.band = n.band group by 1, 2"""


@register("band_summary", sql=_names_oracle())
def q_band_summary(spark, sf_dir):
    """C18 over all 23 bands: named bands with their number of pixels, present values and mean."""
    from ashgrid.operators.joins import with_band_names
    long = bands_long(raster23(spark, sf_dir))
    named = with_band_names(long)
    return rounded(named.groupBy("band_name", "band").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("present"), F.avg("v").alias("mean")))
