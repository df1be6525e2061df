"""Registered queries on inputs the plain fixtures lack: NaN, repeated ids, integer hours, grids that
are not aligned with the pixels, polygons against a region, all twelve folds with logits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ashgrid.functions import columns as C
from ashgrid.operators import aggregates as agg
from ashgrid.operators import evaluate as E
from ashgrid.operators import geometry as GEO
from ashgrid.operators import joins as J
from ashgrid.operators import pixels as P
from ashgrid.plans.catalog import register, rounded
from ashgrid.plans.io_queries import _RING_SQL, _usa_edges_sql, fire_rings
from ashgrid.plans.join_queries import _DAILY, _grid_axes, daily_records
from ashgrid.plans.pixel_queries import T, _SAMPLES, _STATS, raster_long, sample_pixels
from ashgrid.sources.fixtures import fire, grid_cell, pixel_obs, raster, sensor_obs, table


def nan_obs(spark, sf_dir):
    """Readings where every 19th measurement and every 23rd estimate is NaN."""
    nan = F.lit(float("nan"))
    o = sensor_obs(spark, sf_dir)
    return o.withColumns({"pm25": F.when(F.col("event_id") % 19 == 0, nan).otherwise(F.col("pm25")),
                          "est_b": F.when(F.col("event_id") % 23 == 0, nan).otherwise(F.col("est_b"))})


_NAN = """nobs as (select event_id, time, lat, lon, case when event_id % 19 = 0 then null else pm25 end as pm25,
  case when event_id % 23 = 0 then null else est_b end as est_b from sensor_obs)"""


@register("positive_pairs_nan", sql=f"""with {_NAN}
select event_id from nobs where pm25 > 0 and est_b > 0""")
def q_positive_pairs_nan(spark, sf_dir):
    """B7 with NaN in both columns and no upper limit: a missing value is not positive."""
    return C.positive_pairs(nan_obs(spark, sf_dir), "pm25", "est_b").select("event_id")


@register("correlation_by_bin_nan", sql=f"""with {_NAN}
select * from (
  select cast(floor(pm25 / 50) * 50 as double) as bin,
    round(covar_pop(est_b, pm25) / nullif(stddev_pop(case when est_b is not null then pm25 end)
          * stddev_pop(est_b), 0), 6) as correlation
  from nobs where pm25 is not null group by 1) t
where correlation is not null""")
def q_correlation_by_bin_nan(spark, sf_dir):
    """D7 with NaN: missing pairs are skipped, bins stay defined."""
    return rounded(agg.correlation_by_bin(nan_obs(spark, sf_dir), "pm25", "est_b"))


@register("histogram_nan", sql=f"""with {_NAN},
d as (select pm25 as v from nobs where pm25 is not null),
s as (select min(v) as mn, max(v) as mx from d),
c as (select cast(coalesce(least(floor((v - mn) / ((mx - mn) / 50)), 49), 0) as int) as bin, count(*) as n from d, s group by 1),
g as (select cast(range as int) as bin from range(50))
select g.bin, round(mn + g.bin * (mx - mn) / 50, 6) as lo, round(mn + (g.bin + 1) * (mx - mn) / 50, 6) as hi, coalesce(c.n, 0) as n
from g cross join s left join c on g.bin = c.bin""")
def q_histogram_nan(spark, sf_dir):
    """D14 with NaN: bounds and counts over the present values."""
    return rounded(agg.histogram(nan_obs(spark, sf_dir), "pm25"))


@register("daily_mean_grid_nan", sql=f"""with {_NAN}
select cast(time as date) as date, lat, lon, round(avg(pm25), 6) as pm25 from nobs group by 1, 2, 3""")
def q_daily_mean_grid_nan(spark, sf_dir):
    """D17 with NaN: missing hours are skipped."""
    return rounded(agg.daily_mean_grid(nan_obs(spark, sf_dir), "time", ["lat", "lon"], "pm25"))


@register("normalise_integer_hours", sql="""
select event_id, cast(ts as date) + to_hours(hour(ts)) as time, value as pm25 from events""")
def q_normalise_integer_hours(spark, sf_dir):
    """B1: the hour given as a whole number instead of "HH:MM"."""
    e = table(spark, sf_dir, "events")
    raw = e.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("Date GMT"), F.hour("ts").alias("Time GMT"),
                   F.lit(30.0).alias("Latitude"), F.lit(-120.0).alias("Longitude"), F.col("value").alias("Sample Measurement"))
    return C.normalise_sensor(raw, keep=["event_id"]).select("event_id", "time", "pm25")


@register("step_time_bad_day", sql="""
select event_id, case when event_id % 3 = 2 then null else
  timestamp '2023-01-01' + to_days(cast(case when event_id % 3 = 0 then 365 else event_id % 300 end as int)) + to_hours(cast(event_id % 48 as int)) end as time
from events""")
def q_step_time_bad_day(spark, sf_dir):
    """Day 366 of a common year rolls over; text of another form gives null instead of failing."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    day = F.when(i % 3 == 0, F.lit(366)).otherwise(i % 300 + 1)
    s = F.when(i % 3 == 2, F.lit("2023-12")).otherwise(F.concat(F.lit("2023"), F.lpad(day.cast("string"), 3, "0")))
    return e.select("event_id", C.step_time(s, (i % 48).cast("int")).alias("time"))


@register("sample_linear_repeated", sql="""
with pts as (select event_id, station_id, lat + 0.1 * (station_id % 3) as plat, lon + 0.3 * (station_id % 4) as plon from sensor_obs),
ax as (select max(y) as ymax from grid_cell),
b as (select event_id, (plat - 30) / 0.25 as py, (plon + 120) / 0.75 as px,
        plat between 30 and 30 + ymax * 0.25 and plon between -120 and -120 + 39 * 0.75 as inside from pts, ax),
c as (select *, floor(py) as y0, floor(px) as x0, py - floor(py) as fy, px - floor(px) as fx from b),
k as (select c.event_id, (case when dy = 1 then fy else 1 - fy end) * (case when dx = 1 then fx else 1 - fx end) as w,
        cast(y0 + dy as bigint) as cy, cast(x0 + dx as bigint) as cx
      from c, (values (0), (1)) a(dy), (values (0), (1)) b2(dx) where inside),
s as (select k.event_id, case when count(*) filter (where g.v is null) = 0 then sum(k.w * g.v) end as v
      from k left join grid_cell g on g.y = k.cy and g.x = k.cx where k.w > 0 group by 1)
select p.station_id, round(s.v, 6) as v from pts p left join s on p.event_id = s.event_id""")
def q_sample_linear_repeated(spark, sf_dir):
    """A station's readings repeat its id and position; every row gets its own value."""
    o = sensor_obs(spark, sf_dir).select("station_id", (F.col("lat") + 0.1 * (F.col("station_id") % 3)).alias("lat"),
                                         (F.col("lon") + 0.3 * (F.col("station_id") % 4)).alias("lon"))
    ay, ax = _grid_axes(spark, sf_dir)
    return rounded(J.sample_linear(o, grid_cell(spark, sf_dir), ay, ax, "v").select("station_id", "v"))


FIELD_Y, FIELD_X = J.RegularAxis(30.0, 1.5, 6), J.RegularAxis(-120.0, 3.0, 6)


@register("append_grid_fields", sql="""
with hourly as (select ts as time, event_id % 6 as y, (event_id // 6) % 6 as x, case when event_id % 17 = 0 then null else value * 0.73105857863 end as v,
    (event_id % 6 + (event_id // 6) % 6 + dayofmonth(ts)) % 5 as qflag from events where dayofmonth(ts) not in (3, 17)),
d as (select cast(time as date) as day, y, x, avg(v) as v, min(qflag) as qflag from hourly group by 1, 2, 3),
p as (select fire_id, obs_date, y, x, 30 + fire_id * 0.8 + y * 0.07 as lat, -120 + fire_id * 1.5 + x * 0.11 as lon from pixel_obs
      where obs_date in (select day from d)),
b as (select *, (lat - 30) / 1.5 as py, (lon + 120) / 3.0 as px from p),
c as (select *, floor(py) as y0, floor(px) as x0, py - floor(py) as fy, px - floor(px) as fx from b),
k as (select c.fire_id, c.obs_date, c.y, c.x, (case when dy = 1 then fy else 1 - fy end) * (case when dx = 1 then fx else 1 - fx end) as w,
        cast(y0 + dy as bigint) as cy, cast(x0 + dx as bigint) as cx
      from c, (values (0), (1)) a(dy), (values (0), (1)) b2(dx)),
s as (select k.fire_id, k.obs_date, k.y, k.x, case when count(*) filter (where d.v is null) = 0 then sum(k.w * d.v) end as v
      from k left join d on d.day = k.obs_date and d.y = k.cy and d.x = k.cx where k.w > 0 group by 1, 2, 3, 4)
select b.fire_id, b.obs_date, b.y, b.x, round(s.v, 6) as v, n.qflag
from b join s on b.fire_id = s.fire_id and b.obs_date = s.obs_date and b.y = s.y and b.x = s.x
left join d n on n.day = b.obs_date and n.y = cast(ceil(b.py - 0.5) as bigint) and n.x = cast(ceil(b.px - 0.5) as bigint)""")
def q_append_grid_fields(spark, sf_dir):
    """C10, H1, H2 by coordinates: daily mean interpolated bilinearly and nearest flag appended to pixels of
    a grid that is not aligned with theirs; hours with NaN and days without a grid."""
    e = table(spark, sf_dir, "events").filter(~F.dayofmonth("ts").isin(3, 17))
    i = F.col("event_id")
    y, x = i % 6, F.floor(i / 6) % 6
    hourly = e.select(F.col("ts").alias("time"), y.alias("gy"), x.alias("gx"),
                      F.when(i % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value") * 0.73105857863).alias("v"),
                      ((y + x + F.dayofmonth("ts")) % 5).alias("qflag"))
    p = pixel_obs(spark, sf_dir).select("fire_id", "obs_date", "y", "x", (30 + F.col("fire_id") * 0.8 + F.col("y") * 0.07).alias("lat"),
                                        (-120 + F.col("fire_id") * 1.5 + F.col("x") * 0.11).alias("lon"))
    out = J.append_grid_fields(p, hourly, FIELD_Y, FIELD_X, ["v"], ["qflag"], cell_y="gy", cell_x="gx")
    return rounded(out.select("fire_id", "obs_date", "y", "x", "v", "qflag"))


_POLYGON = f"""{_RING_SQL},
{_usa_edges_sql()},
vert as (select r.fire_id, r.k, count(*) filter (where (g.y0 > r.y) != (g.y1 > r.y)
           and r.x < (g.x1 - g.x0) * (r.y - g.y0) / (g.y1 - g.y0) + g.x0) % 2 = 1 as inside
         from rings r, edges g where r.k < 5 group by 1, 2),
meets as (select fire_id from vert group by 1 having bool_or(inside))"""


@register("fires_meeting_region", sql=f"""with {_POLYGON}
select fire_id from meets""")
def q_fires_meeting_region(spark, sf_dir):
    """Fires whose perimeter polygon intersects the contiguous-US outline."""
    return GEO.polygons_in_region(fire_rings(spark, sf_dir)).select("fire_id")


@register("polygon_fire_selection", sql=f"""with {_DAILY},
{_POLYGON},
ar as (select fire_id, abs(sum((radians(x1) - radians(x0)) * (2 + sin(radians(y0)) + sin(radians(y1))))) * 6378137.0 * 6378137.0 / 2 as area_m2
       from e group by 1),
f as (select fire.fire_id, fire.idate, fire.fdate, ar.area_m2 from fire join ar on fire.fire_id = ar.fire_id join meets on meets.fire_id = fire.fire_id
      where ar.area_m2 >= 1e7 and ar.area_m2 < 1e20 and fire.idate >= timestamp '2024-01-01' and fire.idate < timestamp '2024-01-31'),
coll as (select fire_id, event_id, time, lat, lon, cast(year(time) as int) as year from daily),
j as (select f.fire_id, c.lat, c.lon, abs(epoch_us(c.time) - epoch_us(f.idate)) as dist, c.time, c.event_id
      from f join coll c on c.fire_id = f.fire_id and c.year between year(f.idate) and year(f.fdate)),
b as (select fire_id, arg_min(lat, (dist, time, event_id)) as lat, arg_min(lon, (dist, time, event_id)) as lon, min(dist) as dist
      from j group by 1)
select f.fire_id, f.idate, round(f.area_m2, 2) as area_m2, round(b.lat, 6) as lat, round(b.lon, 6) as lon
from f join b on f.fire_id = b.fire_id where b.dist <= 86400000000""")
def q_polygon_fire_selection(spark, sf_dir):
    """L4 with polygons (G6, G4, D22, C16, G5, C9): perimeters meeting the region, sized by their own area,
    in a date range, located by the daily record of the years they span that is nearest their ignition."""
    from ashgrid.plans.jobs import select_fires_by_perimeter
    f = fire(spark, sf_dir).select("fire_id", "idate", "fdate").join(fire_rings(spark, sf_dir).select("fire_id", "ring"), "fire_id")
    daily = daily_records(spark, sf_dir)
    coll = daily.withColumn("year", F.year("time"))
    out = select_fires_by_perimeter(f, coll, datetime(2024, 1, 1), datetime(2024, 1, 31), 1e7, tie="event_id")
    return rounded(out.select("fire_id", "idate", F.round("area_m2", 2).alias("area_m2"), "lat", "lon"))


_FOLDS_SQL = f"""f as (select * from (values {', '.join(repr(r) for r in P.year_folds())}) t(fold, year, split))"""


@register("fold_scores", sql=f"""with {_SAMPLES}, {_STATS}, {_FOLDS_SQL},
t as (select year, fire_id, sample_idx, y, x, coalesce(max(case when lag = {T - 1} then af_hh end), 0) as hh,
             coalesce(max(case when lag = {T} then af_mask end), 0) as label
      from sp where lag >= {T - 1} group by 1, 2, 3, 4, 5),
w as (select f.fold, count(*) * 1.0 / count(long.v) as pos_weight from long join f on f.year = long.year
      where band = 22 and split = 'train' group by 1),
s as (select f.fold, t.label as y, (t.hh - 6) / 6.0 as logit, 1 / (1 + exp(-(t.hh - 6) / 6.0)) as score
      from t join f on f.year = t.year and f.split = 'test'),
c as (select fold, count(*) filter (where score > 0.5 and y = 1) as tp, count(*) filter (where score > 0.5 and y = 0) as fp,
        count(*) filter (where score <= 0.5 and y = 1) as fn, count(*) filter (where score <= 0.5 and y = 0) as tn,
        avg(pos_weight * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))
            + (1 - y) * (greatest(logit, 0) + ln(1 + exp(-abs(logit))))) as bce from s join w using (fold) group by 1),
g as (select fold, score, sum(y) as pos, sum(1 - y) as neg from s group by 1, 2),
cc as (select fold, pos, sum(pos) over (partition by fold order by score desc) as ctp, sum(neg) over (partition by fold order by score desc) as cfp from g),
pt as (select fold, sum(y) as p_total from s group by 1),
ap as (select cc.fold, sum(pos / p_total * ctp / (ctp + cfp)) as average_precision from cc join pt on cc.fold = pt.fold group by 1)
select c.fold, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as iou,
  round(ap.average_precision, 6) as average_precision, round(c.bce, 6) as bce
from c left join ap on c.fold = ap.fold""")
def q_fold_scores(spark, sf_dir):
    """I9 (I1-I3, I5, D20): logits of the last input hour scored on the test year of all twelve folds in one
    pass, mapped through a sigmoid, with the weight of the fire band in each fold's own training years."""
    sp = sample_pixels(spark, sf_dir)
    at = lambda lag, c: F.coalesce(F.max(F.when(F.col("lag") == lag, F.col(c))), F.lit(0))
    t = sp.filter(F.col("lag") >= T - 1).groupBy("year", "fire_id", "sample_idx", "y", "x").agg(
        at(T - 1, "af_hh").alias("hh"), at(T, "af_mask").alias("y_true"))
    folds = P.fold_table(spark)
    years = sorted({y for _, y, _ in P.year_folds()})
    fires = raster_long(spark, sf_dir).filter("band = 22")
    weight = agg.positive_weight(agg.band_statistics(fires, years, folds=folds), keys=["fold"])
    test = folds.filter("split = 'test'").select("fold", "year")
    scored = t.join(test, "year").select("fold", F.col("y_true").alias("y"), ((F.col("hh") - 6) / 6.0).alias("logit"))
    m = E.metrics_by_group(scored.withColumn("score", E.sigmoid("logit")), ["fold"])
    weighted = scored.join(F.broadcast(weight), "fold", "left")  # one number per fold
    return rounded(m.join(E.bce(weighted, ["fold"], logit="logit", pos_weight=F.col("pos_weight")), "fold"))


@register("fire_dates", sql="""
select year, fire_id, count(distinct obs_date) as n_images, list_sort(list(distinct obs_date)) as dates from raster group by 1, 2""")
def q_fire_dates(spark, sf_dir):
    """A5: ordered image dates of every fire from the file listing."""
    from ashgrid.plans.pixel_queries import raster_files
    return P.stack_inventory(raster_files(spark, sf_dir), with_dates=True).select("year", "fire_id", "n_images", "dates")


@register("pack_fire_stack_centre", sql="""
select year, fire_id, list_sort(list(distinct obs_date)) as dates, count(*) as n_pixels,
  round((min(30 + y * 0.1) + max(30 + y * 0.1)) / 2, 6) as centre_lat, round((min(-120 + x * 0.1) + max(-120 + x * 0.1)) / 2, 6) as centre_lon
from raster group by 1, 2""")
def q_pack_fire_stack_centre(spark, sf_dir):
    """A9 (G7): summary record of every fire with its centre."""
    r = raster(spark, sf_dir).withColumns({"lat": 30 + F.col("y") * 0.1, "lon": -120 + F.col("x") * 0.1})
    return rounded(P.pack_fire_stack(r, lat="lat", lon="lon"))
