"""The reference's four end-to-end jobs as single Spark plans.

Each job is a function over DataFrames; the registered queries below run them on the
fixture views.  Shuffles per job: L1 one (cell join), L2 the box join plus the metric
aggregates, L3 the sample join plus metric aggregates, L4 one (daily-record join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashgrid.functions import columns as C
from ashgrid.operators import aggregates as agg
from ashgrid.operators import evaluate as E
from ashgrid.operators import geometry as GEO
from ashgrid.operators import joins as J
from ashgrid.operators import pixels as P
from ashgrid.plans.catalog import register, rounded
from ashgrid.session import cut_lineage
from ashgrid.sources.fixtures import CUBE_T, CUBE_X, CUBE_Y, EPOCH_2024, fire, raster, reading_cube, sensor_obs


def attach_grid_to_sensors(raw: DataFrame, cells: DataFrame, lat_axis: J.RegularAxis, lon_axis: J.RegularAxis,
                           value: str = "v", qflag: str = "qflag", keep: Sequence[str] = (),
                           time_axis: J.RegularAxis | None = None, time_origin=None) -> DataFrame:
    """L1: raw sensor rows -> parsed readings with their site id and the bias-corrected grid value at the
    nearest cell and time step, kept only for accepted quality flags.

    ``cells`` is a (t, y, x) cube when ``time_axis`` (hours since ``time_origin``) is given; a grid
    without time has (y, x) only."""
    raw = raw.withColumn("site", C.site_id("State Code", "County Code", "Site Num"))
    obs = C.normalise_sensor(raw, keep=[*keep, "site"])
    s = J.sample_nearest(obs, cells, lat_axis, lon_axis, [value, qflag], time_axis=time_axis, time_origin=time_origin)
    return s.withColumn(value, C.mask_quality(value, qflag)).drop(qflag)


def agreement_in_fire_boxes(obs: DataFrame, fires: DataFrame, truth: str, estimates: Sequence[str],
                            half: float = 1.0, lo: float = 2.0, hi: float = 1000.0) -> DataFrame:
    """L2: readings inside fire boxes during the fires (counted once per box, as in the source) ->
    agreement metrics per estimate, as sums weighted by the number of boxes."""
    inside = J.covering_fires(obs, fires, half).select(truth, *estimates, "lat", "lon", "n_fires")
    # the metric branches (moments, distinct stations, ranks) all read these rows: cut
    # lineage there so the readings are scanned once; every reading is there once
    inside = cut_lineage(inside)
    return agg.agreement(inside, truth, estimates, lo, hi, weight="n_fires")


def persistence_scores(pixels: DataFrame, T: int, skip: int, folds: DataFrame, fold: int | None = 0) -> DataFrame:
    """L3: samples -> cleaned fire band -> persistence prediction vs next-day label ->
    confusion counts, precision / recall / F1 / IoU and average precision per split of a fold, or with ``fold`` None per fold and split of all folds."""
    s = P.samples(pixels, T, skip)
    hh = P.clean_fire_band("b22")
    s = s.withColumns({"af_hh": hh, "af_mask": P.binary_mask(hh)})
    keys = ["year", "fire_id", "sample_idx"]
    # prediction (last input day's mask) and label (next day's mask) side by side in one
    # aggregation over the sample pixels instead of a full outer join of two branches
    table = (s.filter(F.col("lag") >= T - 1)
              .groupBy(*keys, "y", "x")
              .agg(F.coalesce(F.max(F.when(F.col("lag") == T - 1, F.col("af_mask"))), F.lit(0)).alias("pred"),
                   F.coalesce(F.max(F.when(F.col("lag") == T, F.col("af_mask"))), F.lit(0)).alias("label")))
    by = ["split"] if fold is not None else ["fold", "split"]
    f = (folds if fold is None else folds.filter(F.col("fold") == fold)).select("year", *by)
    # a few (year, split) rows per fold are broadcast
    t = table.join(F.broadcast(f), "year").withColumnRenamed("label", "y_true").withColumn("score", F.col("pred").cast("double"))
    m = E.binary_metrics(E.confusion(t, by, "y_true", "score", 0.5))
    ap = E.average_precision(t, by, "y_true", "score")
    return m.join(ap, by, "left")


def select_fires(fires: DataFrame, daily: DataFrame, start, end, min_size: float,
                 window_days: float = 7.0) -> DataFrame:
    """L4: weekly windows -> area and date range -> inside the region -> ignition coordinates
    from the nearest daily record (within 24 h) -> fires without coordinates dropped."""
    f = J.in_calendar_windows(fires, start, end, window_days)
    f = agg.fires_in_range(f, min_size, start, end)
    f = GEO.points_in_region(f)
    f = f.select("fire_id", "idate", "area")
    located = J.nearest_in_time(f, daily, tie="event_id")
    return C.require(located, ["lat", "lon"])


def select_fires_by_perimeter(fires: DataFrame, collections: DataFrame, start, end, min_size: float,
                              tie: str | None = None) -> DataFrame:
    """L4 from perimeters: ``fires`` (fire_id, idate, fdate, ring) whose polygon meets the region and whose
    own area lies in the size range, ignited in [start, end), with the coordinates of the daily
    record (of any yearly collection the fire spans) nearest the ignition within 24 h; fires
    without coordinates are dropped.  Records with a ``ring`` are located by its centroid."""
    f = GEO.polygons_in_region(fires).withColumn("area_m2", GEO.polygon_area("ring"))
    f = agg.fires_in_range(f, min_size, start, end, area="area_m2")
    daily = J.daily_perimeters_for(f, collections)
    if "ring" in daily.columns:
        lon, lat = GEO.polygon_centroid("ring")
        daily = daily.withColumns({"lon": lon, "lat": lat})
    located = J.nearest_in_time(f.select("fire_id", "idate", "area_m2"), daily, tie=tie)
    return C.require(located, ["lat", "lon"])


# ------------------------------------------------------------------ registered job queries

_L1_SQL = """with raw as (select event_id,
  case when event_id % 17 = 0 then 'bad-date' else strftime(ts, '%Y-%m-%d') end as d,
  lpad(cast(hour(ts) as varchar), 2, '0') || ':00' as t, cast(user_id % 56 as varchar) as st,
  cast(event_id % 1000 as varchar) as co, cast(event_id as varchar) as si,
  30 + (user_id % 20) * 0.5 as lat, -120 + (user_id % 37) * 0.75 as lon, value from events),
p as (select event_id, case when length(st) < 2 then lpad(st, 2, '0') else st end
               || case when length(co) < 3 then lpad(co, 3, '0') else co end
               || case when length(si) < 4 then lpad(si, 4, '0') else si end as site,
             try_strptime(d || ' ' || t, '%Y-%m-%d %H:%M') as time, cast(lat as double) as lat,
             cast(lon as double) as lon, value as pm25 from raw),
cube as (select floor(((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9) / 3) as t, user_id % 20 as y, user_id % 37 as x,
                avg(value) as v, min(event_id % 5) as qflag from events group by 1, 2, 3),
h as (select *, (epoch_us(time) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as hours from p),
i as (select *, case when hours between 0 and 717 then cast(ceil(hours / 3 - 0.5) as bigint) end as it,
        case when lat between 30 and 39.5 then cast(ceil((lat - 30) / 0.5 - 0.5) as bigint) end as iy,
        case when lon between -120 and -120 + 36 * 0.75 then cast(ceil((lon + 120) / 0.75 - 0.5) as bigint) end as ix from h)
select i.event_id, i.site, i.time, i.lat, i.lon, i.pm25, case when g.qflag in (3, 4) then round(g.v, 6) end as v
from i left join cube g on g.t = i.it and g.y = i.iy and g.x = i.ix where i.time is not null"""


@register("sensor_grid_attach", sql=_L1_SQL)
def q_sensor_grid_attach(spark, sf_dir):
    """L1 (C5 with time, B1, B2, B9): raw readings parsed, the 3-hourly cube sampled at each reading's
    position and time, quality-masked."""
    from ashgrid.plans.column_queries import raw_sensor_rows
    return rounded(attach_grid_to_sensors(raw_sensor_rows(spark, sf_dir), reading_cube(spark, sf_dir), CUBE_Y, CUBE_X,
                                          keep=["event_id"], time_axis=CUBE_T, time_origin=EPOCH_2024))


def _l2_sql():
    from ashgrid.plans.sensor_queries import _LONG, _METRICS_OUT
    body = _LONG.format(lo=2, hi=1000, key="source").replace(
        "from sensor_obs\n  union all", "from boxed\n  union all").replace(
        "est_b as est, lat, lon, time from sensor_obs)", "est_b as est, lat, lon, time from boxed)")
    boxed = """boxed as (select o.* from sensor_obs o join fire f
  on o.lon > f.lon - 1 and o.lon < f.lon + 1 and o.lat > f.lat - 1 and o.lat < f.lat + 1
 and o.time >= f.idate and o.time <= f.fdate),"""
    body = body.replace("with long as (", "with " + boxed + "\nlong as (", 1)
    return body + f"""
select s.source, {_METRICS_OUT}
from (values ('est_a'), ('est_b')) s(source) left join m on s.source = m.source"""


@register("fire_box_agreement", sql=_l2_sql())
def q_fire_box_agreement(spark, sf_dir):
    """L2 (flagship): agreement of both estimates with sensors inside +/-1 degree fire boxes."""
    return rounded(agreement_in_fire_boxes(sensor_obs(spark, sf_dir), fire(spark, sf_dir), "pm25", ["est_a", "est_b"]))


_L3_SQL = """with img as (select year, fire_id, obs_date,
    row_number() over (partition by year, fire_id order by obs_date) - 1 as img_idx,
    count(*) over (partition by year, fire_id) as n
  from (select distinct year, fire_id, obs_date from raster)),
smp as (select i.year, i.fire_id, i.obs_date, i.img_idx - 1 - l.lag as sample_idx, l.lag
  from img i, range(0, 3) as l(lag)
  where i.img_idx - 1 - l.lag >= 0 and i.img_idx - 1 - l.lag < i.n - 1 - 2),
sp as (select r.year, r.fire_id, s.sample_idx, s.lag, r.y, r.x, cast(floor(coalesce(r.b22, 0) / 100) > 0 as int) as m
  from raster r join smp s on r.year = s.year and r.fire_id = s.fire_id and r.obs_date = s.obs_date),
pr as (select year, fire_id, sample_idx, y, x, m as pred from sp where lag = 1),
lb as (select year, fire_id, sample_idx, y, x, m as label from sp where lag = 2),
t as (select coalesce(pr.year, lb.year) as year, coalesce(pred, 0) as pred, coalesce(label, 0) as y
      from pr full join lb on pr.year = lb.year and pr.fire_id = lb.fire_id and pr.sample_idx = lb.sample_idx
       and pr.y = lb.y and pr.x = lb.x),
f as (select * from (values __FOLDS__) v(fold, year, split)),
tf as (select f.fold, f.split, cast(t.pred as double) as score, t.y from t join f on t.year = f.year),
c as (select fold, split, count(*) filter (where score > 0.5 and y = 1) as tp, count(*) filter (where score > 0.5 and y = 0) as fp,
        count(*) filter (where score <= 0.5 and y = 1) as fn, count(*) filter (where score <= 0.5 and y = 0) as tn
      from tf group by fold, split),
g as (select fold, split, score, sum(y) as pos, sum(1 - y) as neg from tf group by 1, 2, 3),
cc as (select fold, split, pos, sum(pos) over (partition by fold, split order by score desc) as ctp,
        sum(neg) over (partition by fold, split order by score desc) as cfp from g),
pt as (select fold, split, sum(y) as p_total from tf group by 1, 2),
ap as (select cc.fold, cc.split, sum(pos / p_total * ctp / (ctp + cfp)) as average_precision
       from cc join pt on cc.fold = pt.fold and cc.split = pt.split group by 1, 2)
select c.fold, c.split, tp, fp, fn, tn,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, round(coalesce(tp / nullif(tp + fp + fn, 0), 0), 6) as iou,
  round(ap.average_precision, 6) as average_precision
from c left join ap on c.fold = ap.fold and c.split = ap.split"""


@register("persistence_scores", sql=_L3_SQL.replace("__FOLDS__", ", ".join(repr(r) for r in P.year_folds())))
def q_persistence_scores(spark, sf_dir):
    """L3: persistence baseline scored against next-day fire masks per split of all twelve folds."""
    return rounded(persistence_scores(raster(spark, sf_dir), 2, 1, P.fold_table(spark), None))


_L4_SQL = """with daily as (select user_id * 10 as fire_id, event_id, ts as time, cast(30 + (event_id % 100) * 0.01 as double) as lat,
  cast(-120 + (event_id % 50) * 0.02 as double) as lon from events),
a as (select generate_series as anchor from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)
      where dayofweek(generate_series) = 0),
w as (select * from fire f where exists (select 1 from a where f.idate >= anchor and f.idate < anchor + interval 7 day)
      and area >= 10000000 and area < 1e20 and idate >= timestamp '2024-01-01' and idate < timestamp '2024-01-31'),
__EDGES__,
r as (select w.fire_id, w.idate from w, edges e
      where (e.y0 > w.lat) != (e.y1 > w.lat) and w.lon < (e.x1 - e.x0) * (w.lat - e.y0) / (e.y1 - e.y0) + e.x0
      group by 1, 2 having count(*) % 2 = 1),
j as (select r.fire_id, d.lat, d.lon, abs(epoch_us(d.time) - epoch_us(r.idate)) as dist, d.time, d.event_id
      from r join daily d on r.fire_id = d.fire_id),
b as (select fire_id, arg_min(lat, (dist, time, event_id)) as lat, arg_min(lon, (dist, time, event_id)) as lon,
             min(dist) as dist from j group by 1)
select r.fire_id, r.idate, round(b.lat, 6) as lat, round(b.lon, 6) as lon
from r join b on r.fire_id = b.fire_id where b.dist <= 86400000000"""


def _l4_sql():
    from ashgrid.plans.io_queries import _usa_edges_sql
    return _L4_SQL.replace("__EDGES__", _usa_edges_sql())


@register("fire_selection", sql=_l4_sql())
def q_fire_selection(spark, sf_dir):
    """L4: weekly windows, size and date range, region, ignition coordinates from the nearest
    daily record, fires without coordinates dropped."""
    from datetime import datetime
    from ashgrid.plans.join_queries import daily_records
    out = select_fires(fire(spark, sf_dir), daily_records(spark, sf_dir), datetime(2024, 1, 1), datetime(2024, 1, 31), 1e7)
    return rounded(out.select("fire_id", "idate", "lat", "lon"))
