"""Registered queries for the joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ashgrid.functions.columns import hour_floor
from ashgrid.operators import joins as J
from ashgrid.operators import aggregates as agg
from ashgrid.plans.catalog import register, rounded
from ashgrid.plans.column_queries import CONUS12, LCC_SQL
from ashgrid.sources.fixtures import fire, grid_cell, pixel_obs, sensor_obs, table


def estimates(spark, sf_dir):
    """A gridded-estimate table keyed like the readings (lat, lon, hour), with duplicate keys."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return e.select(F.col("event_id").alias("id"),
                    (F.lit(30.0) + (uid % 20) * 0.5).alias("lat"), (F.lit(-120.0) + (uid % 37) * 0.75).alias("lon"),
                    hour_floor("ts").alias("time"), (F.col("value") * 0.9).alias("pm25"))


_EST = """est as (select event_id as id, cast(30 + (user_id % 20) * 0.5 as double) as lat,
  cast(-120 + (user_id % 37) * 0.75 as double) as lon, date_trunc('hour', ts) as time, value * 0.9 as pm25
  from events)"""


@register("attach_exact", sql=f"""with {_EST}
select o.event_id, round(e.pm25, 6) as cams from sensor_obs o left join est e
  on o.lat = e.lat and o.lon = e.lon and o.time = e.time""")
def q_attach_exact(spark, sf_dir):
    """Left equi-join on (lat, lon, time); duplicate estimate keys multiply rows."""
    o = sensor_obs(spark, sf_dir).select("event_id", "lat", "lon", "time")
    e = estimates(spark, sf_dir).select("lat", "lon", "time", F.col("pm25").alias("cams"))
    return rounded(J.attach_exact(o, e).select("event_id", "cams"))


@register("match_inner", sql=f"""with {_EST}
select o.event_id as id_sensor, e.id as id_sat, o.lat, o.lon, o.time, o.pm25 as pm25_sensor,
       round(e.pm25, 6) as pm25_sat
from sensor_obs o join est e on o.lat = e.lat and o.lon = e.lon and o.time = e.time""")
def q_match_inner(spark, sf_dir):
    """Inner equi-join with _sensor / _sat suffixes."""
    o = sensor_obs(spark, sf_dir).select(F.col("event_id").alias("id"), "lat", "lon", "time", "pm25")
    return rounded(J.match_inner(o, estimates(spark, sf_dir)))


@register("obs_near_fire", sql="""
select o.event_id, f.fire_id from sensor_obs o join fire f
  on abs(o.lat - f.lat) < 0.5 and abs(o.lon - f.lon) < 0.5 and o.time >= f.idate and o.time <= f.fdate""")
def q_obs_near_fire(spark, sf_dir):
    """Readings within +/-0.5 degree (strict) of a fire during its period (closed)."""
    o = sensor_obs(spark, sf_dir).select("event_id", "lat", "lon", "time")
    return J.obs_near_fire(o, fire(spark, sf_dir)).select("event_id", "fire_id")


@register("obs_within_fire_box", sql="""
select o.* from sensor_obs o join fire f
  on o.lon > f.lon - 1 and o.lon < f.lon + 1 and o.lat > f.lat - 1 and o.lat < f.lat + 1
 and o.time >= f.idate and o.time <= f.fdate
where o.time >= (select min(idate) from fire) and o.time <= (select max(fdate) from fire)""")
def q_obs_within_fire_box(spark, sf_dir):
    """C4: readings within a fire's +/-1 degree box (boundary excluded) during its period;
    duplicates kept where boxes overlap; reading columns only."""
    return J.obs_within_fire_box(sensor_obs(spark, sf_dir), fire(spark, sf_dir))


def _grid_axes(spark, sf_dir):
    ny = grid_cell(spark, sf_dir).agg(F.max("y")).first()[0] + 1
    return J.RegularAxis(30.0, 0.25, ny), J.RegularAxis(-120.0, 0.75, 40)


@register("sample_nearest", sql="""
with pts as (select distinct station_id, lat + 0.125 * (station_id % 3) as plat, lon + 0.375 * (station_id % 2) as plon
             from sensor_obs),
ax as (select max(y) as ymax from grid_cell),
idx as (select station_id, plat, plon,
  case when plat between 30 and 30 + ymax * 0.25 then cast(ceil((plat - 30) / 0.25 - 0.5) as bigint) end as iy,
  case when plon between -120 and -120 + 39 * 0.75 then cast(ceil((plon + 120) / 0.75 - 0.5) as bigint) end as ix
  from pts, ax)
select i.station_id, i.plat as lat, i.plon as lon, g.v, g.qflag
from idx i left join grid_cell g on g.y = i.iy and g.x = i.ix""")
def q_sample_nearest(spark, sf_dir):
    """Nearest grid cell at each station (ties at half steps go to the lower index)."""
    o = sensor_obs(spark, sf_dir)
    pts = o.select("station_id", (F.col("lat") + 0.125 * (F.col("station_id") % 3)).alias("lat"),
                   (F.col("lon") + 0.375 * (F.col("station_id") % 2)).alias("lon")).distinct()
    ay, ax = _grid_axes(spark, sf_dir)
    return J.sample_nearest(pts, grid_cell(spark, sf_dir), ay, ax, ["v", "qflag"])


@register("sample_linear", sql="""
with pts as (select distinct station_id, lat + 0.1 * (station_id % 3) as plat, lon + 0.3 * (station_id % 4) as plon
             from sensor_obs),
ax as (select max(y) as ymax from grid_cell),
b as (select station_id, plat, plon, (plat - 30) / 0.25 as py, (plon + 120) / 0.75 as px,
        plat between 30 and 30 + ymax * 0.25 and plon between -120 and -120 + 39 * 0.75 as inside from pts, ax),
c as (select *, floor(py) as y0, floor(px) as x0, py - floor(py) as fy, px - floor(px) as fx from b),
k as (select c.station_id, dy, dx, (case when dy = 1 then fy else 1 - fy end) * (case when dx = 1 then fx else 1 - fx end) as w,
        cast(y0 + dy as bigint) as cy, cast(x0 + dx as bigint) as cx
      from c, (values (0), (1)) a(dy), (values (0), (1)) b2(dx) where inside),
s as (select k.station_id, case when count(*) filter (where g.v is null) = 0 then sum(k.w * g.v) end as v
      from k left join grid_cell g on g.y = k.cy and g.x = k.cx where k.w > 0 group by k.station_id)
select p.station_id, p.plat as lat, p.plon as lon, round(s.v, 6) as v
from pts p left join s on p.station_id = s.station_id""")
def q_sample_linear(spark, sf_dir):
    """Bilinear interpolation of the grid at each station."""
    o = sensor_obs(spark, sf_dir)
    pts = o.select("station_id", (F.col("lat") + 0.1 * (F.col("station_id") % 3)).alias("lat"),
                   (F.col("lon") + 0.3 * (F.col("station_id") % 4)).alias("lon")).distinct()
    ay, ax = _grid_axes(spark, sf_dir)
    return rounded(J.sample_linear(pts, grid_cell(spark, sf_dir), ay, ax, "v"))


def projected_cells(spark, sf_dir):
    """Projected-grid cells (time, lay, row, col, pm25_tot) at the stations' Lambert cells."""
    from ashgrid.functions.geo import lambert_xy
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    lat, lon = F.lit(30.0) + (uid % 20) * 0.5, F.lit(-120.0) + (uid % 37) * 0.75
    x, y = lambert_xy(lon, lat, CONUS12)
    return (e.select(hour_floor("ts").alias("time"), (F.col("event_id") % 2).alias("lay"),
                     ((y - CONUS12.yorig) / CONUS12.ycell).cast("long").alias("row"),
                     ((x - CONUS12.xorig) / CONUS12.xcell).cast("long").alias("col"),
                     (F.col("value") * 0.5).alias("pm25_tot"))
             .groupBy("time", "lay", "row", "col").agg(F.avg("pm25_tot").alias("pm25_tot")))


@register("sample_projected", sql=f"""with {LCC_SQL},
xy as (select o.event_id, o.time, 6370000.0 * f / pow(tan(pi() / 4 + radians(o.lat) / 2), n) * sin(n * radians(o.lon + 97.0)) as x,
              rho0 - 6370000.0 * f / pow(tan(pi() / 4 + radians(o.lat) / 2), n) * cos(n * radians(o.lon + 97.0)) as y
       from sensor_obs o, lcc),
rc as (select event_id, time, cast(trunc((x + 2556000.0) / 12000.0) as bigint) as col,
              cast(trunc((y + 1728000.0) / 12000.0) as bigint) as row from xy),
ok as (select event_id, time, case when col >= 0 and col < 459 and row >= 0 and row < 299 then row end as row,
              case when col >= 0 and col < 459 and row >= 0 and row < 299 then col end as col from rc),
cells as (select date_trunc('hour', ts) as time, event_id % 2 as lay, cast(trunc((xy2.y + 1728000.0) / 12000.0) as bigint) as row,
                 cast(trunc((xy2.x + 2556000.0) / 12000.0) as bigint) as col, avg(value * 0.5) as pm25_tot
          from (select e.*, 6370000.0 * f / pow(tan(pi() / 4 + radians(30 + (user_id % 20) * 0.5) / 2), n)
                  * sin(n * radians(-120 + (user_id % 37) * 0.75 + 97.0)) as x,
                  rho0 - 6370000.0 * f / pow(tan(pi() / 4 + radians(30 + (user_id % 20) * 0.5) / 2), n)
                  * cos(n * radians(-120 + (user_id % 37) * 0.75 + 97.0)) as y from events e, lcc) xy2
          group by 1, 2, 3, 4)
select ok.event_id, round(c.pm25_tot, 6) as pm25_tot
from ok left join cells c on c.lay = 0 and c.row = ok.row and c.col = ok.col and c.time = ok.time""")
def q_sample_projected(spark, sf_dir):
    """C7 (+B23): Lambert cell by truncation, bounds check, exact hour, layer 0."""
    o = sensor_obs(spark, sf_dir).select("event_id", "lat", "lon", "time")
    return rounded(J.sample_projected(o, projected_cells(spark, sf_dir), CONUS12).select("event_id", "pm25_tot"))


@register("sample_stations", sql="""
with st as (select distinct lat, lon from sensor_obs),
ax as (select max(y) as ymax from grid_cell),
idx as (select lat, lon,
  case when lat between 30 and 30 + ymax * 0.25 then cast(ceil((lat - 30) / 0.25 - 0.5) as bigint) end as iy,
  case when lon between -120 and -120 + 39 * 0.75 then cast(ceil((lon + 120) / 0.75 - 0.5) as bigint) end as ix from st, ax)
select g.qflag as image_id, i.lat, i.lon, g.v from grid_cell g join idx i on g.y = i.iy and g.x = i.ix""")
def q_sample_stations(spark, sf_dir):
    """Every image (grid cells grouped by quality flag as image id) sampled at every station."""
    g = grid_cell(spark, sf_dir).withColumnRenamed("qflag", "image_id")
    ay, ax = _grid_axes(spark, sf_dir)
    return J.sample_stations(g, sensor_obs(spark, sf_dir), ay, ax, "v")


def daily_records(spark, sf_dir):
    """Daily perimeter records: fire id, record time and centroid, from events."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select((F.col("user_id") * 10).alias("fire_id"), eid, F.col("ts").alias("time"),
                    (F.lit(30.0) + (eid % 100) * 0.01).alias("lat"), (F.lit(-120.0) + (eid % 50) * 0.02).alias("lon"))


_DAILY = """daily as (select user_id * 10 as fire_id, event_id, ts as time, cast(30 + (event_id % 100) * 0.01 as double) as lat,
  cast(-120 + (event_id % 50) * 0.02 as double) as lon from events)"""


@register("nearest_in_time", sql=f"""with {_DAILY},
j as (select f.fire_id, d.lat, d.lon, abs(epoch_us(d.time) - epoch_us(f.idate)) as dist, d.time, d.event_id
      from fire f join daily d on f.fire_id = d.fire_id),
b as (select fire_id, arg_min(lat, (dist, time, event_id)) as lat, arg_min(lon, (dist, time, event_id)) as lon, min(dist) as dist
      from j group by 1)
select f.fire_id, f.idate, case when b.dist <= 86400000000 then round(b.lat, 6) end as lat,
       case when b.dist <= 86400000000 then round(b.lon, 6) end as lon
from fire f left join b on f.fire_id = b.fire_id""")
def q_nearest_in_time(spark, sf_dir):
    """Per fire the record nearest its ignition (same id), null beyond 24 h."""
    f = fire(spark, sf_dir).select("fire_id", "idate")
    return rounded(J.nearest_in_time(f, daily_records(spark, sf_dir), tie="event_id"))


def daily_grid(spark, sf_dir):
    """A coarse daily weather grid (4 x 4 pixel cells) with two days absent."""
    e = table(spark, sf_dir, "events").filter(~F.dayofmonth("ts").isin(3, 17))
    eid = F.col("event_id")
    return (e.groupBy(F.col("ts").cast("date").alias("date"), F.floor((eid % 256) / 64).alias("gy"),
                      F.floor((eid % 16) / 4).alias("gx"))
             .agg(F.avg("value").alias("temp"), F.max("value").alias("wind")))


_DGRID = """dgrid as (select cast(ts as date) as date, floor((event_id % 256) / 64) as gy, floor((event_id % 16) / 4) as gx,
  avg(value) as temp, max(value) as wind from events
  where dayofmonth(ts) not in (3, 17) group by 1, 2, 3)"""


@register("append_grid_bands", sql=f"""with {_DGRID}
select p.fire_id, p.obs_date, p.y, p.x, p.v, p.af_hhmm, round(g.temp, 6) as temp, round(g.wind, 6) as wind
from pixel_obs p left join dgrid g on g.date = p.obs_date and g.gy = floor(p.y / 4) and g.gx = floor(p.x / 4)
where p.obs_date in (select date from dgrid)""")
def q_append_grid_bands(spark, sf_dir):
    """C10 (+H2): daily grid fields appended to each pixel; dates without a grid skipped."""
    return rounded(J.append_grid_bands(pixel_obs(spark, sf_dir), daily_grid(spark, sf_dir), ["temp", "wind"]))


@register("match_by_substring", sql="""
with k as (select distinct cast(fire_id as varchar) as fire_key from fire),
d as (select distinct regexp_extract(url, '/([a-z]{2}/[0-9]+)', 1) as dir_name from pages)
select k.fire_key, min(d.dir_name) as dir_name from k left join d on contains(d.dir_name, k.fire_key) group by 1""")
def q_match_by_substring(spark, sf_dir):
    """C11: first directory (by name) whose name contains the fire id."""
    k = fire(spark, sf_dir).select(F.col("fire_id").cast("string").alias("fire_key")).distinct()
    d = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"/([a-z]{2}/[0-9]+)", 1).alias("dir_name"))
    return J.match_by_substring(k, d)


@register("in_calendar_windows", sql="""
with a as (select generate_series as anchor from generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)
           where dayofweek(generate_series) = 0)
select fire_id, idate from fire where exists (select 1 from a where idate >= anchor and idate < anchor + interval 2 day)""")
def q_in_calendar_windows(spark, sf_dir):
    """Fires igniting within 2 days after a weekly (Sunday) anchor in January 2024."""
    f = fire(spark, sf_dir).select("fire_id", "idate")
    return J.in_calendar_windows(f, "2024-01-01", "2024-01-31", 2.0)


def file_listing(spark, sf_dir, primary="https://primary.example/hrrr", fallback="https://fallback.example/hrrr"):
    """Files present on the two hosts, one per event (events of type signup sit on the fallback)."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") != "error")
    base = F.when(F.col("event_type") == "signup", F.lit(fallback)).otherwise(F.lit(primary))
    kind = F.when(F.col("event_id") % 3 == 0, F.lit("wrfnatf00")).otherwise(F.lit("wrfprsf00"))
    return e.select(F.concat(base, F.lit("/hrrr."), F.date_format("ts", "yyyyMMdd"), F.lit("/conus/hrrr.t"),
                             F.date_format("ts", "HH"), F.lit("z."), kind, F.lit(".grib2")).alias("url"))


@register("missing_cycles", sql="""
with listing as (select (case when event_type = 'signup' then 'https://fallback.example/hrrr' else 'https://primary.example/hrrr' end)
    || '/hrrr.' || strftime(ts, '%Y%m%d') || '/conus/hrrr.t' || strftime(ts, '%H') || 'z.'
    || (case when event_id % 3 = 0 then 'wrfnatf00' else 'wrfprsf00' end) || '.grib2' as url
  from events where event_type != 'error'),
cyc as (select generate_series as cycle from generate_series(timestamp '2024-01-01 00:00:00', timestamp '2024-01-30 23:00:00', interval 1 hour)),
u as (select cycle, kind,
    'https://primary.example/hrrr/hrrr.' || strftime(cycle, '%Y%m%d') || '/conus/hrrr.t' || strftime(cycle, '%H') || 'z.' || kind || '.grib2' as primary_url,
    'https://fallback.example/hrrr/hrrr.' || strftime(cycle, '%Y%m%d') || '/conus/hrrr.t' || strftime(cycle, '%H') || 'z.' || kind || '.grib2' as fallback_url
  from cyc, (values ('wrfprsf00'), ('wrfnatf00')) k(kind)),
m as (select * from u where primary_url not in (select url from listing) and fallback_url not in (select url from listing))
select cycle, kind, primary_url, fallback_url, (select count(*) from cyc) as n_cycles, (select count(*) from m) as n_missing
from m order by cycle, kind limit 10""")
def q_missing_cycles(spark, sf_dir):
    """Hourly cycles with pressure and native files; primary, else fallback host,
    else missing; first 10 missing pairs with the counts."""
    return J.missing_cycles(file_listing(spark, sf_dir), datetime(2024, 1, 1), datetime(2024, 1, 30, 23),
                            native=True)


@register("subset_by_index", sql="""
select doc_id as sample_id, n_chars from documents where doc_id in (select doc_id from labels)""")
def q_subset_by_index(spark, sf_dir):
    """C14: keep listed samples."""
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "n_chars")
    idx = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"))
    return J.subset_by_index(s, idx)


@register("coverage_by_year", sql="""
with m as (select o.event_id, f.fire_id, o.time from sensor_obs o join fire f
  on abs(o.lat - f.lat) < 0.5 and abs(o.lon - f.lon) < 0.5 and o.time >= f.idate and o.time <= f.fdate),
a as (select cast(year(time) as int) as year, count(distinct fire_id) as fires_with_data from m group by 1),
b as (select cast(year(idate) as int) as year, count(*) as total_fires from fire group by 1)
select coalesce(a.year, b.year) as year, coalesce(a.fires_with_data, 0) as fires_with_data,
       coalesce(b.total_fires, 0) as total_fires,
       round(coalesce(a.fires_with_data, 0) * 100.0 / nullif(coalesce(b.total_fires, 0), 0), 2) as percent_with_data
from a full outer join b on a.year = b.year""")
def q_coverage_by_year(spark, sf_dir):
    """C15 (+D10): fires with matched readings per year against all fires per year.  A fire has data at a place and
    time or not: readings of one place and time are matched once."""
    o = sensor_obs(spark, sf_dir).select("lat", "lon", "time").distinct()
    f = fire(spark, sf_dir)
    m = J.obs_near_fire(o, f)
    a = agg.fires_per_year(m, "fire_id", "time").withColumnRenamed("fires", "fires_with_data")
    b = f.groupBy(F.year("idate").alias("year")).agg(F.count(F.lit(1)).alias("total_fires"))
    return J.coverage_by_year(a, b)


@register("daily_perimeters_for", sql=f"""with {_DAILY},
coll as (select fire_id, event_id, time, cast(year(time) as int) as year from daily
         union all select fire_id, event_id, time + interval 1 year, cast(year(time) + 1 as int) from daily where event_id % 3 = 0)
select c.fire_id, c.event_id, c.year from coll c join fire f on c.fire_id = f.fire_id
where c.year between year(f.idate) and year(f.fdate)""")
def q_daily_perimeters_for(spark, sf_dir):
    """C16 (+F4): records of every yearly collection a fire spans, matched by id."""
    d = daily_records(spark, sf_dir)
    y0 = d.select("fire_id", "event_id", "time", F.year("time").alias("year"))
    y1 = d.filter(F.col("event_id") % 3 == 0).select(
        "fire_id", "event_id", (F.col("time") + F.expr("interval 1 year")).alias("time"),
        (F.year("time") + 1).alias("year"))
    coll = y0.unionByName(y1)
    return J.daily_perimeters_for(fire(spark, sf_dir), coll).select("fire_id", "event_id", "year")


@register("padded_extent", sql="""
select station_id % 10 as grp, min(lat) - 0.1 as lat_min, max(lat) + 0.1 as lat_max,
       min(lon) - 0.1 as lon_min, max(lon) + 0.1 as lon_max,
       date_trunc('day', min(time)) as t0, date_trunc('day', max(time) + interval 1 day) as t1
from sensor_obs group by 1""")
def q_padded_extent(spark, sf_dir):
    """Padded spatial extent and day-floored period of each group."""
    from ashgrid.operators.geometry import padded_extent
    o = sensor_obs(spark, sf_dir).withColumn("grp", F.col("station_id") % 10)
    return padded_extent(o, "grp")


@register("collect_areas", sql="""
select area, (select count(*) from fire where area >= 20000000 and idate >= timestamp '2024-01-05'
  and idate < timestamp '2024-01-20') as n_fires
from fire where area >= 20000000 and idate >= timestamp '2024-01-05' and idate < timestamp '2024-01-20'""")
def q_collect_areas(spark, sf_dir):
    """Areas of large fires igniting in a date range, with their number."""
    return agg.collect_areas(fire(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 20), 2e7)


@register("fires_in_range", sql="""
select fire_id from fire where area >= 10000000 and area < 1e20 and idate >= timestamp '2024-01-03'
  and idate < timestamp '2024-01-25'""")
def q_fires_in_range(spark, sf_dir):
    """Area in [1e7, 1e20) and ignition in [start, end)."""
    return agg.fires_in_range(fire(spark, sf_dir), 1e7, datetime(2024, 1, 3), datetime(2024, 1, 25)).select("fire_id")


@register("fires_per_year", sql="""
select cast(year(idate) as int) as year, count(distinct fire_id) as fires from fire group by 1""")
def q_fires_per_year(spark, sf_dir):
    """Distinct fires per year."""
    return agg.fires_per_year(fire(spark, sf_dir), "fire_id", "idate")


# ------------------------------------------------------------ time-varying grid (reanalysis cube)

CUBE_ORIGIN = datetime(2024, 1, 1)
CUBE_T = J.RegularAxis(0.0, 2.0, 360)          # 2-hourly steps over 30 days
CUBE_Y = J.RegularAxis(30.0, 0.5, 20)
CUBE_X = J.RegularAxis(-120.0, 0.75, 37)


def species_cube(spark, sf_dir, step_hours: int = 2):
    """An aerosol cube (t, y, x) with five species in kg/m3 at ``step_hours`` steps, from events."""
    from ashgrid.operators.joins import hours_since
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return (e.groupBy(F.floor(hours_since("ts", CUBE_ORIGIN) / step_hours).alias("t"), (uid % 20).alias("y"), (uid % 37).alias("x"))
             .agg((F.avg("value") * 1e-9).alias("dust"), (F.max("value") * 5e-10).alias("oc"),
                  (F.min("value") * 2e-10).alias("bc"), (F.count(F.lit(1)) * 1e-10).alias("seasalt"),
                  (F.avg(F.col("event_id") % 7) * 1e-10).alias("so4")))


_CUBE = """cube as (select floor(((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9) / {step}) as t, user_id % 20 as y,
  user_id % 37 as x, avg(value) * 1e-9 as dust, max(value) * 5e-10 as oc, min(value) * 2e-10 as bc,
  count(*) * 1e-10 as seasalt, avg(event_id % 7) * 1e-10 as so4 from events group by 1, 2, 3)"""


@register("merra2_nearest", sql=f"""with {_CUBE.format(step=2)},
o as (select event_id, lat, lon, time, (epoch_us(time) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as h from sensor_obs),
i as (select event_id, case when h between 0 and 718 then cast(ceil(h / 2 - 0.5) as bigint) end as it,
        case when lat between 30 and 39.5 then cast(ceil((lat - 30) / 0.5 - 0.5) as bigint) end as iy,
        case when lon between -120 and -120 + 36 * 0.75 then cast(ceil((lon + 120) / 0.75 - 0.5) as bigint) end as ix from o)
select i.event_id, round((c.dust + c.oc + c.bc + c.seasalt + c.so4 * (132.14 / 96.06)) * 1e9, 6) as merra2
from i left join cube c on c.t = i.it and c.y = i.iy and c.x = i.ix""")
def q_merra2_nearest(spark, sf_dir):
    """C5 with time (+B11): nearest 2-hourly cube cell for five species, combined to PM2.5."""
    from ashgrid.functions.columns import pm25_from_species
    o = sensor_obs(spark, sf_dir).select("event_id", "lat", "lon", "time")
    s = J.sample_nearest(o, species_cube(spark, sf_dir), CUBE_Y, CUBE_X, ["dust", "oc", "bc", "seasalt", "so4"],
                         time_axis=CUBE_T, time_origin=CUBE_ORIGIN)
    return rounded(s.select("event_id", pm25_from_species("dust", "oc", "bc", "seasalt", "so4").alias("merra2")))


@register("trilinear_interp", sql=f"""with {_CUBE.format(step=24)},
o as (select event_id, 30 + (user_id % 20) * 0.5 + case when user_id % 4 = 0 then 0.1 * (user_id % 3) else 0 end as plat,
             -120 + (user_id % 37) * 0.75 + case when user_id % 4 = 0 then 0.2 * (user_id % 3) else 0 end as plon,
             (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 3.6e9 as h from events),
b as (select event_id, (plat - 30) / 0.5 as py, (plon + 120) / 0.75 as px, h / 24 as pt,
        plat between 30 and 39.5 and plon between -120 and -120 + 36 * 0.75 and h between 0 and 696 as inside from o),
c as (select *, floor(py) as y0, floor(px) as x0, floor(pt) as t0, py - floor(py) as fy, px - floor(px) as fx,
        pt - floor(pt) as ft from b),
k as (select c.event_id, cast(y0 + dy as bigint) as cy, cast(x0 + dx as bigint) as cx, cast(t0 + dt as bigint) as ct,
        (case when dy = 1 then fy else 1 - fy end) * (case when dx = 1 then fx else 1 - fx end)
        * (case when dt = 1 then ft else 1 - ft end) as w
      from c, (values (0), (1)) a(dy), (values (0), (1)) b2(dx), (values (0), (1)) b3(dt) where inside),
s as (select k.event_id, case when count(*) filter (where g.dust is null) = 0 then sum(k.w * g.dust) end as dust
      from k left join cube g on g.y = k.cy and g.x = k.cx and g.t = k.ct where k.w > 0 group by 1)
select e.event_id, round(s.dust * 1e9, 6) as dust_ug from events e left join s on e.event_id = s.event_id""")
def q_trilinear_interp(spark, sf_dir):
    """C6 with time: linear interpolation of a daily cube in time, lat and lon (up to eight
    corners; points off the station cells need spatial neighbours)."""
    e = table(spark, sf_dir, "events")
    uid = F.col("user_id")
    off = F.when(uid % 4 == 0, uid % 3).otherwise(F.lit(0))
    pts = e.select("event_id", (F.lit(30.0) + (uid % 20) * 0.5 + 0.1 * off).alias("lat"),
                   (F.lit(-120.0) + (uid % 37) * 0.75 + 0.2 * off).alias("lon"), F.col("ts").alias("time"))
    s = J.sample_linear(pts, species_cube(spark, sf_dir, 24), CUBE_Y, CUBE_X, "dust",
                        time_axis=J.RegularAxis(0.0, 24.0, 30), time_origin=CUBE_ORIGIN)
    return rounded(s.select("event_id", (F.col("dust") * 1e9).alias("dust_ug")))


def _agreement_by_fire_sql():
    from ashgrid.plans.sensor_queries import _LONG, _METRICS_OUT
    body = _LONG.format(lo=2, hi=1000, key="fire_id")
    body = body.replace(
        "select 'est_a' as source, pm25 as truth, est_a as est, lat, lon, time from sensor_obs\n  union all\n"
        "  select 'est_b' as source, pm25 as truth, est_b as est, lat, lon, time from sensor_obs",
        "select f.fire_id, o.pm25 as truth, o.est_a as est, o.lat, o.lon, o.time from sensor_obs o join fire f\n"
        "    on abs(o.lat - f.lat) < 1.0 and abs(o.lon - f.lon) < 1.0 and o.time >= f.idate and o.time <= f.fdate")
    return body + f"select fire_id, {_METRICS_OUT} from m"


@register("agreement_by_fire", sql=_agreement_by_fire_sql())
def q_agreement_by_fire(spark, sf_dir):
    """D3 per fire (+C3, D12): agreement of one estimate with readings within +/-1 degree of each
    fire during its period; one rank per fire, worked out where its pairs are made."""
    o = sensor_obs(spark, sf_dir).select("lat", "lon", "time", "pm25", "est_a")
    m = J.obs_near_fire(o, fire(spark, sf_dir), 1.0, together=True)
    return rounded(agg.agreement_by(m, "pm25", "est_a", ["fire_id"]))
