"""Registered queries for the column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashgrid.functions import columns as C
from ashgrid.functions import geo as G
from ashgrid.plans.catalog import register, rounded
from ashgrid.sources.fixtures import grid_cell, pixel_obs, sensor_obs, table


def raw_sensor_rows(spark, sf_dir):
    """Raw hourly-sensor shape (string date, "HH:MM" time, state/county/site codes) from events;
    every 17th row carries an unparseable date."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return e.select(
        eid,
        F.when(eid % 17 == 0, F.lit("bad-date")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("Date GMT"),
        F.concat(F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit(":00")).alias("Time GMT"),
        (F.lit(30.0) + (uid % 20) * 0.5).alias("Latitude"),
        (F.lit(-120.0) + (uid % 37) * 0.75).alias("Longitude"),
        F.col("value").alias("Sample Measurement"),
        (uid % 56).alias("State Code"), (eid % 1000).alias("County Code"), eid.alias("Site Num"))


_RAW = """raw as (select event_id,
  case when event_id % 17 = 0 then 'bad-date' else strftime(ts, '%Y-%m-%d') end as d,
  lpad(cast(hour(ts) as varchar), 2, '0') || ':00' as t,
  30 + (user_id % 20) * 0.5 as lat, -120 + (user_id % 37) * 0.75 as lon, value,
  user_id % 56 as st, event_id % 1000 as co, event_id as si from events)"""


@register("normalise_sensor", sql=f"""with {_RAW}
select event_id, try_strptime(d || ' ' || t, '%Y-%m-%d %H:%M') as time,
       cast(lat as double) as lat, cast(lon as double) as lon, value as pm25
from raw where try_strptime(d || ' ' || t, '%Y-%m-%d %H:%M') is not null""")
def q_normalise_sensor(spark, sf_dir):
    """B1: raw rows -> (time, lat, lon, pm25); unparseable dates dropped."""
    return C.normalise_sensor(raw_sensor_rows(spark, sf_dir), keep=["event_id"])


@register("site_id", sql=f"""with {_RAW}
select event_id,
  (case when length(cast(st as varchar)) < 2 then lpad(cast(st as varchar), 2, '0') else cast(st as varchar) end)
  || (case when length(cast(co as varchar)) < 3 then lpad(cast(co as varchar), 3, '0') else cast(co as varchar) end)
  || (case when length(cast(si as varchar)) < 4 then lpad(cast(si as varchar), 4, '0') else cast(si as varchar) end)
  as padded,
  cast(st as varchar) || cast(co as varchar) || cast(si as varchar) as unpadded
from raw""")
def q_site_id(spark, sf_dir):
    """B2: zero-padded and plain site identifiers (site numbers longer than 4 digits keep all digits)."""
    r = raw_sensor_rows(spark, sf_dir)
    return r.select("event_id",
                    C.site_id("State Code", "County Code", "Site Num", padded=True).alias("padded"),
                    C.site_id("State Code", "County Code", "Site Num", padded=False).alias("unpadded"))


@register("valid_pairs", sql="""
select event_id, pm25, est_a from sensor_obs
where pm25 is not null and est_a is not null and pm25 between 2 and 1000 and est_a between 2 and 1000""")
def q_valid_pairs(spark, sf_dir):
    """Present and within the closed range [2, 1000]."""
    return C.valid_pairs(sensor_obs(spark, sf_dir).select("event_id", "pm25", "est_a"), "pm25", "est_a", 2, 1000)


@register("hours_in", sql="select event_id, time from sensor_obs where hour(time) in (0, 12)")
def q_hours_in(spark, sf_dir):
    """Analysis hours 0 and 12."""
    return C.hours_in(sensor_obs(spark, sf_dir).select("event_id", "time"), "time", (0, 12))


def image_rows(spark, sf_dir):
    """Image metadata shape from events: image id with forecast token, forecast and init hours."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(eid, F.concat(F.lit("T"), F.lpad(F.hour("ts").cast("string"), 2, "0"), F.lit("_F"),
                                  F.lpad((eid % 12).cast("string"), 3, "0")).alias("image_id"),
                    (eid % 12).alias("forecast_hour"), (F.hour("ts") % 6).alias("init_hour"),
                    F.col("ts").alias("valid_time"), F.col("value"), F.col("user_id"))


_IMG = """img as (select event_id, 'T' || lpad(cast(hour(ts) as varchar), 2, '0') || '_F'
  || lpad(cast(event_id % 12 as varchar), 3, '0') as image_id, event_id % 12 as forecast_hour,
  hour(ts) % 6 as init_hour, ts as valid_time, value, user_id from events)"""


@register("id_contains", sql=f"with {_IMG} select event_id, image_id from img where contains(image_id, 'F000')")
def q_id_contains(spark, sf_dir):
    """Analysis images (id contains F000)."""
    return C.id_contains(image_rows(spark, sf_dir).select("event_id", "image_id"), "image_id", "F000")


@register("forecast_filter", sql=f"""with {_IMG}
select event_id, cast(forecast_hour as bigint) as forecast_hour from img where forecast_hour <= 3 and init_hour = 0""")
def q_forecast_filter(spark, sf_dir):
    """Forecast hour <= 3 and initialisation hour 0."""
    img = image_rows(spark, sf_dir)
    return C.forecast_filter(img, "forecast_hour", "init_hour", 3, 0).select("event_id", "forecast_hour")


@register("positive_pairs", sql="""
select event_id from sensor_obs
where pm25 > 0 and est_b > 0 and pm25 < 100000 and est_b < 100000 and year(time) < 2025""")
def q_positive_pairs(spark, sf_dir):
    """Both positive, below 1e5, year before 2025."""
    return C.positive_pairs(sensor_obs(spark, sf_dir), "pm25", "est_b", "time", 2025, 0.0, 100000.0).select("event_id")


@register("mask_year", sql="""
select event_id, case when year(time) != 2024 then est_a end as est_a_no_2024,
       case when year(time) != 2023 then est_a end as est_a_no_2023 from sensor_obs""")
def q_mask_year(spark, sf_dir):
    """Copies of a column nulled in one year."""
    o = sensor_obs(spark, sf_dir)
    return o.select("event_id", C.mask_year("est_a", "time", 2024).alias("est_a_no_2024"),
                    C.mask_year("est_a", "time", 2023).alias("est_a_no_2023"))


@register("mask_quality", sql="select y, x, case when qflag in (3, 4) then v end as v from grid_cell")
def q_mask_quality(spark, sf_dir):
    """Corrected value kept for quality flags 3 and 4."""
    g = grid_cell(spark, sf_dir)
    return g.select("y", "x", C.mask_quality("v", "qflag").alias("v"))


def species_rows(spark, sf_dir):
    """Five aerosol species (kg/m3) derived from the part table."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("cell"), (F.col("p_retailprice") * 1e-12).alias("dust"),
                    (F.col("p_size") * 1e-11).alias("oc"), ((k % 7) * 1e-12).alias("bc"),
                    ((k % 13) * 2e-12).alias("seasalt"), ((k % 17) * 3e-12).alias("so4"))


_SPECIES = """sp as (select p_partkey as cell, p_retailprice * 1e-12 as dust, p_size * 1e-11 as oc,
  (p_partkey % 7) * 1e-12 as bc, (p_partkey % 13) * 2e-12 as seasalt, (p_partkey % 17) * 3e-12 as so4 from part)"""


@register("pm25_from_species", sql=f"""with {_SPECIES}
select cell, round((dust + oc + bc + seasalt + so4 * (132.14 / 96.06)) * 1e9, 6) as pm25,
       round(dust * 1e9, 6) as dust_ug from sp""")
def q_pm25_from_species(spark, sf_dir):
    """B11 (+B10): PM2.5 from species, and one species converted to ug/m3."""
    s = species_rows(spark, sf_dir)
    return rounded(s.select("cell", C.pm25_from_species("dust", "oc", "bc", "seasalt", "so4").alias("pm25"),
                            C.to_micrograms("dust").alias("dust_ug")))


def weather_rows(spark, sf_dir):
    """Weather-model fields with realistic ranges, derived from events."""
    e = table(spark, sf_dir, "events")
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return e.select(
        eid.alias("cell"), F.col("ts").alias("time"), (eid % 256).alias("y"), (uid % 64).alias("x"),
        (v / 10000).alias("QVAPOR"), ((eid % 2000) - 1000).cast("double").alias("P"),
        (80000 + (uid % 200) * 100).cast("double").alias("PB"), ((eid % 40) - 10).cast("double").alias("T"),
        (v / 7).alias("RAINNC"), ((eid % 9) * 0.5).alias("RAINC"), ((eid % 21) - 10.0).alias("U10"),
        ((uid % 17) - 8.0).alias("V10"), (260 + v / 10).alias("T2"), (v / 20000).alias("Q2"),
        (30 + (uid % 20) * 0.5).alias("XLAT"), (-120 + (uid % 37) * 0.75).alias("XLONG"))


_WX = """wx as (select event_id as cell, ts as time, event_id % 256 as y, user_id % 64 as x,
  value / 10000 as qv, cast((event_id % 2000) - 1000 as double) as p,
  cast(80000 + (user_id % 200) * 100 as double) as pb, cast((event_id % 40) - 10 as double) as t,
  value / 7 as rainnc, cast((event_id % 9) * 0.5 as double) as rainc, cast((event_id % 21) - 10.0 as double) as u10,
  cast((user_id % 17) - 8.0 as double) as v10, 260 + value / 10 as t2, value / 20000 as q2,
  cast(30 + (user_id % 20) * 0.5 as double) as xlat, cast(-120 + (user_id % 37) * 0.75 as double) as xlong from events)"""

_RH_SQL = """tk as (select cell, qv, p + pb as full_p, (t + 300) * pow((p + pb) / 100000.0, 287.05 / 1004.0) as temp_k from wx),
es as (select *, 10 * 0.6112 * exp(17.67 * (temp_k - 273.15) / (temp_k - 29.65)) as es from tk)"""


@register("weather_formulas", sql=f"""with {_WX}, {_RH_SQL}
select cell, round(temp_k, 6) as temp_k,
  round(100 * least(greatest(greatest(qv, 0) / (0.622 * es / (0.01 * full_p - (1 - 0.622) * es)), 0), 1), 6) as rh
from es""")
def q_weather_formulas(spark, sf_dir):
    """Temperature from potential temperature and relative humidity."""
    w = weather_rows(spark, sf_dir)
    return rounded(w.select("cell",
                            C.kelvin_from_theta(F.col("T") + 300, F.col("P") + F.col("PB")).alias("temp_k"),
                            C.relative_humidity("QVAPOR", "P", "PB", "T").alias("rh")))


@register("strip_fields", sql=f"""with {_WX}
select time, y, x, round(rainnc + rainc, 6) as total_precip, round(q2 / (1 + q2), 6) as specific_humidity,
       round(v10, 6) as v10, round(u10, 6) as u10, round(t2, 6) as t2, round(xlat, 6) as xlat, round(xlong, 6) as xlong
from wx""")
def q_strip_fields(spark, sf_dir):
    """Total precipitation, specific humidity and five kept fields."""
    return rounded(C.strip_fields(weather_rows(spark, sf_dir)))


@register("from_epoch_ms", sql="""
select event_id, epoch_ms(1500000000000 + event_id * 123456789 - 700000000000) as t from events""")
def q_from_epoch_ms(spark, sf_dir):
    """Epoch milliseconds (including times before 1970) -> timestamp."""
    e = table(spark, sf_dir, "events")
    ms = F.lit(1500000000000) + F.col("event_id") * 123456789 - 700000000000
    return e.select("event_id", C.from_epoch_ms(ms).alias("t"))


@register("step_time", sql="""
select c_custkey, strptime(cast(2024000 + (c_custkey % 366) + 1 as varchar), '%Y%j')
  + to_hours(cast(c_custkey % 48 as int)) as t from customer""")
def q_step_time(spark, sf_dir):
    """YYYYDDD start date plus an hour step."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", C.step_time(F.lit(2024000) + k % 366 + 1, k % 48).alias("t"))


@register("require", sql="select event_id from sensor_obs where est_a is not null and est_b is not null")
def q_require(spark, sf_dir):
    """Drop rows missing any listed column."""
    return C.require(sensor_obs(spark, sf_dir), ["est_a", "est_b"]).select("event_id")


_NAMES = """nm as (select event_id, case when event_id % 13 = 0 then 'fire_' || user_id || '_notadate.tif'
  when event_id % 29 = 0 then 'fire_' || user_id || '_2024-13-45.tif'
  else 'fire_' || user_id || '_' || strftime(ts, '%Y-%m-%d') || '.tif' end as name from events)"""


@register("date_from_name", sql=f"""with {_NAMES}
select event_id, cast(try_strptime(nullif(regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d') as date) as d,
  cast(dayofyear(try_strptime(nullif(regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d')) as int) as doy
from nm""")
def q_date_from_name(spark, sf_dir):
    """Date from a file name (invalid names give null) and its day of year."""
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id").cast("string")
    name = (F.when(eid % 13 == 0, F.concat(F.lit("fire_"), uid, F.lit("_notadate.tif")))
             .when(eid % 29 == 0, F.concat(F.lit("fire_"), uid, F.lit("_2024-13-45.tif")))
             .otherwise(F.concat(F.lit("fire_"), uid, F.lit("_"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".tif"))))
    d = C.date_from_name(name)
    return e.select("event_id", d.alias("d"), C.day_of_year(d).alias("doy"))


@register("errors", sql="""
select event_id, round(abs(pm25 - est_a), 6) as abs_error, round(pm25 - est_a, 6) as signed_error from sensor_obs""")
def q_errors(spark, sf_dir):
    """Absolute and signed error."""
    o = sensor_obs(spark, sf_dir)
    return rounded(o.select("event_id", C.abs_error("pm25", "est_a").alias("abs_error"),
                            C.signed_error("pm25", "est_a").alias("signed_error")))


@register("doy_encoding", sql="""
with d as (select distinct fire_id, obs_date, dayofyear(obs_date) as doy from pixel_obs)
select fire_id, obs_date, list_transform(range(0, 6), lambda i: round(case when i % 2 = 0
    then sin(doy / pow(1000.0, 2 * floor((i + 2) / 2) / 6)) else cos(doy / pow(1000.0, 2 * floor((i + 2) / 2) / 6)) end, 6))
  || list_transform(range(0, 6), lambda i: round(case when i % 2 = 0
    then sin(doy / pow(1000.0, 2 * floor((i + 2) / 2) / 6)) else cos(doy / pow(1000.0, 2 * floor((i + 2) / 2) / 6)) end, 6)) as enc
from d""")
def q_doy_encoding(spark, sf_dir):
    """Sinusoidal day-of-year encoding, d=6, T=1000, offset 2, repeated twice."""
    d = pixel_obs(spark, sf_dir).select("fire_id", "obs_date").distinct()
    return rounded(d.select("fire_id", "obs_date",
                            C.doy_encoding(F.dayofyear("obs_date"), 6, 1000.0, repeat=2, offset=2).alias("enc")))


@register("web_mercator", sql="""
select distinct lat, lon, round(radians(lon) * 6378137.0, 4) as x,
  round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 4) as y from sensor_obs""")
def q_web_mercator(spark, sf_dir):
    """EPSG:4326 -> EPSG:3857 for every station."""
    s = sensor_obs(spark, sf_dir).select("lat", "lon").distinct()
    return s.select("lat", "lon", F.round(G.web_mercator_x("lon"), 4).alias("x"),
                    F.round(G.web_mercator_y("lat"), 4).alias("y"))


# A CONUS 12 km Lambert grid (standard parallels 33/45, centre -97/40).
CONUS12 = G.LambertSpec(p_alp=33.0, p_bet=45.0, xcent=-97.0, ycent=40.0, xorig=-2556000.0,
                        yorig=-1728000.0, xcell=12000.0, ycell=12000.0, ncols=459, nrows=299,
                        radius=6370000.0)

LCC_SQL = """lcc_c as (select
    ln(cos(radians(33.0)) / cos(radians(45.0))) / ln(tan(pi() / 4 + radians(45.0) / 2) / tan(pi() / 4 + radians(33.0) / 2)) as n),
lcc_f as (select n, cos(radians(33.0)) * pow(tan(pi() / 4 + radians(33.0) / 2), n) / n as f from lcc_c),
lcc as (select n, f, 6370000.0 * f / pow(tan(pi() / 4 + radians(40.0) / 2), n) as rho0 from lcc_f)"""


@register("lambert_xy", sql=f"""with {LCC_SQL},
pts as (select distinct lat, lon from sensor_obs),
r as (select lat, lon, 6370000.0 * f / pow(tan(pi() / 4 + radians(lat) / 2), n) as rho, n * radians(lon + 97.0) as th, rho0
      from pts, lcc)
select lat, lon, round(rho * sin(th), 3) as x, round(rho0 - rho * cos(th), 3) as y from r""")
def q_lambert_xy(spark, sf_dir):
    """Spherical Lambert Conformal Conic forward projection of every station."""
    s = sensor_obs(spark, sf_dir).select("lat", "lon").distinct()
    x, y = G.lambert_xy("lon", "lat", CONUS12)
    return s.select("lat", "lon", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register("cube_key", sql="""
select event_id, cast(floor((lat + 90) / 1.0) as bigint) || '_' || cast(floor((lon + 180) / 1.0) as bigint)
  || '_' || strftime(time, '%Y%m') as cube from sensor_obs""")
def q_cube_key(spark, sf_dir):
    """1-degree x month cube key."""
    from ashgrid.operators.sequences import cube_key
    o = sensor_obs(spark, sf_dir)
    return o.select("event_id", cube_key("lat", "lon", "time").alias("cube"))


@register("degree_box", sql="""
select fire_id, lon - 0.5 as min_lon, lat - 0.5 as min_lat, lon + 0.5 as max_lon, lat + 0.5 as max_lat,
       lon - 1.0 as min_lon1, lat - 1.0 as min_lat1, lon + 1.0 as max_lon1, lat + 1.0 as max_lat1 from fire""")
def q_degree_box(spark, sf_dir):
    """G1: +/-0.5 and +/-1 degree boxes around each fire."""
    from ashgrid.sources.fixtures import fire
    f = fire(spark, sf_dir)
    b1 = G.degree_box("lon", "lat", 1.0)
    return f.select("fire_id", G.degree_box("lon", "lat", 0.5).alias("b"),
                    b1.min_lon.alias("min_lon1"), b1.min_lat.alias("min_lat1"),
                    b1.max_lon.alias("max_lon1"), b1.max_lat.alias("max_lat1")).select(
        "fire_id", "b.*", "min_lon1", "min_lat1", "max_lon1", "max_lat1")


@register("km_box", sql="""
select fire_id, round(lon - 150000.0 / (111320.0 * cos(radians(lat))), 6) as min_lon, round(lat - 150000.0 / 111320.0, 6) as min_lat,
       round(lon + 150000.0 / (111320.0 * cos(radians(lat))), 6) as max_lon, round(lat + 150000.0 / 111320.0, 6) as max_lat
from fire""")
def q_km_box(spark, sf_dir):
    """Bounds of a 150 km buffer around each fire."""
    from ashgrid.sources.fixtures import fire
    f = fire(spark, sf_dir)
    return rounded(f.select("fire_id", G.km_box("lon", "lat", 150000.0).alias("b")).select("fire_id", "b.*"))


@register("cell_coords", sql="""
select y, x, round(cast((x + 0.5) * 0.01 + (y + 0.5) * 0.0 + (-121.0) as double), 6) as lon,
       round(cast((x + 0.5) * 0.0 + (y + 0.5) * (-0.01) + 41.0 as double), 6) as lat from grid_cell""")
def q_cell_coords(spark, sf_dir):
    """Affine raster index -> pixel-centre coordinates."""
    g = grid_cell(spark, sf_dir)
    lon, lat = G.cell_coords("y", "x", 0.01, 0.0, -121.0, 0.0, -0.01, 41.0)
    return rounded(g.select("y", "x", lon.alias("lon"), lat.alias("lat")))


@register("raster_centre", sql="""
with b as (select fire_id, min(x) * 0.01 - 120 + fire_id as l0, max(x) * 0.01 - 120 + fire_id + 0.01 as r0,
                  40 - max(y) * 0.01 - 0.01 as b0, 40 - min(y) * 0.01 as t0, fire_id % 2 = 0 as geo
           from pixel_obs group by fire_id),
p as (select fire_id, geo,
        case when geo then l0 else radians(l0) * 6378137.0 end as l, case when geo then r0 else radians(r0) * 6378137.0 end as r,
        case when geo then b0 else ln(tan(pi() / 4 + radians(b0) / 2)) * 6378137.0 end as bt,
        case when geo then t0 else ln(tan(pi() / 4 + radians(t0) / 2)) * 6378137.0 end as tp from b)
select fire_id,
  round(case when geo then (l + r) / 2 else degrees(((l + r) / 2) / 6378137.0) end, 6) as lon,
  round(case when geo then (bt + tp) / 2 else degrees(2 * atan(exp(((bt + tp) / 2) / 6378137.0)) - pi() / 2) end, 6) as lat
from p""")
def q_raster_centre(spark, sf_dir):
    """Centre of raster bounds; odd fires have bounds in Web Mercator and are projected back."""
    px = pixel_obs(spark, sf_dir)
    b = px.groupBy("fire_id").agg(
        (F.min("x") * 0.01 - 120 + F.col("fire_id")).alias("l0"),
        (F.max("x") * 0.01 - 120 + F.col("fire_id") + 0.01).alias("r0"),
        (40 - F.max("y") * 0.01 - 0.01).alias("b0"), (40 - F.min("y") * 0.01).alias("t0"))
    geo = F.col("fire_id") % 2 == 0
    p = b.select("fire_id", geo.alias("geo"),
                 F.when(geo, F.col("l0")).otherwise(G.web_mercator_x("l0")).alias("l"),
                 F.when(geo, F.col("r0")).otherwise(G.web_mercator_x("r0")).alias("r"),
                 F.when(geo, F.col("b0")).otherwise(G.web_mercator_y("b0")).alias("bt"),
                 F.when(geo, F.col("t0")).otherwise(G.web_mercator_y("t0")).alias("tp"))
    lon, lat = G.raster_centre("l", "bt", "r", "tp", "geo")
    return rounded(p.select("fire_id", lon.alias("lon"), lat.alias("lat")))


@register("sensor_chunk", sql=f"""with {_RAW}
select (case when length(cast(st as varchar)) < 2 then lpad(cast(st as varchar), 2, '0') else cast(st as varchar) end)
  || (case when length(cast(co as varchar)) < 3 then lpad(cast(co as varchar), 3, '0') else cast(co as varchar) end)
  || (case when length(cast(si as varchar)) < 4 then lpad(cast(si as varchar), 4, '0') else cast(si as varchar) end) as id,
  cast(lat as double) as lat, cast(lon as double) as lon, try_strptime(d || ' ' || t, '%Y-%m-%d %H:%M') as time, value as pm25
from raw where try_strptime(d || ' ' || t, '%Y-%m-%d %H:%M') is not null""")
def q_sensor_chunk(spark, sf_dir):
    """B1 + B2: a raw chunk normalised to (id, lat, lon, time, pm25), bad dates dropped."""
    return C.sensor_chunk(raw_sensor_rows(spark, sf_dir))
