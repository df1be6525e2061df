"""Derived views with the shapes the jobs expect, built from the driver's tables.

Each view is a lazy DataFrame over the parquet files, so filters and column
pruning reach the scans.  The same views are written in DuckDB SQL in
``ashgrid.plans.oracles``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ashgrid.functions.columns import hour_floor, micros_between, ntz_lit
from ashgrid.operators.joins import RegularAxis

EPOCH_2024 = _dt.datetime(2024, 1, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _day0() -> Column:
    return ntz_lit(EPOCH_2024)


def sensor_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings with two estimates: event_id, station_id, lat, lon, time, pm25, est_a, est_b."""
    e = table(spark, sf_dir, "events")
    eid, uid, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return e.select(
        eid,
        uid.alias("station_id"),
        (F.lit(30.0) + (uid % 20) * 0.5).cast("double").alias("lat"),
        (F.lit(-120.0) + (uid % 37) * 0.75).cast("double").alias("lon"),
        hour_floor(F.col("ts")).alias("time"),
        v.alias("pm25"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(v * 0.8 + eid % 7).cast("double").alias("est_a"),
        F.when(eid % 5 == 0, F.lit(None)).otherwise(v * 1.1 - eid % 13).cast("double").alias("est_b"),
    )


def fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fire catalog: fire_id, lat, lon, idate, fdate, area."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("fire_id"),
        (F.lit(30.0) + (k % 20) * 0.5 + 0.25).cast("double").alias("lat"),
        (F.lit(-120.0) + (k % 37) * 0.75 + 0.25).cast("double").alias("lon"),
        (_day0() + F.make_dt_interval((k % 25).cast("int"))).alias("idate"),
        (_day0() + F.make_dt_interval((k % 25 + k % 5 + 1).cast("int"))).alias("fdate"),
        (F.col("c_acctbal") * 10000).alias("area"),
    )


def grid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular 0.25 x 0.75 degree grid: y, x, lat, lon, v, qflag."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    y = F.floor(k / 40).cast("long")
    return p.select(
        y.alias("y"),
        (k % 40).alias("x"),
        (F.lit(30.0) + y * 0.25).cast("double").alias("lat"),
        (F.lit(-120.0) + (k % 40) * 0.75).cast("double").alias("lon"),
        (F.col("p_retailprice") / 10).alias("v"),
        (F.col("p_size") % 5).alias("qflag"),
    )


def pixel_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse daily 16 x 16 rasters: fire_id, obs_date, y, x, v, af_hhmm."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return (e.groupBy(
                (F.col("user_id") % 8).alias("fire_id"),
                F.col("ts").cast("date").alias("obs_date"),
                F.floor((eid % 256) / 16).cast("long").alias("y"),
                (eid % 16).alias("x"))
             .agg(F.max("value").alias("v"),
                  F.max(F.when(F.col("event_type") == "error", 100 * (eid % 24))).alias("af_hhmm")))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pixels: px, y (label), score, grp."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("px"),
        F.col("quality").alias("y"),
        ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("score"),
        F.col("lang").alias("grp"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File manifest with server tags: page_id, url, bytes, md5, etag, expected_bytes."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    blen = F.octet_length(F.col("html"))
    md5 = F.md5(F.col("html"))
    return p.select(
        pid, F.col("url"), blen.alias("bytes"), md5.alias("md5"),
        F.when(pid % 9 == 0, F.lit("stale")).otherwise(md5).alias("etag"),
        F.when(pid % 7 == 0, blen + 1).otherwise(blen).alias("expected_bytes"),
    )


# axes of ``reading_cube``: 3-hourly steps over 30 days on the stations' half-degree lattice
CUBE_T = RegularAxis(0.0, 3.0, 240)
CUBE_Y = RegularAxis(30.0, 0.5, 20)
CUBE_X = RegularAxis(-120.0, 0.75, 37)


def reading_cube(spark: SparkSession, sf_dir: str, step_hours: int = 3) -> DataFrame:
    """A gridded estimate (t, y, x) with a quality flag: step of ``step_hours`` since 2024-01-01, v, qflag."""
    e = table(spark, sf_dir, "events")
    hours = micros_between(_day0(), F.col("ts")) / 3.6e9
    return (e.groupBy(F.floor(hours / step_hours).alias("t"), (F.col("user_id") % 20).alias("y"), (F.col("user_id") % 37).alias("x"))
             .agg(F.avg("value").alias("v"), F.min(F.col("event_id") % 5).alias("qflag")))


VIEWS = {
    "sensor_obs": sensor_obs,
    "fire": fire,
    "grid_cell": grid_cell,
    "pixel_obs": pixel_obs,
    "pred": pred,
    "manifest": manifest,
}


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily fire rasters (16 x 16, sparse) with four bands named by index:
    b0 (reflectance), b7 (wind direction, degrees), b16 (land cover class 0..17),
    b22 (active-fire time hhmm, null when no detection).  Fires are spread over the
    years 2018-2021 (year = 2018 + fire_id mod 4)."""
    p = pixel_obs(spark, sf_dir)
    v = F.col("v")
    return p.select((F.lit(2018) + F.col("fire_id") % 4).cast("int").alias("year"), "fire_id", "obs_date", "y", "x",
                    v.alias("b0"), F.pmod(v * 7, F.lit(360.0)).alias("b7"),
                    (F.floor(v).cast("int") % 18).alias("b16"), F.col("af_hhmm").cast("double").alias("b22"))


VIEWS["raster"] = raster
