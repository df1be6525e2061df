"""Findings of round 3: joins and ranks whose work grows like their result."""

import datetime as dt
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ashgrid.operators import aggregates as A
from ashgrid.operators import geometry as GEO
from ashgrid.operators import joins as J
from ashgrid.operators import ranks as R
from ashgrid.sources import files as SRC

T0 = dt.datetime(2024, 1, 1)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _obs(spark, rows):
    return spark.createDataFrame(rows, "event_id long, lat double, lon double, time timestamp_ntz")


def _fires(spark, rows):
    return spark.createDataFrame(rows, "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")


def _tables(tmp_path, spark, events=400, customers=60):
    """The two driver tables the fire queries read, with rows of their own."""
    ev = [(i, i % 30, T0 + dt.timedelta(hours=(i * 7) % 600, minutes=i % 60), "view", float(i % 90)) for i in range(events)]
    spark.createDataFrame(ev, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, 100.0 * i) for i in range(customers)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_f4_readings_meet_fires_by_place_and_day(spark):
    rng = np.random.default_rng(3)
    obs = [(i, 30 + int(rng.integers(0, 8)) * 0.5, -110 + int(rng.integers(0, 8)) * 0.5, T0 + dt.timedelta(hours=int(rng.integers(0, 900)))) for i in range(1500)]
    obs += [obs[0], (9001, None, -109.0, T0), (9002, 31.0, float("nan"), T0), (9003, 31.0, -109.0, None), (9004, 30.0, -109.0, T0 + dt.timedelta(days=7))]
    fires = [(i, 30 + int(rng.integers(0, 16)) * 0.25, -110 + int(rng.integers(0, 16)) * 0.25, s := T0 + dt.timedelta(minutes=int(rng.integers(-9000, 50000))),
              s + dt.timedelta(hours=int(rng.integers(0, 500)))) for i in range(120)]
    # repeated, reversed, incomplete; one instant; sides and ends on a reading
    fires += [fires[0], (201, 31.0, -109.0, T0 + dt.timedelta(days=9), T0), (202, None, -109.0, T0, T0 + dt.timedelta(days=9)),
              (203, 31.0, -109.0, None, T0), (204, 30.25, -109.25, T0 + dt.timedelta(days=7), T0 + dt.timedelta(days=7)), (None, 31.0, -109.0, T0, T0 + dt.timedelta(days=20))]
    got = J.obs_near_fire(_obs(spark, obs), _fires(spark, fires), 0.5)
    joins = [x for x in plan(got).splitlines() if "Join" in x]
    assert sum("_day" in x and "_la" in x and "_lo" in x for x in joins) == 1
    want = [(o[0], f[0]) for o in obs for f in fires if None not in o and None not in f[1:] and abs(o[1] - f[1]) < 0.5 and abs(o[2] - f[2]) < 0.5 and f[3] <= o[3] <= f[4]]
    key = lambda p: (p[0], p[1] is None, p[1] or 0)
    assert sorted(((r.event_id, r.fire_id) for r in got.collect()), key=key) == sorted(want, key=key) and len(want) > 500
    assert got.columns == ["event_id", "lat", "lon", "time", "fire_id"]


def test_f5_copies_are_dealt_before_they_are_made(spark):
    obs = _obs(spark, [(i, 30.0, -110.0, T0 + dt.timedelta(hours=i)) for i in range(40)])
    fires = _fires(spark, [(i, 30.25, -110.25, T0, T0 + dt.timedelta(hours=i)) for i in range(30)])
    out = J.obs_within_fire_box(obs, fires)
    assert "REPARTITION_BY_COL" in plan(out).split("Generate explode(array_repeat", 1)[1].split("Join", 1)[0]
    assert {r.event_id: r["count"] for r in out.groupBy("event_id").count().collect()} == {i: 30 - i for i in range(30)}


def test_f3_coverage_matches_a_place_and_time_once(spark, tmp_path):
    d = _tables(tmp_path, spark)
    e = spark.read.parquet(f"{d}/events.parquet")
    e.unionByName(e.withColumn("event_id", F.col("event_id") + 1000)).write.parquet(f"{d}/twice/events.parquet")
    spark.read.parquet(f"{d}/customer.parquet").write.parquet(f"{d}/twice/customer.parquet")
    once, twice = (entry.queries()["coverage_by_year"](spark, x) for x in (d, f"{d}/twice"))
    assert "HashAggregate(keys=[lat" in plan(once).split("_day", 1)[1]
    assert once.collect() == twice.collect() and once.first().fires_with_data > 0


def test_f1_matched_pairs_may_be_packed(spark, tmp_path):
    rows = [(f"fire_{i}", i % 4, i, 30.0, -110.0, T0, 1.5, 2.5) for i in range(300)]
    df = spark.createDataFrame(rows, "fire_name string, sensor_id long, sat_id long, lat double, lon double, time timestamp_ntz, sensor_pm25 double, sat_pm25 double")
    for codec, suffix in (("none", ".csv"), ("gzip", ".csv.gz")):
        SRC.write_matched_csv(df, f"{tmp_path}/{codec}", compression=codec)
        parts = [p for p in (tmp_path / codec).iterdir() if p.name.startswith("part-")]
        assert parts and all(p.name.endswith(suffix) for p in parts)
        back = spark.read.schema(df.schema).option("header", True).csv(f"{tmp_path}/{codec}")
        assert sorted(map(tuple, back.collect())) == sorted(rows) and back.columns == SRC.MATCHED_COLUMNS
    size = lambda codec: sum(p.stat().st_size for p in (tmp_path / codec).iterdir() if p.name.startswith("part-"))
    assert size("gzip") * 4 < size("none")


def test_f2_small_groups_are_ranked_like_large_ones(spark):
    rng = np.random.default_rng(8)
    n = 6000
    pdf = pd.DataFrame({"fire_id": np.where(rng.uniform(size=n) < 0.4, 0, rng.integers(1, 200, n)), "truth": rng.integers(2, 30, n) * 1.0, "lat": 30.0, "lon": -110.0})
    pdf["est"] = (pdf.truth + rng.normal(0, 9, n)).round().clip(0, 900)
    pdf.loc[pdf.fire_id == 7, "est"] = 5.0
    df = spark.createDataFrame(pdf)
    v = pdf[pdf.est >= 2]
    want = {k: g.truth.rank().corr(g.est.rank()) if min(g.truth.nunique(), g.est.nunique()) > 1 else None for k, g in v.groupby("fire_id")}
    sizes = df.groupBy("fire_id").agg(F.count("*").alias("n"))
    valid = df.filter("est >= 2")
    for most in (R.GROUP_ROWS, 500, 0):  # all small, one large, all large
        got = {r.fire_id: r.spearman for r in R.rank_correlation_of_groups(valid, ["fire_id"], "truth", "est", sizes, most=most).collect()}
        assert got.keys() == want.keys()
        for k, x in want.items():
            assert got[k] == (None if x is None else pytest.approx(x, abs=1e-9)), (most, k)
    out = A.agreement_by(df, "truth", "est", ["fire_id"])
    assert "MapInArrow" in plan(out)
    assert {r.fire_id: r.n for r in out.collect()} == v.groupby("fire_id").size().to_dict()


def test_f6_f7_edges_of_a_ring_are_made_once(spark):
    ring = lambda x, y, r: [(x + r * a, y + r * b) for a, b in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    # inside; around; through one side without a corner in either; beside at the same latitudes; above; null
    cases = {"in": ring(5.0, 5.0, 1.0), "around": ring(5.0, 5.0, 30.0), "through": [(4.0, -3.0), (6.0, -3.0), (6.0, 13.0), (4.0, 13.0), (4.0, -3.0)],
             "beside": ring(12.0, 5.0, 1.5), "above": ring(5.0, 12.0, 1.5), "corner": ring(10.4, 10.4, 1.0), "null": None}
    df = spark.createDataFrame([(k, 1.0, v) for k, v in cases.items()], "name string, r double, pts array<struct<lon:double,lat:double>>")
    made = df.select("name", F.transform("pts", lambda p: F.struct((p["lon"] * F.col("r")).alias("lon"), p["lat"].alias("lat"))).alias("ring"))
    out = GEO.polygons_in_region(made, ring=square)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("sequence(1") <= 1
    assert {r["name"] for r in out.collect()} == {"in", "around", "through", "corner"}


def test_op7_texts_without_open_regions_are_not_shuffled(spark):
    from ashgrid.llm import repeats as P
    common = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(150))
    docs = spark.createDataFrame([(i, f"{i:04d} " * 40 + (common + f" tail {i} " * 20 if i < 2 else "")) for i in range(30)], "doc_id long, text string")
    regions = P.candidate_regions(docs).filter("not whole").withColumn("many", F.lit(False))
    cut = P.region_bytes(docs, regions)
    assert "bitmap_construct_agg" in cut._jdf.queryExecution().optimizedPlan().toString()
    want = {(r.d, r.start, r["count"]) for r in regions.collect()}
    assert {(r.d, r.start, len(r.bytes) - P.SPAN + 1) for r in cut.collect()} == want and want


def test_f1_a_stored_step_leaves_no_shuffle_files(tmp_path):
    """In a session of its own, whose local folder holds nothing else."""
    code = f"""
import glob, sys, time
sys.path.insert(0, {ROOT!r})
from pyspark.sql import functions as F
from ashgrid.llm.common import stored
from ashgrid.session import build_session
spark = build_session("local[2]", 7, driver_memory="1g")
files = lambda: glob.glob({str(tmp_path)!r} + "/**/shuffle_*", recursive=True)
rows = spark.range(3000).groupBy((F.col("id") % 300).alias("k")).agg(F.sum("id").alias("s"))
late = rows.join(spark.range(200).withColumnRenamed("id", "k").hint("merge"), "k")
step = late
for _ in range(4):
    step = stored(step.groupBy("k").agg(F.sum("s").alias("s")))
end = time.time() + 15
while files() and time.time() < end:  # files are removed beside the job
    time.sleep(0.2)
assert not files(), len(files())
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
want = sorted((k, sum(range(k, 3000, 300))) for k in range(200))
assert sorted(map(tuple, step.collect())) == sorted(map(tuple, late.collect())) == want
late.collect()
assert files()  # a frame that is not stored keeps them for its next run
spark.stop()
"""
    got = subprocess.run([sys.executable, "-c", code], env=os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path), "TMPDIR": str(tmp_path)},
                         capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr[-2000:]
