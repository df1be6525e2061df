"""Physical-plan checks and streaming recovery."""

import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001, SF0001


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_are_equi_joins(spark):
    from ashgrid.operators import joins as J
    from ashgrid.sources.fixtures import fire, sensor_obs
    # the flagship's box join sits behind a checkpoint: its plan is looked at before that
    for half, join in ((0.5, J.obs_near_fire), (1.0, J.covering_fires)):
        p = plan(join(sensor_obs(spark, SF001), fire(spark, SF001), half))
        assert "Generate explode" in p and "FileScan parquet" in p
        joins = [l for l in p.splitlines() if "Join" in l]
        assert joins and not any("NestedLoop" in l or "Cartesian" in l for l in joins)
        binned = [l for l in joins if "_cy" in l and "_cx" in l and "_cp" in l]
        assert len(binned) == 1
        # a reading meets the changes of its place and period; only places meet fires
        assert all("_la" in l and "_lo" in l and "_cp" in l for l in joins if l not in binned)


def test_scan_prunes_columns_and_pushes_filters(spark):
    p = plan(entry.queries()["valid_pairs"](spark, SF001))
    scan = [l for l in p.splitlines() if "FileScan parquet" in l][0]
    assert "ReadSchema: struct<event_id:bigint,value:double>" in scan
    assert "GreaterThanOrEqual(value,2.0)" in scan


def test_ranks_use_no_window_and_spread_a_hot_value(spark):
    from ashgrid.operators.ranks import _scan, average_ranks, running_totals
    df = spark.range(5000).selectExpr("id % 3 as k", "id % 700 as v")
    p = plan(average_ranks(df, ["k"], "v", buckets=8))
    assert "Window" not in p and "NestedLoop" not in p
    # a value that two thirds of the rows hold lies in many partitions, and its totals are still exact
    hot = spark.range(6000).selectExpr("0 as k", "case when id % 3 = 0 then id else 9 end as v", "1L as w", "id as s")
    parts = hot.repartitionByRange(12, "k", "v", "s").sortWithinPartitions("k", "v", "s").mapInArrow(
        lambda b: _scan(b, ["k"], "v", ["w"]), "k int, v long, w long, s long, w_before long, w_tied long, _pid int, _edge int")
    assert parts.filter("v = 9").select("_pid").distinct().count() >= 7
    got = running_totals(hot, ["k"], "v", ["w"], ["s"], buckets=12)
    assert got.columns == ["k", "v", "w", "s", "w_before", "w_tied"]
    nine = got.filter("v = 9").agg(F.min("w_before"), F.max("w_before"), F.min("w_tied"), F.max("w_tied")).first()
    assert tuple(nine) == (3, 3, 4001, 4001)
    late = got.filter("v = 5997").first()
    assert (late.w_before, late.w_tied) == (5999, 1)


def test_building_grid_sampling_runs_no_job(spark):
    from ashgrid.operators import joins as J
    from ashgrid.sources.fixtures import CUBE_T, CUBE_X, CUBE_Y, EPOCH_2024, reading_cube, sensor_obs
    obs, cube = sensor_obs(spark, SF001), reading_cube(spark, SF001)  # opening a file reads its footer in a job
    keys = spark.createDataFrame([("ab",)], "fire_key string")
    names = spark.createDataFrame([("x" * 5000 + "ab",)], "dir_name string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "no job expected")
    try:
        timed = dict(time_axis=CUBE_T, time_origin=EPOCH_2024)
        a = J.sample_nearest(obs, cube, CUBE_Y, CUBE_X, ["v"], **timed)
        b = J.sample_linear(obs, cube, CUBE_Y, CUBE_X, "v", **timed)
        assert not tracker.getJobIdsForGroup("plan-only")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Generate" not in plan(b) and plan(b).count("FileScan") == 2 and plan(a).count("FileScan") == 2
    assert J.match_by_substring(keys, names).first().dir_name.endswith("ab")  # names of any length


def test_grid_sampling_has_no_distance_join(spark):
    for name in ("sample_nearest", "sample_linear", "sample_projected", "append_grid_bands"):
        p = plan(entry.queries()[name](spark, SF001))
        assert "NestedLoopJoin" not in p and "CartesianProduct" not in p, name


def test_stream_restart_does_not_duplicate(spark):
    from ashgrid.plans.io_queries import _grid_axes, _raw_schema, _write_raw_csv
    from ashgrid.sources.fixtures import grid_cell
    from ashgrid.streaming.annotate import stream_annotate
    base = tempfile.mkdtemp(prefix="ashgrid-stream-")
    _write_raw_csv(spark, SF0001, f"{base}/in", parts=3)
    ay, ax = _grid_axes(spark, SF0001)
    args = (spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", grid_cell(spark, SF0001), ay, ax, ["v"])
    stream_annotate(*args, schema=_raw_schema(), keep=["event_id"])
    n1 = spark.read.parquet(f"{base}/out").count()
    stream_annotate(*args, schema=_raw_schema(), keep=["event_id"])     # restart: nothing new
    assert spark.read.parquet(f"{base}/out").count() == n1
    # a new file arrives: only it is processed
    late = spark.read.option("header", True).csv(f"{base}/in").limit(5).toPandas()
    late.to_csv(f"{base}/in/late.csv", index=False)
    stream_annotate(*args, schema=_raw_schema(), keep=["event_id"])
    assert spark.read.parquet(f"{base}/out").count() > n1


def test_a_batch_reads_only_the_tiles_of_its_readings(spark):
    import datetime as dt
    from ashgrid.operators import joins as J
    from ashgrid.streaming.annotate import TileCache, sampled, stream_annotate, write_tiled_grid
    base = tempfile.mkdtemp(prefix="ashgrid-tiles-")
    origin, ay, ax, at = dt.datetime(2024, 1, 1), J.RegularAxis(0.0, 1.0, 32), J.RegularAxis(0.0, 1.0, 32), J.RegularAxis(0.0, 1.0, 48)
    grid = spark.range(48 * 32 * 32).selectExpr("id div 1024 as t", "(id div 32) % 32 as y", "id % 32 as x", "cast(id as double) as v")
    axes = dict(time_axis=at, time_origin=origin)

    def readings(rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, lat double, lon double, time timestamp_ntz")

    some = [(0.2, 0.4, origin), (3.0, 7.4, origin + dt.timedelta(hours=20)), (31.0, 31.0, origin + dt.timedelta(hours=47)), (99.0, 0.0, origin),
            (7.6, 0.0, origin)]
    for method, whole in (("nearest", lambda o: J.sample_nearest(o, grid, ay, ax, ["v"], **axes)),
                          ("linear", lambda o: J.sample_linear(o, grid, ay, ax, "v", **axes))):
        tiled = write_tiled_grid(grid, f"{base}/{method}", ["v"], method, True, size=(24, 8, 8))
        cache = TileCache(tiled, limit=3)
        # 2 x 4 x 4 tiles lie in the store; the readings touch these (7.6 is nearest to row 8, above row 7)
        touched = {(0, 0, 0), (1, 3, 3)} | ({(0, 1, 0)} if method == "nearest" else set())
        files = tiled.read(sorted(touched)).inputFiles()
        got = sampled(readings(some), cache, ay, ax, ["v"], **axes)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole(readings(some)).collect()))
        assert {tuple(int(p.split("=")[1]) for p in f.split("/")[-4:-1]) for f in files} == touched and len(files) == len(touched)
        assert [k for k, _ in cache.groups] == [touched]
        sampled(readings(some[:1]), cache, ay, ax, ["v"], **axes)
        assert [k for k, _ in cache.groups] == [touched]                       # kept: nothing read again
        late = [(9.0, 9.0, origin), (17.0, 9.0, origin), (9.0, 17.0, origin)]
        sampled(readings(late), cache, ay, ax, ["v"], **axes)
        assert len(cache.groups) == 1 and (0, 1, 1) in cache.groups[0][0]      # the older tiles went
        unread = TileCache(tiled)
        assert sampled(readings(some[3:4]), unread, ay, ax, ["v"], **axes).first().v is None and not unread.groups
        assert tiled.read([(9, 9, 9)]) is None
        cache.clear()


def test_repeated_readings_and_irregular_axes_interpolate(spark):
    from ashgrid.operators import joins as J
    cells = spark.createDataFrame([(y, x, 10.0) for y in range(3) for x in range(3)], "y long, x long, v double")
    obs = spark.createDataFrame([(1, 0.7, 0.2), (1, 0.7, 0.2), (2, 2.0, 2.0), (3, 9.0, 0.0)], "id long, lat double, lon double")
    for ay in (J.RegularAxis(0.0, 1.0, 3), J.IrregularAxis((0.0, 0.5, 2.0))):
        got = sorted((r.id, r.v) for r in J.sample_linear(obs, cells, ay, J.RegularAxis(0.0, 1.0, 3), "v").collect() if r.id < 3)
        assert got == [(1, 10.0), (1, 10.0), (2, 10.0)]
    far = J.sample_linear(obs, cells, J.RegularAxis(0.0, 1.0, 3), J.RegularAxis(0.0, 1.0, 3), "v").filter("id = 3").first()
    assert far.v is None


def test_every_survey_operator_has_a_query():
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    r = subprocess.run([sys.executable, "tools/coverage.py"], capture_output=True, text=True, cwd=root)
    assert r.returncode == 0, r.stdout[-500:]


def test_box_join_prefilter_reaches_the_scan(spark):
    import datetime as dt
    from ashgrid.operators import joins as J
    t0 = dt.datetime(2024, 1, 1)
    path = tempfile.mkdtemp(prefix="ashgrid-obs-") + "/obs"
    spark.createDataFrame([(i, 30.0 + i % 5, -100.0 + i % 7, t0 + dt.timedelta(hours=i)) for i in range(200)],
                          "event_id long, lat double, lon double, time timestamp_ntz").write.parquet(path)
    fires = spark.createDataFrame([(1, 31.0, -98.0, t0 + dt.timedelta(days=2), t0 + dt.timedelta(days=3))],
                                  "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        p = plan(J.obs_near_fire(spark.read.parquet(path), fires, 0.5))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    scan = [l for l in p.splitlines() if "FileScan parquet" in l][0]
    pushed = scan[scan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(time" in pushed and "LessThanOrEqual(lat" in pushed


def test_best_crop_is_one_shuffle_and_matches_a_loop(spark):
    """H11 on a small stack against every candidate counted pixel by pixel."""
    import random

    from pyspark.sql import functions as F

    from ashgrid.operators import pixels as P
    rng, T, n, size, k, seed = random.Random(3), 2, 3, 9, 6, 5
    rows = [(2018, fire, s, lag, y, x, rng.choice([0, 0, 0, 0, 7, 15]) if fire != 3 else 0, int(fire != 3 and rng.random() < 0.1))
            for fire in (1, 2, 3) for s in range(2) for lag in range(T + 1) for y in range(size) for x in range(size)]
    rows[5] = (*rows[5][:6], None, None)
    df = spark.createDataFrame(rows, "year int, fire_id long, sample_idx long, lag long, y int, x int, af_hh int, label int").repartition(3)
    best = P.best_of_k_crops(df, k, n, size, size, seed, T)
    shape = best._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in shape and "Generate" not in shape and plan(best).count("Exchange hashpartitioning") <= 1
    offsets = {(r.fire_id, r.sample_idx, r.i): (r.top, r.left) for r in df.select("year", "fire_id", "sample_idx").distinct()
               .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
               .select("fire_id", "sample_idx", "i", *P.crop_offsets(("year", "fire_id", "sample_idx"), F.col("i"), size, size, n, seed)).collect()}
    got = {(r.fire_id, r.sample_idx): (r.crop_i, r.top, r.left) for r in best.collect()}
    assert len(got) == 6
    for fire, s in got:
        def score(i):
            top, left = offsets[fire, s, i]
            own = [r for r in rows if r[1:3] == (fire, s) and top <= r[4] < top + n and left <= r[5] < left + n]
            return (sum(r[6] or 0 for r in own if r[3] < T) / (T * n * n) + 1000 * sum(r[7] or 0 for r in own if r[3] == T) / (n * n))
        i = max(range(k), key=lambda i: (score(i), -i))
        assert got[fire, s] == (i, *offsets[fire, s, i])
