"""Hand-computed boundary cases, brute-force comparisons and properties."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashgrid.functions import columns as C
from ashgrid.functions import geo as G
from ashgrid.operators import evaluate as E
from ashgrid.operators import joins as J
from ashgrid.operators import pixels as P
from ashgrid.operators import aggregates as A
from ashgrid.operators.ranks import average_ranks, rank_correlation

T0 = dt.datetime(2024, 1, 1)


def ntz(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ----------------------------------------------------------------- range joins

def test_box_join_strict_box_closed_period(spark):
    fires = ntz(spark, [(1, 10.0, 20.0, T0, T0 + dt.timedelta(days=2))],
                "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")
    obs = ntz(spark, [
        (1, 10.5, 20.0, T0),                          # exactly 0.5 away: excluded (strict)
        (2, 10.49, 20.49, T0 + dt.timedelta(days=2)),  # at the period end: included (closed)
        (3, 10.0, 20.0, T0 + dt.timedelta(days=2, seconds=1)),  # after the end: excluded
        (4, 9.51, 19.51, T0),                          # inside
    ], "event_id long, lat double, lon double, time timestamp_ntz")
    got = sorted(r.event_id for r in J.obs_near_fire(obs, fires, 0.5).collect())
    assert got == [2, 4]


def test_box_join_overlapping_boxes_keep_duplicates_and_no_nested_loop(spark):
    fires = ntz(spark, [(1, 10.0, 20.0, T0, T0 + dt.timedelta(days=40)),
                        (2, 10.2, 20.2, T0, T0 + dt.timedelta(days=40))],
                "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")
    obs = ntz(spark, [(1, 10.1, 20.1, T0 + dt.timedelta(days=20)), (2, 11.0, 20.0, T0)],
              "event_id long, lat double, lon double, time timestamp_ntz")
    res = J.obs_within_fire_box(obs, fires, 1.0)
    assert sorted(r.event_id for r in res.collect()) == [1, 1, 2]   # 11.0 is on fire 1's edge: only fire 2
    plan = res._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_box_join_matches_brute_force(spark):
    rnd = random.Random(7)
    fires = [(i, rnd.uniform(30, 35), rnd.uniform(-110, -100), T0 + dt.timedelta(days=rnd.randint(0, 20)))
             for i in range(40)]
    fires = [(i, la, lo, s, s + dt.timedelta(days=rnd.randint(0, 30))) for i, la, lo, s in fires]
    obs = [(j, round(rnd.uniform(29, 36), 2), round(rnd.uniform(-111, -99), 2),
            T0 + dt.timedelta(hours=rnd.randint(0, 24 * 60))) for j in range(3000)]
    expect = sorted((o[0], f[0]) for o in obs for f in fires
                    if abs(o[1] - f[1]) < 0.5 and abs(o[2] - f[2]) < 0.5 and f[3] <= o[3] <= f[4])
    fdf = ntz(spark, fires, "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")
    odf = ntz(spark, obs, "event_id long, lat double, lon double, time timestamp_ntz")
    got = sorted((r.event_id, r.fire_id) for r in J.obs_near_fire(odf, fdf, 0.5, period_days=3).collect())
    assert got == expect and len(got) > 0


# ----------------------------------------------------------------- ranks

def test_average_ranks_ties(spark):
    df = ntz(spark, [(v,) for v in [3.0, 1.0, 2.0, 2.0, 5.0, 2.0]], "v double")
    r = {row.v: row.avg_rank for row in average_ranks(df, [], "v", buckets=2).collect()}
    assert r == {1.0: 1.0, 2.0: 3.0, 3.0: 5.0, 5.0: 6.0}


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_rank_correlation_matches_pandas(spark, buckets):
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.integers(0, 50, n).astype(float)          # many ties
    y = x * 0.5 + rng.normal(0, 10, n).round(1)
    key = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"k": key, "x": x, "y": y})
    expect = {k: g["x"].rank().corr(g["y"].rank()) for k, g in pdf.groupby("k")}
    got = {r.k: r.spearman for r in rank_correlation(spark.createDataFrame(pdf), ["k"], "x", "y", buckets).collect()}
    for k in expect:
        assert got[k] == pytest.approx(expect[k], abs=1e-9)


def test_constant_column_gives_null_correlations(spark):
    df = ntz(spark, [(5.0, float(i), 1.0, 1.0) for i in range(10)], "truth double, e double, lat double, lon double")
    df = df.withColumn("e2", F.lit(7.0))
    m = {r.source: r for r in A.agreement(df, "truth", ["e", "e2"], 0, 1000).collect()}
    assert m["e"].pearson is None and m["e"].spearman is None
    assert m["e2"].slope is None and m["e2"].n == 10


# ----------------------------------------------------------------- grid sampling

def test_nearest_index_ties_go_low_and_hull_is_null(spark):
    ax = J.RegularAxis(0.0, 1.0, 4)
    df = ntz(spark, [(0.5,), (1.5,), (1.49,), (3.0,), (3.01,), (-0.01,)], "v double")
    got = [r.i for r in df.select(J.nearest_index("v", ax).alias("i")).collect()]
    assert got == [0, 1, 1, 3, None, None]


def test_bilinear_matches_numpy(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(6, 7))
    cells = spark.createDataFrame([(i, j, float(grid[i, j])) for i in range(6) for j in range(7)], "y long, x long, v double")
    pts = [(k, float(rng.uniform(10, 12.5)), float(rng.uniform(-5, -2))) for k in range(50)] + [(99, 12.5, -2.0)]
    ay, ax = J.RegularAxis(10.0, 0.5, 6), J.RegularAxis(-5.0, 0.5, 7)
    got = {r.id: r.v for r in J.sample_linear(spark.createDataFrame(pts, "id long, lat double, lon double"),
                                              cells, ay, ax, "v").collect()}
    for k, la, lo in pts:
        py, px = (la - 10) / 0.5, (lo + 5) / 0.5
        y0, x0 = min(int(math.floor(py)), 4), min(int(math.floor(px)), 5)
        fy, fx = py - y0, px - x0
        e = (grid[y0, x0] * (1 - fy) * (1 - fx) + grid[y0 + 1, x0] * fy * (1 - fx)
             + grid[y0, x0 + 1] * (1 - fy) * fx + grid[y0 + 1, x0 + 1] * fy * fx)
        assert got[k] == pytest.approx(e, abs=1e-12)


def test_lambert_origin_and_truncation(spark):
    spec = G.LambertSpec(33, 45, -97, 40, -10000.0, -10000.0, 12000, 12000, 5, 5)
    df = ntz(spark, [(40.0, -97.0)], "lat double, lon double")
    x, y = G.lambert_xy("lon", "lat", spec)
    r = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(r.x) < 1e-6 and abs(r.y) < 1e-6
    cells = ntz(spark, [(T0, 0, 0, 0, 1.5)], "time timestamp_ntz, lay int, row long, col long, pm25_tot double")
    # (0 - (-10000)) / 12000 = 0.83 -> cell 0 by truncation
    obs = ntz(spark, [(1, 40.0, -97.0, T0), (2, 40.0, -97.0, T0 + dt.timedelta(hours=1))],
              "id long, lat double, lon double, time timestamp_ntz")
    got = {r.id: r.pm25_tot for r in J.sample_projected(obs, cells, spec).collect()}
    assert got == {1: 1.5, 2: None}


# ----------------------------------------------------------------- formulas

def test_relative_humidity_by_hand(spark):
    # worked by hand at 1000 hPa, where temperature equals potential temperature:
    # 273.15 K: e = 6.112 hPa, saturation ratio 0.622 * 6.112 / (1000 - 0.378 * 6.112) = 0.00381047
    # 300.00 K: e = 6.112 * exp(17.67 * 26.85 / 270.35) = 35.34520 hPa, ratio 0.02228242
    rows = [(0, 0.00381047 / 2, 0.0, 100000.0, -26.85), (1, 0.02228242 / 4, 0.0, 100000.0, 0.0),
            (2, 0.5, 500.0, 99500.0, 0.0), (3, -0.1, 0.0, 100000.0, 0.0)]
    df = spark.createDataFrame(rows, "i int, qv double, p double, pb double, t double")
    got = [r.rh for r in df.orderBy("i").select(C.relative_humidity("qv", "p", "pb", "t").alias("rh")).collect()]
    assert got == pytest.approx([50.0, 25.0, 100.0, 0.0], abs=1e-3)


def test_histogram_last_bin_closed(spark):
    df = ntz(spark, [(float(v),) for v in [0, 1, 2, 10]], "v double")
    h = {r.bin: r.n for r in A.histogram(df, "v", 5).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}


def test_site_id_zero_fill_never_truncates(spark):
    df = ntz(spark, [(6, 37, 123456)], "s int, c int, n int")
    r = df.select(C.site_id("s", "c", "n").alias("p"), C.site_id("s", "c", "n", padded=False).alias("u")).first()
    assert (r.p, r.u) == ("06037123456", "637123456")


# ----------------------------------------------------------------- pixels

def test_landcover_zero_goes_to_last_class(spark):
    df = ntz(spark, [(0,), (1,), (17,), (None,)], "lc int")
    got = [r.h for r in df.select(P.one_hot_landcover("lc").alias("h")).collect()]
    assert got[0].index(1) == 16 and got[1].index(1) == 0 and got[2].index(1) == 16 and got[3].index(1) == 16
    assert all(sum(h) == 1 and len(h) == 17 for h in got)


def test_exactly_one_fire_pixel_is_in_neither_subset(spark):
    counts = ntz(spark, [(2018, 1, 0, 0), (2018, 1, 1, 1), (2018, 1, 2, 2)],
                 "year int, fire_id long, sample_idx long, n_fire_pixels long")
    assert [r.sample_idx for r in P.keep_ignition(counts).collect()] == [0]
    assert [r.sample_idx for r in P.keep_burning(counts).collect()] == [2]


def _img(spark, n=4):
    rows = [(1, y, x, float(y * n + x), float((y * 37 + x * 11) % 360)) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "k long, y long, x long, v double, ang double")


def test_flip_twice_and_rotate_four_times_are_identity(spark):
    img = _img(spark)
    base = sorted(img.collect())
    twice = P.flip_h(P.flip_h(img, 4, ["ang"]), 4, ["ang"])
    assert sorted(twice.collect()) == base
    r = img
    for _ in range(4):
        r = P.rotate_90(r, 1, 4, ["ang"])
    assert sorted(r.collect()) == base
    vv = P.flip_v(P.flip_v(img, 4, ["ang"]), 4, ["ang"])
    assert sorted(vv.collect()) == base


def test_rotate_matches_numpy_rot90(spark):
    n = 5
    arr = np.arange(n * n, dtype=float).reshape(n, n)
    df = spark.createDataFrame([(y, x, float(arr[y, x])) for y in range(n) for x in range(n)], "y long, x long, v double")
    for k in range(4):
        got = np.zeros((n, n))
        for r in P.rotate_90(df, k, n).collect():
            got[r.y, r.x] = r.v
        assert (got == np.rot90(arr, k)).all()


def test_center_crop_is_subset_and_rounds_half_even(spark):
    img = _img(spark, 5)
    crop = P.center_crop(img, 2, 5, 5)                     # (5 - 2) / 2 = 1.5 -> 2
    vals = sorted(r.v for r in crop.collect())
    assert vals == [12.0, 13.0, 17.0, 18.0]


def test_tile_cover_last_tile_aligned_to_edge(spark):
    df = ntz(spark, [(y, 0) for y in range(10)], "y long, x long")
    got = {r.y: (r.tile_i, r.tile_y) for r in P.tile_cover(df, 10, 10, 4, 4).collect()}
    assert got[3] == (0, 3) and got[5] == (1, 1) and got[6] == (2, 0) and got[9] == (2, 3)


def test_fold_years_disjoint():
    rows = P.year_folds()
    folds = {}
    for f, y, s in rows:
        folds.setdefault(f, {}).setdefault(s, set()).add(y)
    assert len(folds) == 12
    for parts in folds.values():
        assert not (parts["train"] & parts["val"]) and not (parts["train"] & parts["test"]) and parts["val"] != parts["test"]
    ext = P.year_folds(extended=True)
    assert {y for f, y, s in ext if f == 0 and s == "train"} == {2016, 2017, 2022, 2023, 2018, 2019}


def test_locate_sample_out_of_range_raises(spark):
    per_fire = ntz(spark, [(2018, 1, 3, 0), (2018, 2, 2, 3)], "year int, fire_id long, n_samples long, offset long")
    ok = J.locate_sample(ntz(spark, [(4,), (-1,)], "global_idx long"), per_fire).collect()
    assert {(r.global_idx, r.fire_id, r.in_fire_idx) for r in ok} == {(4, 2, 1), (-1, 2, 1)}
    with pytest.raises(Exception):
        J.locate_sample(ntz(spark, [(5,)], "global_idx long"), per_fire).collect()


# ----------------------------------------------------------------- evaluation against brute force

def _lovasz_numpy(logits, labels):
    signs = 2 * labels - 1
    errors = 1 - logits * signs
    order = np.argsort(-errors, kind="stable")
    e, gt = errors[order], labels[order]
    gts = gt.sum()
    inter = gts - np.cumsum(gt)
    union = gts + np.cumsum(1 - gt)
    jac = 1 - inter / union
    jac[1:] = jac[1:] - jac[:-1]
    return float(np.dot(np.maximum(e, 0), jac))


def _ap_numpy(scores, labels):
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    ap, tp, fp, prev_r = 0.0, 0, 0, 0.0
    P_ = y.sum()
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        tp += y[i:j].sum()
        fp += (1 - y[i:j]).sum()
        r = tp / P_
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
        i = j
    return ap


def test_lovasz_and_average_precision_match_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 3000
    logits = rng.normal(0, 2, n).round(1)             # ties on purpose
    labels = (rng.uniform(size=n) < 0.3).astype(int)
    pdf = pd.DataFrame({"score": logits, "y": labels})
    df = spark.createDataFrame(pdf)
    assert E.lovasz_hinge(df).first().lovasz == pytest.approx(_lovasz_numpy(logits, labels), abs=1e-9)
    assert E.average_precision(df, buckets=7).first().average_precision == pytest.approx(_ap_numpy(logits, labels), abs=1e-9)


def test_pr_curve_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    s = rng.uniform(size=500).round(3)
    y = (rng.uniform(size=500) < 0.4).astype(int)
    got = {r.t_idx: (r.precision, r.recall) for r in E.pr_curve(spark.createDataFrame(pd.DataFrame({"score": s, "y": y}))).collect()}
    for i in range(100):
        t = i / 99.0
        pred = s >= t
        tp, fp = int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum())
        prec = tp / (tp + fp) if tp + fp else 1.0
        assert got[i] == (pytest.approx(prec), pytest.approx(tp / y.sum()))


def test_nearest_index_irregular_axis(spark):
    ax = J.IrregularAxis((0.0, 1.0, 3.0, 7.0))
    df = ntz(spark, [(0.5,), (0.4,), (2.0,), (2.1,), (5.0,), (7.0,), (7.5,), (-1.0,), (0.0,)], "v double")
    got = [r.i for r in df.select(J.nearest_index("v", ax).alias("i")).collect()]
    assert got == [0, 0, 1, 2, 2, 3, None, None, 0]


def test_projected_cell_truncates_toward_zero_below_origin(spark):
    # origin 6 km east of the projection centre: x = -6000 -> (x - xorig) / xcell = -0.5 -> 0
    spec = G.LambertSpec(33, 45, -97, 40, 6000.0, -6000.0, 12000, 12000, 3, 3)
    cells = ntz(spark, [(T0, 0, 0, 0, 2.5)], "time timestamp_ntz, lay int, row long, col long, pm25_tot double")
    obs = ntz(spark, [(1, 40.0, -97.0, T0)], "id long, lat double, lon double, time timestamp_ntz")
    assert J.sample_projected(obs, cells, spec).first().pm25_tot == 2.5


def test_verify_files_decision_table(spark):
    from ashgrid.operators.quality import verify_files
    import hashlib
    good = "abc"
    h = hashlib.md5(good.encode()).hexdigest()
    rows = [  # url, expected_bytes, manifest md5, etag -> expected status
        ("ok", 3, h, h, "valid"),
        ("size_wrong_tag_ok", 4, h, h, "valid"),            # data check fails, tag check passes
        ("both_fail", 4, h, "deadbeef", "invalid_data"),
        ("stale", 3, h, "0123abcd", "invalid_stale"),        # data ok, tag is a checksum but differs
        ("tag_not_checksum", 3, h, "W/\"x-1\"", "valid"),    # tag ignored, no staleness
        ("no_manifest_md5", 3, None, h, "invalid_stale"),
    ]
    manifest = spark.createDataFrame([r[:4] for r in rows], "url string, expected_bytes long, md5 string, etag string")
    files = spark.createDataFrame([(r[0], bytearray(good.encode())) for r in rows], "url string, content binary")
    got = {r.url: r.status for r in verify_files(manifest, files).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_missing_cycles_primary_then_fallback(spark):
    listing = ntz(spark, [("https://p/hrrr/hrrr.20240101/conus/hrrr.t00z.wrfprsf00.grib2",),
                          ("https://f/hrrr/hrrr.20240101/conus/hrrr.t01z.wrfprsf00.grib2",)], "url string")
    out = J.missing_cycles(listing, dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 3),
                           primary_base="https://p/hrrr", fallback_base="https://f/hrrr").collect()
    assert [r.cycle.hour for r in out] == [2, 3]
    assert out[0].n_cycles == 4 and out[0].n_missing == 2


def test_header_array_rows_drop_non_numeric_time(spark):
    from ashgrid.sources.files import rows_from_header_array
    doc = '[["time","pm25"],["0","2e-9"],["x","1e-9"],["3600000","4e-9"]]'
    got = rows_from_header_array(ntz(spark, [(doc,)], "doc string")).collect()
    assert [(r.row_idx, r.time, round(r.pm25, 9)) for r in got] == [
        (0, dt.datetime(1970, 1, 1, 0), 2.0), (2, dt.datetime(1970, 1, 1, 1), 4.0)]


def test_parse_date_hour_ignores_session_zone_and_dst(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = ntz(spark, [("2024-03-10", "02:00"), ("2024-01-31", "24:00"), ("2024-02-30", "01:00"), ("2024-01-01", "7"),
                         ("2024-01-01", "7h"), ("2024-01-01", "31")],
                 "d string, t string")
        got = [r.ts for r in df.select(C.parse_date_hour("d", "t").alias("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [dt.datetime(2024, 3, 10, 2), dt.datetime(2024, 2, 1, 0), None, dt.datetime(2024, 1, 1, 7), None, None]


def test_try_parse_ntz(spark):
    df = ntz(spark, [("2024-07-04 13:05:09",), ("2024-07-04",), ("2024-07-04T01:02",), ("2024-13-01",), ("nope",), (None,)], "s string")
    got = [r.t for r in df.select(C.try_parse_ntz("s").alias("t")).collect()]
    assert got == [dt.datetime(2024, 7, 4, 13, 5, 9), dt.datetime(2024, 7, 4), dt.datetime(2024, 7, 4, 1, 2), None, None, None]


def test_bilinear_with_a_missing_cell_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    cells = spark.createDataFrame([(i, j, float(rng.normal())) for i in range(6) for j in range(7) if (i, j) != (3, 3)],
                                  "y long, x long, v double")
    pts = spark.createDataFrame([(k, float(rng.uniform(9.9, 12.6)), float(rng.uniform(-5.1, -1.9))) for k in range(300)]
                                + [(1000, 11.5, -3.5), (1001, 10.0, -5.0)], "id long, lat double, lon double")
    ay, ax = J.RegularAxis(10.0, 0.5, 6), J.RegularAxis(-5.0, 0.5, 7)
    a = {r.id: r.v for r in J.sample_linear(pts, cells, ay, ax, "v").collect()}
    grid = {(r.y, r.x): r.v for r in cells.collect()}
    assert len(a) == 302
    for r in pts.collect():
        y0, x0 = math.floor((r.lat - 10) / 0.5), math.floor((r.lon + 5) / 0.5)
        fy, fx = (r.lat - 10) / 0.5 - y0, (r.lon + 5) / 0.5 - x0
        parts = [((1 - fy if dy == 0 else fy) * (1 - fx if dx == 0 else fx), grid.get((y0 + dy, x0 + dx)))
                 for dy in (0, 1) for dx in (0, 1)]
        parts = [(w, v) for w, v in parts if w > 0]
        outside = not (10 <= r.lat <= 12.5 and -5 <= r.lon <= -2)
        want = None if outside or any(v is None for _, v in parts) else sum(w * v for w, v in parts)
        assert (a[r.id] is None and want is None) or a[r.id] == pytest.approx(want, abs=1e-12), r
    assert a[1000] is None and a[1001] is not None        # needs the missing (3, 3) cell / exact corner


def test_calendar_windows_half_open(spark):
    # January 2024: Sundays are the 7th, 14th, 21st, 28th; window [Sunday, Sunday + 1 day)
    rows = [(1, dt.datetime(2024, 1, 7, 0, 0)), (2, dt.datetime(2024, 1, 7, 23, 59)), (3, dt.datetime(2024, 1, 8, 0, 0)),
            (4, dt.datetime(2024, 1, 6, 23, 0)), (5, dt.datetime(2024, 1, 28, 12)), (6, dt.datetime(2024, 2, 4, 1))]
    f = ntz(spark, rows, "fire_id long, idate timestamp_ntz")
    got = sorted(r.fire_id for r in J.in_calendar_windows(f, "2024-01-01", "2024-01-31", 1.0).collect())
    assert got == [1, 2, 5]                     # the 4 Feb Sunday is after the last anchor


def test_zero_pad_puts_extra_row_bottom_right(spark):
    img = spark.createDataFrame([(1, y, x, 1.0) for y in range(5) for x in range(5)], "k long, y long, x long, v double")
    out = {(r.y, r.x): r.v for r in P.zero_pad(img, 5, 5, 8, ["k"], ["v"]).collect()}
    assert len(out) == 64 and out[(1, 1)] == 1.0 and out[(5, 5)] == 1.0
    assert out[(0, 0)] == 0 and out[(6, 6)] == 0 and out[(7, 7)] == 0


def test_nearest_in_time_tolerance_is_inclusive(spark):
    fires = ntz(spark, [(1, T0), (2, T0)], "fire_id long, idate timestamp_ntz")
    daily = ntz(spark, [(1, T0 + dt.timedelta(hours=24), 1.0, 2.0, 1), (2, T0 - dt.timedelta(hours=24, seconds=1), 3.0, 4.0, 2),
                        (1, T0 + dt.timedelta(hours=30), 9.0, 9.0, 3)],
                "fire_id long, time timestamp_ntz, lat double, lon double, event_id long")
    got = {r.fire_id: (r.lat, r.lon) for r in J.nearest_in_time(fires, daily, tie="event_id").collect()}
    assert got == {1: (1.0, 2.0), 2: (None, None)}


def test_list_files_feeds_the_inventory(spark, tmp_path):
    from ashgrid.sources.files import list_files
    for rel in ["2019/fire_7/2019-08-01.tif", "2019/fire_7/2019-08-03.tif", "2019/fire_7/notes.txt", "2020/fire_9/x.tif"]:
        f = tmp_path / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"\\x00" * 10)
    files = list_files(spark, str(tmp_path))
    assert files.count() == 3
    inv = {r.fire_id: (r.n_images, r.first_date) for r in P.stack_inventory(files).collect()}
    assert inv == {7: (2, dt.date(2019, 8, 1))}            # x.tif has no date and is skipped


def test_flatten_time_width(spark):
    rows = [(2018, 1, 0, lag, 0, 0, float(lag), float(10 + lag), 3.0) for lag in range(4)]
    sp = spark.createDataFrame(rows, "year int, fire_id long, sample_idx long, lag long, y long, x long, a double, b double, s double")
    out = P.flatten_time(sp, 3, ["a", "b"], ["s"])
    feats = [c for c in out.columns if c not in ("year", "fire_id", "sample_idx", "y", "x")]
    assert len(feats) == 2 * (3 - 1) + 2 + 1                     # dyn * (T - 1) + dyn + static
    r = out.first()
    assert (r.a_t0, r.b_t1, r.a_t2, r.s_t2) == (0.0, 11.0, 2.0, 3.0)   # lag 3 (the label) is not an input


def test_histogram_of_constant_values(spark):
    df = ntz(spark, [(4.0,), (4.0,)], "v double")
    h = {r.bin: r.n for r in A.histogram(df, "v", 3).collect()}
    assert h == {0: 0, 1: 2, 2: 0}                  # range widened to [3.5, 4.5] as a histogram does


def test_density_of_constant_values_is_null_not_an_error(spark):
    df = ntz(spark, [(4.0,), (4.0,)], "v double")
    assert all(r.density is None for r in A.density(df, "v", 5).collect())


def test_irregular_axis_bisection_equals_a_scan(spark):
    import bisect
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 64, 1000):
        axis = J.IrregularAxis(tuple(sorted(set(rng.uniform(-90, 90, n).round(2).tolist()))))
        a = axis.values
        v = [*rng.uniform(-95, 95, 200).tolist(), *a[:50], a[-1], *[(x + y) / 2 for x, y in zip(a[:40], a[1:])], None]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
        low, frac = J.lower_index("v", axis)
        for r in df.select("v", J.nearest_index("v", axis).alias("near"), low.alias("low"), frac.alias("frac")).collect():
            if r.v is None or not a[0] <= r.v <= a[-1]:
                assert (r.near, r.low, r.frac) == (None, None, None)
                continue
            k = bisect.bisect_right(a, r.v) - 1
            assert r.low == k and r.frac == (0 if r.v == a[k] else pytest.approx((r.v - a[k]) / (a[k + 1] - a[k])))
            assert r.near == (k if k + 1 == len(a) or r.v - a[k] <= a[k + 1] - r.v else k + 1)
