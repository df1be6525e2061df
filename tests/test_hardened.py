"""Inputs beyond the plain fixtures: polygons, channel rules, weighted fit, ragged rows, NaN in readers."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ashgrid.operators import evaluate as E
from ashgrid.operators import geometry as GEO
from ashgrid.operators import pixels as P
from ashgrid.operators import training as TR
from ashgrid.sources import files as SRC

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]


def ring(*pts):
    return [{"lon": float(x), "lat": float(y)} for x, y in pts]


def test_polygon_meets_region_in_every_way(spark):
    cases = {
        "vertex inside": (ring((9, 9), (12, 9), (12, 12), (9, 12), (9, 9)), True),
        "edges cross, no vertex inside": (ring((-1, 4), (11, 4), (11, 6), (-1, 6), (-1, 4)), True),
        "region inside the polygon": (ring((-5, -5), (20, -5), (20, 20), (-5, 20), (-5, -5)), True),
        "polygon inside the region": (ring((4, 4), (5, 4), (5, 5), (4, 5), (4, 4)), True),
        "apart, boxes overlap": (ring((9, 12), (14, 5), (14, 12), (9, 12)), False),
        "far away": (ring((50, 50), (51, 50), (51, 51), (50, 50)), False),
    }
    df = spark.createDataFrame([(k, r) for k, (r, _) in cases.items()], "name string, ring array<struct<lon: double, lat: double>>")
    got = {r["name"] for r in GEO.polygons_in_region(df, ring=SQUARE).collect()}
    assert got == {k for k, (_, want) in cases.items() if want}


def test_channel_rules():
    assert TR.CHANNELS == 40 and len(TR.STATIC_CHANNELS) == 20 and len(TR.DYNAMIC_CHANNELS) == 20
    assert TR.feature_count(5) == 20 * 4 + 40 and TR.feature_count(5, flatten=False) == 40
    assert TR.kept_channels([39, 3, 12, 16]) == ([12, 16], [3, 39])
    assert TR.feature_count(3, [39, 3, 12, 16]) == 2 * 2 + 4


def test_crop_is_cut_from_the_pixels(spark):
    px = spark.range(100).selectExpr("2020 as year", "1 as fire_id", "0 as sample_idx", "id div 10 as y", "id % 10 as x", "id as v")
    crop = spark.createDataFrame([(2020, 1, 0, 3, 6)], "year int, fire_id int, sample_idx int, top long, left long")
    got = {(r.y, r.x): r.v for r in TR.apply_crop(px, crop, 4).collect()}
    assert got == {(y, x): (y + 3) * 10 + x + 6 for y in range(4) for x in range(4)}


def test_weighted_fit_is_stationary(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    y = (rng.random(600) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 2)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "n_a double, n_b double, label double")
    _, model = P.train_fire_classifier(df, ["n_a", "n_b"], "label", pos_weight=6.5, max_iter=200)
    w = np.where(y == 1, 6.5, 1.0)
    p = 1 / (1 + np.exp(-(x @ model.coefficients.toArray() + model.intercept)))
    gradient = np.r_[(w * (p - y)) @ x, (w * (p - y)).sum()] / w.sum()
    assert np.abs(gradient).max() < 1e-4


def test_sigmoid_maps_logits(spark):
    got = [r.p for r in spark.createDataFrame([(-2.0,), (0.0,), (3.0,)], "z double").select(E.sigmoid("z").alias("p")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(2)), 0.5, 1 / (1 + math.exp(-3))])


def test_readers_turn_nan_into_null(spark):
    folder = tempfile.mkdtemp(prefix="ashgrid-nan-")
    with open(f"{folder}/a.csv", "w") as f:
        f.write("State Code,County Code,Site Num,Latitude,Longitude,Date GMT,Time GMT,Sample Measurement\n"
                "1,2,3,NaN,-100.0,2024-01-01,5,NaN\n")
    r = SRC.read_sensor_files(spark, folder).first()
    assert r["Latitude"] is None and r["Sample Measurement"] is None and r["Longitude"] == -100.0


def test_ragged_rows_do_not_fail_the_job(spark):
    doc = '[["time", "pm25"], ["1704067200000", "1e-9"], ["1704067200000"], ["x", "1"], ["1", "2", "3"]]'
    df = spark.createDataFrame([(doc,)], "doc string")
    assert [r.row_idx for r in SRC.rows_from_header_array(df).collect()] == [0]
    kept = SRC.rows_from_header_array(df, keep_ragged=True).collect()
    assert sorted((r.row_idx, r.reason) for r in kept) == [(0, None), (1, "ragged"), (3, "ragged")]


def test_every_fold_has_the_weight_of_its_own_training_years(spark):
    """The weight of each fold by hand: pixels over detections in the fold's two training years, times the loss."""
    import numpy as np
    import __spark_entry__ as entry
    from conftest import SF0001
    from ashgrid.plans.pixel_queries import sample_pixels
    from ashgrid.sources.fixtures import raster
    px = raster(spark, SF0001).select("year", "b22").toPandas()
    sp = sample_pixels(spark, SF0001).filter("lag >= 1").select("year", "fire_id", "sample_idx", "y", "x", "lag", "af_hh", "af_mask").toPandas()
    key = ["year", "fire_id", "sample_idx", "y", "x"]
    t = sp[sp.lag == 1].set_index(key).af_hh.to_frame("hh").join(sp[sp.lag == 2].set_index(key).af_mask.rename("label"), how="outer").fillna(0).reset_index()
    want = {}
    for fold in range(12):
        years = {y: split for f, y, split in P.year_folds() if f == fold}
        train = px[px.year.map(years).eq("train")]
        weight = len(train) / train.b22.notna().sum()
        s = t[t.year.map(years).eq("test")]
        x, y = (s.hh - 6) / 6.0, s.label
        want[fold] = (weight * y * np.log1p(np.exp(-x)) + (1 - y) * np.log1p(np.exp(x))).mean()
    got = {r.fold: r.bce for r in entry.queries()["fold_scores"](spark, SF0001).collect()}
    assert set(got) == set(range(12)) and len(set(want.values())) > 4
    for fold in want:
        assert got[fold] == pytest.approx(want[fold], abs=2e-6), fold


def test_persistence_scores_of_all_folds(spark):
    from conftest import SF0001
    from ashgrid.plans.jobs import persistence_scores
    from ashgrid.sources.fixtures import raster
    r, folds = raster(spark, SF0001), P.fold_table(spark)
    every = {(x.fold, x.split): tuple(x)[2:] for x in persistence_scores(r, 2, 1, folds, None).collect()}
    assert {k for k, _ in every} == set(range(12))
    for fold in (0, 7):
        one = {(fold, x.split): tuple(x)[1:] for x in persistence_scores(r, 2, 1, folds, fold).collect()}
        assert one == {k: v for k, v in every.items() if k[0] == fold}


def test_fire_stacks_are_written_once_and_replaced_whole(spark):
    import datetime as dt
    import os
    import tempfile
    day = lambda d: dt.date(2024, 1, d)
    rows = [(2018, 1, day(1), 0, 1, 1.5, 2.0), (2018, 1, day(1), 0, 0, 0.5, None), (2018, 1, day(2), 3, 3, 9.0, 1.0), (2019, 2, day(1), 0, 0, 7.0, None)]
    schema = "year int, fire_id long, obs_date date, y long, x long, b0 double, b22 double"
    px = spark.createDataFrame(rows, schema)
    path = tempfile.mkdtemp(prefix="ashgrid-stacks-") + "/fires"
    P.write_fire_stacks(px.filter("fire_id = 1"), path, ["b0", "b22"], 4)
    first = sorted(os.listdir(f"{path}/year=2018/fire_id=1"))
    P.write_fire_stacks(px, path, ["b0", "b22"], 4)
    assert sorted(os.listdir(f"{path}/year=2018/fire_id=1")) == first  # the written fire is left alone
    got = sorted((r.year, r.fire_id, r.obs_date, r.pixel, r.b0, r.b22) for r in spark.read.parquet(path).collect())
    assert got == [(2018, 1, day(1), [0, 1], [0.5, 1.5], [None, 2.0]), (2018, 1, day(2), [15], [9.0], [1.0]), (2019, 2, day(1), [0], [7.0], [None])]
    P.write_fire_stacks(px.filter("fire_id = 1").withColumn("b0", F.lit(4.0)), path, ["b0", "b22"], 4, rewrite=True)
    got = {(r.fire_id, r.obs_date): r.b0 for r in spark.read.parquet(path).collect()}
    assert got == {(1, day(1)): [4.0, 4.0], (1, day(2)): [4.0], (2, day(1)): [7.0]}
    P.write_fire_stacks(px.limit(0), path, ["b0", "b22"], 4)
    assert spark.read.parquet(path).count() == 3
