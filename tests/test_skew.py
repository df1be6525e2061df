"""A third of all rows on one key: results stay whole and exact (SURVEY scale rules)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ashgrid.operators import aggregates as A
from ashgrid.operators import joins as J

T0 = dt.datetime(2024, 1, 1)


def _skewed(n=6000, seed=4):
    rng = np.random.default_rng(seed)
    station = np.where(rng.uniform(size=n) < 1 / 3, 0, rng.integers(1, 60, n))
    lat = 30 + (station % 10) * 0.5
    lon = -110 + (station // 10) * 0.5
    truth = rng.gamma(2, 10, n).round(1)
    truth[station == 0] = 25.0                     # the hot station also repeats one value
    est = (truth * 0.8 + rng.normal(0, 3, n)).round(1)
    hours = rng.integers(0, 24 * 20, n)
    return pd.DataFrame({"event_id": np.arange(n), "lat": lat, "lon": lon, "truth": truth, "est": est,
                         "time": [T0 + dt.timedelta(hours=int(h)) for h in hours]})


def test_agreement_exact_under_hot_station(spark):
    pdf = _skewed()
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    r = A.agreement(df, "truth", ["est"], 2, 1000, buckets=16).first()
    v = pdf[(pdf.truth.between(2, 1000)) & (pdf.est.between(2, 1000))]
    assert r.n == len(v)
    assert r.pearson == pytest.approx(v.truth.corr(v.est), abs=1e-9)
    assert r.spearman == pytest.approx(v.truth.rank().corr(v.est.rank()), abs=1e-9)
    assert r.stations == len(v[["lat", "lon"]].drop_duplicates())


def test_box_join_exact_under_hot_cell(spark):
    pdf = _skewed()
    fires = pd.DataFrame({"fire_id": [1, 2, 3], "lat": [30.2, 31.0, 33.1], "lon": [-109.8, -108.9, -107.2],
                          "idate": [T0, T0 + dt.timedelta(days=3), T0], "fdate": [T0 + dt.timedelta(days=10)] * 3})
    obs = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    fdf = spark.createDataFrame(fires).withColumns({"idate": F.col("idate").cast("timestamp_ntz"),
                                                    "fdate": F.col("fdate").cast("timestamp_ntz")})
    got = sorted((r.event_id, r.fire_id) for r in J.obs_near_fire(obs, fdf, 1.0).collect())
    exp = sorted((int(o.event_id), int(f.fire_id)) for o in pdf.itertuples() for f in fires.itertuples()
                 if abs(o.lat - f.lat) < 1 and abs(o.lon - f.lon) < 1 and f.idate <= o.time <= f.fdate)
    assert got == exp and len(got) > 1000


def _fire_table(spark, rows):
    return spark.createDataFrame(rows, "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")


def _covered_by_hand(obs, fires, half):
    return {o.event_id: n for o in obs.itertuples() if (n := sum(
        f[2] - half < o.lon < f[2] + half and f[1] - half < o.lat < f[1] + half and f[3] <= o.time <= f[4] for f in fires))}


def test_covering_fires_match_brute_force_under_a_hot_station(spark):
    rng = np.random.default_rng(9)
    pdf = _skewed()
    # period edges, boxes on the stations' lattice (their sides are excluded), instants within a day, null and reversed periods
    fires = [(i, 30 + int(rng.integers(0, 21)) * 0.25, -110 + int(rng.integers(0, 25)) * 0.25, s := T0 + dt.timedelta(hours=int(rng.integers(-200, 480))),
              s + dt.timedelta(hours=int(rng.integers(0, 400)), microseconds=int(rng.integers(0, 2)))) for i in range(150)]
    fires += [(200, 31.0, -109.0, T0 + dt.timedelta(hours=7), T0 + dt.timedelta(hours=7)), (201, 31.0, -109.0, T0 + dt.timedelta(days=9), T0)]
    obs = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    expected = _covered_by_hand(pdf, fires, 1.0)
    got = J.covering_fires(obs, _fire_table(spark, fires), 1.0)
    assert {r.event_id: r.n_fires for r in got.collect()} == expected and max(expected.values()) > 8
    twice = J.covering_fires(obs.unionByName(obs), _fire_table(spark, fires), 1.0).groupBy("event_id").count().filter("count <> 2").count()
    assert twice == 0
    copies = J.obs_within_fire_box(obs, _fire_table(spark, fires), 1.0)
    assert copies.columns == obs.columns
    assert {r.event_id: r["count"] for r in copies.groupBy("event_id").count().collect()} == expected
    odd = spark.createDataFrame([(1, None, -109.0, 5.0, 5.0, T0), (2, 31.0, float("nan"), 5.0, 5.0, T0), (3, 31.0, -109.0, 5.0, 5.0, None)],
                                "event_id long, lat double, lon double, truth double, est double, time timestamp_ntz")
    assert J.covering_fires(odd, _fire_table(spark, fires), 1.0).count() == 0
    assert J.covering_fires(obs, _fire_table(spark, []), 1.0).count() == 0


def test_weighted_agreement_equals_agreement_of_copies(spark):
    pdf = _skewed(2000).assign(n=np.random.default_rng(1).integers(1, 9, 2000))
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    copies = spark.createDataFrame(pdf.loc[pdf.index.repeat(pdf.n)]).withColumn("time", F.col("time").cast("timestamp_ntz"))
    a = A.agreement(df, "truth", ["est"], 2, 1000, weight="n").first()
    b = A.agreement(copies, "truth", ["est"], 2, 1000).first()
    for c in A.METRIC_COLUMNS:
        assert a[c] == pytest.approx(b[c], abs=1e-9), c
    flat = df.withColumns({"truth": F.lit(7.1), "est": F.lit(7.3)})
    r = A.agreement(flat, "truth", ["est"], 2, 1000, weight="n").first()
    assert r.pearson is None and r.slope is None and r.spearman is None and r.rmse == pytest.approx(0.2)


def test_nearest_in_time_is_one_sorted_merge_under_a_hot_id(spark):
    rng = np.random.default_rng(5)
    n = 30_000
    # two thirds of the records belong to fire 0; times repeat, gaps exceed the tolerance
    rec = pd.DataFrame({"fire_id": np.where(rng.uniform(size=n) < 2 / 3, 0, rng.integers(1, 40, n)), "event_id": rng.permutation(n),
                        "s": np.where(rng.uniform(size=n) < 0.5, rng.integers(0, 40_000, n), rng.integers(2_000_000, 9_000_000, n))})
    rec["lat"], rec["lon"] = rec.event_id * 0.5, rec.event_id * 2.0
    fires = pd.DataFrame({"fire_id": np.r_[np.zeros(300, int), rng.integers(0, 45, 300)], "s": rng.integers(-100_000, 9_200_000, 600), "row": range(600)})
    stamp = lambda d: d.assign(t=[T0 + dt.timedelta(seconds=int(x)) for x in d.s])
    sd = lambda d, c: spark.createDataFrame(stamp(d).drop(columns="s")).withColumn("t", F.col("t").cast("timestamp_ntz")).withColumnRenamed("t", c)
    out = J.nearest_in_time(sd(fires, "idate"), sd(rec, "time"), tie="event_id")
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in p and sum("Join" in line for line in p.splitlines()) == 1  # only the fires get their record back
    got = {r.row: (r.lat, r.lon) for r in out.collect()}
    assert len(got) == 600
    by_id = {k: g for k, g in rec.groupby("fire_id")}
    for f in fires.itertuples():
        g = by_id.get(f.fire_id)
        want = (None, None)
        if g is not None:
            d = (g.s - f.s).abs()
            best = g.assign(d=d).sort_values(["d", "s", "event_id"]).iloc[0]
            want = (best.lat, best.lon) if best.d <= 86400 else want
        assert got[f.row] == want, f
    none = J.nearest_in_time(sd(fires, "idate"), sd(rec, "time").limit(0), tie="event_id")
    assert none.filter("lat is not null").count() == 0 and none.count() == 600
