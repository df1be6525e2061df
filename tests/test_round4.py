"""Findings of round 4: work per fire without stored pairs, matched pairs as text, copies of readings."""

import datetime as dt
import gzip
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ashgrid.operators import aggregates as A
from ashgrid.operators import joins as J
from ashgrid.sources import files as SRC

T0 = dt.datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _case(spark):
    rng = np.random.default_rng(12)
    n = 2500
    obs = [(i, 30 + int(rng.integers(0, 10)) * 0.5, -110 + int(rng.integers(0, 10)) * 0.5, T0 + dt.timedelta(hours=int(rng.integers(0, 1500))),
            float(rng.integers(0, 40)), None if i % 11 == 0 else float(rng.integers(0, 40))) for i in range(n)]
    obs += [obs[1], (9001, None, -109.0, T0, 9.0, 9.0), (9002, 31.0, float("nan"), T0, 9.0, 9.0), (9003, 31.0, -109.0, None, 9.0, 9.0),
            (9004, 31.0, -109.0, T0, float("nan"), 9.0), (9005, 31.0, -109.0, T0, 1000.0, 2.0)]
    fires = [(i, 30 + int(rng.integers(0, 20)) * 0.25, -110 + int(rng.integers(0, 20)) * 0.25, s := T0 + dt.timedelta(minutes=int(rng.integers(-9000, 70000))),
              s + dt.timedelta(hours=int(rng.integers(0, 200 if i % 9 else 1400)))) for i in range(150)]
    # one key of far places and of twice the same row; reversed, incomplete, without a key
    fires += [(3, 34.0, -106.0, T0, T0 + dt.timedelta(days=60)), fires[5], (201, 31.0, -109.0, T0 + dt.timedelta(days=9), T0),
              (202, None, -109.0, T0, T0), (203, 31.0, -109.0, None, T0), (None, 31.0, -109.0, T0, T0 + dt.timedelta(days=30))]
    odf = spark.createDataFrame(obs, "event_id long, lat double, lon double, time timestamp_ntz, pm25 double, est_a double")
    fdf = spark.createDataFrame(fires, "fire_id long, lat double, lon double, idate timestamp_ntz, fdate timestamp_ntz")
    pairs = [(f[0], o) for o in obs for f in fires if None not in (o[1], o[3], *f[1:]) and abs(o[1] - f[1]) < 1 and abs(o[2] - f[2]) < 1 and f[3] <= o[3] <= f[4]]
    return odf, fdf, pairs


def test_f1_agreement_per_fire_makes_its_pairs_where_they_are_used(spark, monkeypatch):
    obs, fires, pairs = _case(spark)
    valid = pd.DataFrame([(-1 if k is None else k, o[1], o[2], o[4], o[5]) for k, o in pairs if o[5] is not None and 2 <= o[4] <= 1000 and 2 <= o[5] <= 1000],
                         columns=["k", "lat", "lon", "t", "e"])
    of_groups = A.rank_correlation_of_groups
    monkeypatch.setattr(A, "rank_correlation_of_groups", None)  # shuffles the pairs
    whole = A.agreement_by(J.obs_near_fire(obs, fires, 1.0, together=True), "pm25", "est_a", ["fire_id"])
    monkeypatch.setattr(A, "rank_correlation_of_groups", of_groups)
    some_large = A.agreement_by(J.obs_near_fire(obs, fires, 1.0, together=True), "pm25", "est_a", ["fire_id"], most=60)
    rows = A.agreement_by(J.obs_near_fire(obs, fires, 1.0), "pm25", "est_a", ["fire_id"])
    assert whole.columns == some_large.columns == rows.columns == ["fire_id", *A.METRIC_COLUMNS]
    for out in (whole, some_large, rows):
        got = {-1 if r.fire_id is None else r.fire_id: r for r in out.collect()}
        assert len(got) == out.count() == valid.k.nunique() > 100
        for k, g in valid.groupby("k"):
            r = got[k]
            assert (r.n, r.stations) == (len(g), len(g[["lat", "lon"]].drop_duplicates()))
            varies = min(g.t.nunique(), g.e.nunique()) > 1
            want = {"pearson": g.t.corr(g.e) if varies else None, "log_pearson": np.log(g.t).corr(np.log(g.e)) if varies else None,
                    "spearman": g.t.rank().corr(g.e.rank()) if varies and k != -1 else None, "rmse": math.sqrt(((g.t - g.e) ** 2).mean()), "bias": (g.t - g.e).mean(),
                    "slope": np.polyfit(g.e, g.t, 1)[0] if g.e.nunique() > 1 else None}
            for c, v in want.items():
                assert r[c] == (None if v is None else pytest.approx(v, abs=1e-8)), (k, c)


def test_f1_held_rows_are_those_of_a_few_groups():
    import pyarrow as pa

    from ashgrid.operators import ranks as R
    sizes = [5, 300_000, 7, 200_000, 1]
    key = np.repeat(np.arange(len(sizes)), sizes)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i:i + 4096])], ["k"]) for i in range(0, len(key), 4096)]
    seen = [(t.column("k").to_numpy(), new) for t, new in R._whole_groups(iter(batches), ["k"], most=250_000)]
    assert [k.tolist() for k, new in seen if new is None] == [[1]] and max(len(k) for k, _ in seen) < 350_000
    whole = np.concatenate([k for k, new in seen if new is not None])
    assert np.bincount(whole).tolist() == [5, 0, 7, 200_000, 1]
    assert sum(new.sum() for _, new in seen if new is not None) == 4


def test_f1_pairs_of_a_fire_are_never_shuffled(spark):
    obs, fires, pairs = _case(spark)
    m = J.obs_near_fire(obs, fires, 1.0, together=True)
    from pyspark.sql import types as T

    def each(batches):
        for b in batches:
            yield b.select(["fire_id", "event_id"])

    out = m.each(each, T.StructType([m.fires.schema["fire_id"], obs.schema["event_id"]]), ["event_id"])
    assert plan(out).split("MapInArrow")[0].count("Exchange") == 0 and plan(out).count("MapInArrow") == 1
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((k, o[0]) for k, o in pairs), key=key)
    # all pairs of a fire in one partition
    spread = out.withColumn("p", F.spark_partition_id()).groupBy("fire_id").agg(F.count_distinct("p").alias("p"))
    assert spread.filter("p > 1").isEmpty()
    some = m.rows(spark.createDataFrame([(3,), (None,)], "fire_id long"))
    assert {r.fire_id for r in some.select("fire_id").distinct().collect()} == {3, None}


def test_f2_matched_pairs_are_dealt_to_tasks_and_files_of_bounded_length(spark, tmp_path):
    obs, fires, pairs = _case(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst")}
    m = J.obs_near_fire(obs, fires, 1.0).select(
        F.concat(F.lit("fire_"), F.col("fire_id").cast("string")).alias("fire_name"), F.col("event_id").alias("sensor_id"), F.col("event_id").alias("sat_id"), "lat", "lon", "time",
        F.col("pm25").alias("sensor_pm25"), F.col("est_a").alias("sat_pm25"))
    SRC.write_matched_csv(m, f"{tmp_path}/out", compression="gzip", rows_per_file=500)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    lines = [gzip.decompress(p.read_bytes()).decode().splitlines() for p in parts]
    assert all(x[0] == ",".join(SRC.MATCHED_COLUMNS) and len(x) <= 501 for x in lines) and len(parts) >= len(pairs) // 500 > 5
    got = [(x.split(",")[0], int(x.split(",")[1])) for part in lines for x in part[1:]]
    assert sorted(got) == sorted(("fire_%d" % k if k is not None else "", o[0]) for k, o in pairs)
    assert before == {k: spark.conf.get(k) for k in before}


def test_f3_fires_are_merged_with_the_places_not_broadcast(spark):
    obs, fires, pairs = _case(spark)
    counted = J.covering_fires(obs, fires, 1.0, strict_box="abs")
    for p in (plan(counted), plan(J.obs_within_fire_box(obs, fires)), plan(J.obs_near_fire(obs, fires))):
        joins = [x for x in p.splitlines() if "Join" in x and "_cy" in x]
        assert len(joins) == 1 and "SortMergeJoin" in joins[0]
    want = {}
    for _, o in pairs:
        want[o[0]] = want.get(o[0], 0) + 1
    got = {r.event_id: r.n for r in counted.groupBy("event_id").agg(F.sum("n_fires").alias("n")).collect()}
    assert got == want
