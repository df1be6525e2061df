"""Substrings through bits, kernel sums from bins, digests in blocks, split listings, Newton fit: against brute force."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from ashgrid.operators import aggregates as A
from ashgrid.operators import joins as J
from ashgrid.operators.logistic import newton_fit
from ashgrid.operators.quality import verify_files
from ashgrid.operators.substrings import possible_keys
from ashgrid.sources.digests import file_digests
from ashgrid.sources.files import nested_listing_to_fire_dates
from ashgrid.sources.listing import listing_files_to_fire_dates, tree_files


def test_first_name_that_contains_the_key(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé\U0001f525"), n))
    names = [word(rng.integers(0, 30)) for _ in range(300)] + ["", None]
    keys = [*{word(rng.integers(1, 9)) for _ in range(60)}, "", "zz", None]
    items = spark.createDataFrame([(k,) for k in keys], "fire_key string")
    dirs = spark.createDataFrame([(n,) for n in names], "dir_name string")
    order = lambda n: n.encode()
    want = {k: min((n for n in names if n is not None and k is not None and k in n), key=order, default=None) for k in keys}
    for bits in (64, 1 << 16):  # a full table costs more and finds the same
        got = {r.fire_key: r.dir_name for r in J.match_by_substring(items, dirs, bits=bits).collect()}
        assert got == want


def test_only_possible_keys_leave_a_name(spark):
    names = spark.range(400).select(F.sha2(F.col("id").cast("string"), 512).alias("n"))
    keys = spark.range(50).select(F.substring(F.sha2(F.col("id").cast("string"), 512), 20, 12).alias("k"))
    assert possible_keys(names, keys).count() == 50  # of 400 x 117 substrings


def test_density_equals_the_plain_kernel_sum(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=400), rng.normal(50, 0.1, 50), [1000.0]])
    got = A.density(spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double"), "v", 60).collect()
    bw = v.std(ddof=1) * len(v) ** -0.2
    x = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 60)
    want = np.exp(-0.5 * ((x[:, None] - v) / bw) ** 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
    assert np.allclose([r.x for r in got], x)
    assert np.abs(np.array([r.density for r in got]) - want).max() < 1e-10 / bw


def test_density_of_no_values_is_empty(spark):
    assert A.density(spark.createDataFrame([], "v double"), "v", 5).count() == 0


def test_digests_of_files_larger_than_a_block(spark, tmp_path):
    want = {}
    for k, n in enumerate([0, 1, 4096, 100_000]):
        f = tmp_path / f"d{k}" / f"f{k}.bin"
        f.parent.mkdir()
        f.write_bytes(bytes(i * 31 % 251 for i in range(n)))
        want[f"d{k}/f{k}.bin"] = (n, hashlib.md5(f.read_bytes()).hexdigest())
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    (tmp_path / "other.txt").write_bytes(b"x")
    d = file_digests(spark, str(tmp_path), "*.bin", block_bytes=4096, task_bytes=5000)
    assert {r.path: (r.length, r.md5) for r in d.collect()} == want
    assert d.rdd.getNumPartitions() == 2  # what fits one task, and the large file
    m = d.select("path", F.col("length").alias("expected_bytes"), "md5", F.lit(None).cast("string").alias("etag"))
    assert {r.status for r in verify_files(m, d.withColumnRenamed("md5", "h"), key="path", measured=("length", "h")).collect()} == {"valid"}
    assert file_digests(spark, str(tmp_path), "*.none").count() == 0


def test_listing_split_anywhere_equals_the_nested_form(spark, tmp_path):
    xml = '<?xml version="1.0"?><tree><directory name="."><directory name="empty"/>'
    for year in (2018, 2019):
        xml += f'<directory name="{year}">' + "".join(
            f"<directory name='fire_{f}'>" + "".join(f'<file name="{year}-0{m}-1{f % 10}.tif"></file>' for m in range(1, 8)) +
            '<file name="notes&amp;more.txt"/></directory>' for f in range(20)) + "<directory name='other'><file name='2018-01-01.tif'/></directory></directory>"
    xml += "</directory><report><directories>42</directories></report></tree>"
    (tmp_path / "a.xml").write_text(xml)
    (tmp_path / "b.xml").write_text(xml.replace("-01-", "-12-"))
    docs = spark.createDataFrame([(xml.split("?>")[1],), (xml.replace("-01-", "-12-").split("?>")[1],)], "xml string")
    want = sorted(tuple(r) for r in nested_listing_to_fire_dates(docs).collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("300", "5000", "1000000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert sorted(tuple(r) for r in listing_files_to_fire_dates(spark, str(tmp_path)).collect()) == want, size
            if size == "300":
                assert tree_files(spark, str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_newton_fit_reaches_the_stationary_point(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - 1)))).astype(float)
    rows = [(k % 2, float(c), 3.0 if c else 1.0, float(a), float(b)) for k, ((a, b), c) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (0, None, 1.0, 0.0, 0.0), (1, 1.0, 1.0, float("nan"), 0.0)], "model int, label double, weight double, a double, b double")
    models = newton_fit(df, ["a", "b"], steps=8, ridge=1e-3)
    assert sorted(models) == [0, 1]
    for m, beta in models.items():
        i = np.arange(500) % 2 == m
        z, w = np.column_stack([np.ones(i.sum()), x[i]]), np.where(y[i] == 1, 3.0, 1.0)
        gradient = z.T @ (w * (y[i] - 1 / (1 + np.exp(-(z @ beta))))) / w.sum() - 1e-3 * beta
        assert np.abs(gradient).max() < 1e-9
    assert newton_fit(df.limit(0), ["a", "b"]) == {}
