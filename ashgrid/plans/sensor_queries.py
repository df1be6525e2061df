"""Registered queries over the sensor readings view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ashgrid.operators import aggregates as agg
from ashgrid.plans.catalog import register, rounded
from ashgrid.sources.fixtures import sensor_obs

_LONG = """
with long as (
  select 'est_a' as source, pm25 as truth, est_a as est, lat, lon, time from sensor_obs
  union all
  select 'est_b' as source, pm25 as truth, est_b as est, lat, lon, time from sensor_obs),
v as (
  select * from long
  where truth is not null and est is not null and lat is not null and lon is not null
    and truth between {lo} and {hi} and est between {lo} and {hi}),
r as (
  select *,
    rank() over (partition by {key} order by truth)
      + (count(*) over (partition by {key}, truth) - 1) / 2.0 as rt,
    rank() over (partition by {key} order by est)
      + (count(*) over (partition by {key}, est) - 1) / 2.0 as re
  from v),
m as (
  select {key},
    covar_pop(truth, est) / nullif(stddev_pop(truth) * stddev_pop(est), 0) as pearson,
    covar_pop(ln(truth), ln(est)) / nullif(stddev_pop(ln(truth)) * stddev_pop(ln(est)), 0) as log_pearson,
    covar_pop(rt, re) / nullif(stddev_pop(rt) * stddev_pop(re), 0) as spearman,
    sqrt(avg((truth - est) * (truth - est))) as rmse,
    avg(truth - est) as bias,
    covar_pop(est, truth) / nullif(var_pop(est), 0) as slope,
    count(*) as n,
    count(distinct (lat, lon)) as stations
  from r group by {key})
"""

_METRICS_OUT = """round(pearson, 6) as pearson, round(log_pearson, 6) as log_pearson,
  round(spearman, 6) as spearman, round(rmse, 6) as rmse, round(bias, 6) as bias,
  round(slope, 6) as slope, n, stations"""


@register("agreement", sql=_LONG.format(lo=2, hi=1000, key="source") + f"""
select s.source, {_METRICS_OUT}
from (values ('est_a'), ('est_b')) s(source) left join m on s.source = m.source""")
def q_agreement(spark, sf_dir):
    """D3 (+B3, D5): agreement of both estimates with the sensor truth, range [2, 1000]."""
    obs = sensor_obs(spark, sf_dir)
    return rounded(agg.agreement(obs, "pm25", ["est_a", "est_b"], lo=2.0, hi=1000.0))


@register("agreement_by_year", sql=_LONG.format(lo=2, hi=1000, key="year").replace(
    "'est_a' as source, pm25 as truth, est_a as est, lat, lon, time from sensor_obs\n  union all\n"
    "  select 'est_b' as source, pm25 as truth, est_b as est, lat, lon, time from sensor_obs",
    "year(time) as year, pm25 as truth, est_b as est, lat, lon, time from sensor_obs")
    + f"select cast(year as int) as year, {_METRICS_OUT} from m")
def q_agreement_by_year(spark, sf_dir):
    """D4 (+F1): yearly agreement of one estimate, ordered by year."""
    obs = sensor_obs(spark, sf_dir)
    return rounded(agg.agreement_by_year(obs, "pm25", "est_b"))


@register("rank_correlation", sql="""
with v as (select pm25, est_a from sensor_obs where pm25 > 0 and est_a > 0),
r as (select rank() over (order by pm25) + (count(*) over (partition by pm25) - 1) / 2.0 as rt,
             rank() over (order by est_a) + (count(*) over (partition by est_a) - 1) / 2.0 as re,
             ln(pm25) as lt, ln(est_a) as le from v),
r2 as (select *, rank() over (order by lt) + (count(*) over (partition by lt) - 1) / 2.0 as rlt,
                 rank() over (order by le) + (count(*) over (partition by le) - 1) / 2.0 as rle from r)
select round(covar_pop(rt, re) / nullif(stddev_pop(rt) * stddev_pop(re), 0), 6) as spearman,
       round(covar_pop(rlt, rle) / nullif(stddev_pop(rlt) * stddev_pop(rle), 0), 6) as log_spearman
from r2""")
def q_rank_correlation(spark, sf_dir):
    """Global Spearman correlation (no group key) and its log version, which is equal
    because log is monotone; both over positive pairs."""
    from ashgrid.operators.ranks import rank_correlation
    obs = sensor_obs(spark, sf_dir).filter((F.col("pm25") > 0) & (F.col("est_a") > 0))
    a = rank_correlation(obs, [], "pm25", "est_a")
    logs = obs.select(F.ln("pm25").alias("lt"), F.ln("est_a").alias("le"))
    b = rank_correlation(logs, [], "lt", "le").withColumnRenamed("spearman", "log_spearman")
    return rounded(a.select("spearman", b.select("log_spearman").scalar().alias("log_spearman")))


@register("log_correlation_by_year", sql="""
select cast(year(time) as int) as year,
  round(covar_pop(ln(pm25), ln(est_b)) / nullif(stddev_pop(ln(pm25)) * stddev_pop(ln(est_b)), 0), 6)
    as log_correlation
from sensor_obs
where pm25 > 0 and pm25 < 100000 and est_b > 0 and est_b < 100000 and year(time) < 2025
group by 1""")
def q_log_correlation_by_year(spark, sf_dir):
    """D6 (+B7): log Pearson per year over the open range (0, 1e5), years before 2025."""
    obs = sensor_obs(spark, sf_dir)
    return rounded(agg.log_correlation_by_year(obs, "pm25", "est_b", before_year=2025))


@register("correlation_by_bin", sql="""
select * from (
  select cast(floor(pm25 / 50) * 50 as double) as bin,
    round(covar_pop(est_a, pm25) / nullif(stddev_pop(case when est_a is not null then pm25 end)
          * stddev_pop(case when pm25 is not null then est_a end), 0), 6) as correlation
  from sensor_obs where pm25 is not null group by 1) t
where correlation is not null""")
def q_correlation_by_bin(spark, sf_dir):
    """Pearson per 50-unit truth bin; undefined bins dropped."""
    return rounded(agg.correlation_by_bin(sensor_obs(spark, sf_dir), "pm25", "est_a", 50.0))


@register("count_by_bin", sql="""
select cast(floor(pm25 / 50) * 50 as double) as bin, count(*) as n
from sensor_obs where pm25 is not null group by 1""")
def q_count_by_bin(spark, sf_dir):
    """D8 (+F1): rows per 50-unit truth bin, ordered by bin."""
    return agg.count_by_bin(sensor_obs(spark, sf_dir), "pm25", 50.0)


@register("correlation_above", sql="""
select round(covar_pop(pm25, est_a) / nullif(stddev_pop(case when est_a is not null then pm25 end)
             * stddev_pop(case when pm25 is not null then est_a end), 0), 6) as correlation,
       count(*) as n
from sensor_obs where pm25 > 100""")
def q_correlation_above(spark, sf_dir):
    """Pearson for truth > 100."""
    return rounded(agg.correlation_above(sensor_obs(spark, sf_dir), "pm25", "est_a", 100.0))


@register("mean_error_by_hour", sql="""
select cast(hour(time) as int) as hour, round(avg(abs(pm25 - est_a)), 6) as mean_abs_error
from sensor_obs group by 1""")
def q_mean_error_by_hour(spark, sf_dir):
    """D11 (+B20): mean absolute error by hour of day."""
    return rounded(agg.mean_error_by_hour(sensor_obs(spark, sf_dir), "pm25", "est_a"))


@register("mean_by_station", sql="""
select station_id, round(avg(abs(pm25 - est_a)), 6) as mean_abs_error,
       round(avg(pm25), 6) as mean_truth, round(avg(est_a), 6) as mean_est
from sensor_obs group by 1""")
def q_mean_by_station(spark, sf_dir):
    """Mean error, truth and estimate per group (station here; fire in the matched pairs)."""
    return rounded(agg.mean_by_group(sensor_obs(spark, sf_dir), "station_id", "pm25", "est_a"))


@register("first_location", sql="""
select station_id % 10 as grp,
       arg_min(lat, event_id) filter (where lat is not null) as lat,
       arg_min(lon, event_id) filter (where lon is not null) as lon
from sensor_obs group by 1""")
def q_first_location(spark, sf_dir):
    """First non-null location per group in event order."""
    obs = sensor_obs(spark, sf_dir).withColumn("grp", F.col("station_id") % 10)
    return agg.first_location_by_group(obs, "grp", "event_id")


@register("station_spans", sql="""
select lat, lon, min(time) as first_time, max(time) as last_time from sensor_obs group by 1, 2""")
def q_station_spans(spark, sf_dir):
    """First and last reading per station."""
    return agg.station_spans(sensor_obs(spark, sf_dir))


@register("station_count", sql="""
select count(distinct (lat, lon)) as stations from sensor_obs where lat is not null and lon is not null""")
def q_station_count(spark, sf_dir):
    """Distinct station locations."""
    return agg.station_count(sensor_obs(spark, sf_dir))


@register("histogram_error", sql="""
with d as (select abs(pm25 - est_a) as v from sensor_obs where abs(pm25 - est_a) is not null),
s as (select case when min(v) = max(v) then min(v) - 0.5 else min(v) end as mn,
            case when min(v) = max(v) then max(v) + 0.5 else max(v) end as mx from d),
c as (select cast(coalesce(least(floor((v - mn) / ((mx - mn) / 50)), 49), 0) as int) as bin, count(*) as n
      from d, s group by 1),
g as (select cast(range as int) as bin from range(50))
select g.bin, round(mn + g.bin * (mx - mn) / 50, 6) as lo, round(mn + (g.bin + 1) * (mx - mn) / 50, 6) as hi,
       coalesce(c.n, 0) as n
from g cross join s left join c on g.bin = c.bin""")
def q_histogram_error(spark, sf_dir):
    """D14 (+B20): 50 equal-width bins of the absolute error."""
    from ashgrid.functions.columns import abs_error
    obs = sensor_obs(spark, sf_dir).select(abs_error("pm25", "est_a").alias("err"))
    return rounded(agg.histogram(obs, "err", 50))


@register("density_station_mean", sql="""
with m as (select station_id, avg(abs(pm25 - est_a)) as v from sensor_obs group by 1),
d as (select v from m where v is not null),
s as (select count(*) as n, stddev_samp(v) * pow(count(*), -0.2) as bw, min(v) as mn, max(v) as mx from d),
g as (select range as g, (mn - 3 * bw) + range * ((mx + 3 * bw) - (mn - 3 * bw)) / 199 as x
      from s, range(200))
select g.g as g, round(g.x, 6) as x,
       round(sum(exp(-0.5 * pow((g.x - d.v) / s.bw, 2)) / (s.bw * sqrt(2 * pi()))) / max(s.n), 6) as density
from g, d, s group by g.g, g.x""")
def q_density_station_mean(spark, sf_dir):
    """D15 (+D12): Gaussian density of the per-station mean absolute error, 200 grid points."""
    m = agg.mean_by_group(sensor_obs(spark, sf_dir), "station_id", "pm25", "est_a")
    return rounded(agg.density(m, "mean_abs_error", 200).withColumn("g", F.col("g").cast("long")))


@register("missing_by_column", sql="""
with c as (select count(*) as rows,
  count(*) - count(event_id) as event_id, count(*) - count(station_id) as station_id,
  count(*) - count(lat) as lat, count(*) - count(lon) as lon, count(*) - count(time) as time,
  count(*) - count(pm25) as pm25, count(*) - count(est_a) as est_a, count(*) - count(est_b) as est_b
  from sensor_obs)
select "column", missing, rows from c
unpivot (missing for "column" in (event_id, station_id, lat, lon, time, pm25, est_a, est_b))""")
def q_missing_by_column(spark, sf_dir):
    """Missing count per column with the row count."""
    return agg.missing_by_column(sensor_obs(spark, sf_dir))
