"""Registry of the queries exposed through ``__spark_entry__`` and their DuckDB oracles.

Every query takes ``(spark, sf_dir)`` and reads the driver's tables (through the derived
views of ``ashgrid.sources.fixtures``).  The oracle is the same computation written in
DuckDB SQL over the same tables; the fixture views it mentions are prepended as CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# DuckDB text of the fixture views (same definitions as ashgrid.sources.fixtures).
ORACLE_VIEWS: dict[str, str] = {
    "sensor_obs": """
select event_id, user_id as station_id,
       cast(30 + (user_id % 20)*0.5 as double) as lat,
       cast(-120 + (user_id % 37)*0.75 as double) as lon,
       date_trunc('hour', ts) as time, value as pm25,
       case when event_id % 11 = 0 then null else value*0.8 + (event_id % 7) end as est_a,
       case when event_id % 5 = 0 then null else value*1.1 - (event_id % 13) end as est_b
from events""",
    "fire": """
select c_custkey as fire_id,
       cast(30 + (c_custkey % 20)*0.5 + 0.25 as double) as lat,
       cast(-120 + (c_custkey % 37)*0.75 + 0.25 as double) as lon,
       timestamp '2024-01-01 00:00:00' + to_days(cast(c_custkey % 25 as int)) as idate,
       timestamp '2024-01-01 00:00:00' + to_days(cast(c_custkey % 25 + c_custkey % 5 + 1 as int)) as fdate,
       c_acctbal*10000 as area
from customer""",
    "grid_cell": """
select (p_partkey // 40) as y, p_partkey % 40 as x,
       cast(30 + (p_partkey // 40)*0.25 as double) as lat,
       cast(-120 + (p_partkey % 40)*0.75 as double) as lon,
       p_retailprice/10 as v, p_size % 5 as qflag
from part""",
    "pixel_obs": """
select user_id % 8 as fire_id, cast(ts as date) as obs_date,
       (event_id % 256) // 16 as y, event_id % 16 as x, max(value) as v,
       max(case when event_type = 'error' then 100 * (event_id % 24) else null end) as af_hhmm
from events group by 1,2,3,4""",
    "pred": """
select d.doc_id as px, l.quality as y,
       (d.n_chars % 1000)/cast(1000 as double) as score, d.lang as grp
from documents d join labels l on d.doc_id = l.doc_id""",
    "manifest": """
select page_id, url, octet_length(encode(html)) as bytes, md5(html) as md5,
       case when page_id % 9 = 0 then 'stale' else md5(html) end as etag,
       case when page_id % 7 = 0 then octet_length(encode(html))+1 else octet_length(encode(html)) end as expected_bytes
from pages""",
}

ORACLE_VIEWS["raster"] = """
select cast(2018 + fire_id % 4 as int) as year, fire_id, obs_date, y, x, v as b0,
       ((v * 7) % 360 + 360) % 360 as b7, cast(floor(v) as int) % 18 as b16, cast(af_hhmm as double) as b22
from pixel_obs"""


def with_views(sql: str) -> str:
    """Prefix the fixture views that ``sql`` mentions as CTEs."""
    body = sql.strip()
    used = [v for v in ORACLE_VIEWS if re.search(rf"\b{v}\b", body)]
    if "raster" in used and "pixel_obs" not in used:
        used.insert(0, "pixel_obs")
    used.sort(key=lambda v: v != "pixel_obs")
    if not used:
        return body
    ctes = ",\n".join(f"{v} as ({ORACLE_VIEWS[v].strip()})" for v in used)
    if m := re.match(r"(?is)^with\s+(recursive\s)?", body):
        return f"with {m.group(1) or ''}{ctes},\n{body[m.end():]}"
    return f"with {ctes}\n{body}"


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with an optional oracle."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (engines agree to about 12 digits, not bit for bit)."""
    def r(c, t):
        if t in ("double", "float"):
            return F.round(F.col(c), digits).alias(c)
        if t in ("array<double>", "array<float>"):
            return F.transform(F.col(c), lambda x: F.round(x, digits)).alias(c)
        return F.col(c)
    return df.select(*[r(c, t) for c, t in df.dtypes])
