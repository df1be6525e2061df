"""Joins.

Design rules used throughout:
  * Grid sampling (C5-C8, C10) turns coordinates into integer cell indexes and equi-joins;
    there is never a distance join.
  * Box / period restrictions use a cell-binned range join (C3, ``box_join``); where only the number of
    fires around a reading counts (C4, L2), differences per place and period (``covering_fires``).
  * No join side is forced to be broadcast: Catalyst and AQE choose from measured bytes, and
    AQE's skew handling splits hot partitions of shuffle joins.  The only hints are on tables
    of a fixed size (23 band names) and merge joins where pairs or bins outnumber the tables they come from (``box_join``).
  * Interpolation (C6) packs the corner values of a grid cell into one row, so a reading meets
    its cell in one equi-join and the value is an expression.
  * Substring matching (C11) is an equi-join on the substrings of the names that a bit table of
    the keys lets through, never a nested loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.functions.columns import col_of, micros_between, ntz_lit
from ashgrid.functions.geo import LambertSpec, lambert_xy
from ashgrid.operators.substrings import possible_keys

__all__ = [
    "hours_since", "attach_exact", "match_inner", "box_join", "FirePairs", "obs_near_fire", "covering_fires",
    "obs_within_fire_box",
    "RegularAxis", "IrregularAxis", "nearest_index", "lower_index", "sample_nearest", "corner_table", "sample_linear",
    "sample_projected", "sample_stations", "nearest_in_time", "append_grid_bands", "append_grid_fields",
    "match_by_substring", "in_calendar_windows", "missing_cycles", "subset_by_index", "coverage_by_year",
    "daily_perimeters_for", "locate_sample", "with_band_names", "BAND_NAMES",
]


def attach_exact(obs: DataFrame, est: DataFrame, on: Sequence[str] = ("lat", "lon", "time")) -> DataFrame:
    """Left equi-join of estimates onto readings; duplicate estimate keys multiply rows."""
    return obs.join(est, list(on), "left")


def match_inner(sensor: DataFrame, sat: DataFrame, on: Sequence[str] = ("lat", "lon", "time"),
                suffixes: tuple[str, str] = ("_sensor", "_sat")) -> DataFrame:
    """Inner equi-join; overlapping non-key columns get the sensor / satellite suffix."""
    on = list(on)
    common = (set(sensor.columns) & set(sat.columns)) - set(on)
    s = sensor.select(*on, *[F.col(c).alias(c + suffixes[0] if c in common else c)
                             for c in sensor.columns if c not in on])
    t = sat.select(*on, *[F.col(c).alias(c + suffixes[1] if c in common else c)
                          for c in sat.columns if c not in on])
    return s.join(t, on, "inner")


def _day_number(ts: Column) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))


def _fire_bins(fires: DataFrame, half: float, cell: float, period_days: int, fire_cols: Sequence[str], fire_lat: str, fire_lon: str,
               start: str, end: str) -> DataFrame:
    """One row per fire and (cell, period) bin that its box and period touch."""
    f = fires.select(*[F.col(c) for c in fire_cols], F.col(fire_lat).alias("_flat"),
                     F.col(fire_lon).alias("_flon"), F.col(start).alias("_fs"), F.col(end).alias("_fe"))
    f = f.repartition(*f.columns)  # a catalog in one small file is one task, and its bins are many times its rows
    for name, c in (("_cy", "_flat"), ("_cx", "_flon")):
        f = f.select("*", F.explode(F.sequence(F.floor((F.col(c) - half) / cell), F.floor((F.col(c) + half) / cell))).alias(name))
    return f.select("*", F.explode(F.sequence(F.floor(_day_number(F.col("_fs")) / period_days),
                                              F.floor(_day_number(F.col("_fe")) / period_days))).alias("_cp"))


def _bin_of(lat: str, lon: str, time: str, cell: float, period_days: int) -> dict[str, Column]:
    """The one bin of a reading."""
    return {"_cy": F.floor(F.col(lat) / cell), "_cx": F.floor(F.col(lon) / cell),
            "_cp": F.floor(_day_number(F.col(time)) / period_days)}


def _near_any_fire(obs: DataFrame, fires: DataFrame, half: float, lat: str, lon: str, time: str, fire_lat: str, fire_lon: str,
                   start: str, end: str) -> DataFrame:
    """Readings in the fires' global period and bounding box.  These six numbers come back as literals, so
    the filter reaches the readings' scan (partition pruning / parquet pushdown on stored columns)."""
    b = fires.agg(F.min(start).alias("t0"), F.max(end).alias("t1"),
                  F.min(fire_lat).alias("la0"), F.max(fire_lat).alias("la1"),
                  F.min(fire_lon).alias("lo0"), F.max(fire_lon).alias("lo1")).first()
    if b["t0"] is None:          # no fires: the join that follows is empty anyway
        return obs
    return obs.filter(F.col(time).between(ntz_lit(b["t0"]), ntz_lit(b["t1"]))
                      & F.col(lat).between(b["la0"] - half, b["la1"] + half)
                      & F.col(lon).between(b["lo0"] - half, b["lo1"] + half))


def _in_box(la: Column, lo: Column, half: float, strict_box: str) -> Column:
    if strict_box == "abs":
        return (F.abs(la - F.col("_flat")) < half) & (F.abs(lo - F.col("_flon")) < half)
    return ((lo > F.col("_flon") - half) & (lo < F.col("_flon") + half)
            & (la > F.col("_flat") - half) & (la < F.col("_flat") + half))


def _places_met(o: DataFrame, bins: DataFrame, at: dict[str, Column], half: float, strict_box: str, lat: str, lon: str) -> DataFrame:
    """One row per fire, place and period: a distinct (lat, lon) with readings in a period (``_la``, ``_lo``, ``_cp``) and a
    fire of ``bins`` whose box holds it."""
    places = o.select(F.col(lat).alias("_la"), F.col(lon).alias("_lo"), *[c.alias(n) for n, c in at.items()]).distinct()
    # the bins are many times the fires whose bytes AQE measures: broadcast, they would all meet the few places in one task
    return places.join(bins.hint("merge"), ["_cy", "_cx", "_cp"]).filter(_in_box(F.col("_la"), F.col("_lo"), half, strict_box) & (F.col("_fs") <= F.col("_fe")))


PAIR_ROWS = 1 << 16     # pairs that a task holds at once beside the readings of its block
BLOCK_FIRES = 1 << 16   # fires of a block of space and time that one task takes


def _indexed(held: list, lat: int, lon: int, time: int, kept: list[int], coded: list[int]):
    """Readings of a block, sorted by place and time: the columns to give back, with whole numbers that order the values of
    some; the places, the distinct times and where rows stand among both."""
    rows = pa.chunked_array(held).combine_chunks().flatten()
    la, lo = (rows[i].to_numpy(zero_copy_only=False) for i in (lat, lon))
    t = rows[time].cast(pa.int64()).to_numpy()
    by = np.lexsort((t, lo, la))
    la, lo, t = la[by], lo[by], t[by]
    new = np.r_[True, (la[1:] != la[:-1]) | (lo[1:] != lo[:-1])]
    steps, step = np.unique(t, return_inverse=True)
    by = pa.array(by)
    codes = [pa.array(np.unique(rows[i].to_numpy(zero_copy_only=False), return_inverse=True)[1]) for i in coded]
    return [c.take(by) for c in [*(rows[i] for i in kept), *codes]], la[new], lo[new], steps, (np.cumsum(new) - 1) * (len(steps) + 1) + step


def _block_pairs(readings, fires, half: np.float64, strict_box: str, names: list[str]):
    """Pairs of a block's indexed readings and some of its fires, fire by fire."""
    rows, la, lo, steps, at = readings
    *cols, flat, flon, fs, fe = fires.flatten()
    flat, flon = (c.to_numpy(zero_copy_only=False)[:, None] for c in (flat, flon))
    after, until = (np.searchsorted(steps, c.cast(pa.int64()).to_numpy(), side) for c, side in ((fs, "left"), (fe, "right")))
    some = max(1, (1 << 21) // len(la))
    for k in range(0, len(flat), some):
        y, x = flat[k:k + some], flon[k:k + some]
        if strict_box == "abs":
            inside = (np.abs(la - y) < half) & (np.abs(lo - x) < half)
        else:
            inside = (lo > x - half) & (lo < x + half) & (la > y - half) & (la < y + half)
        fire, place = np.nonzero(inside)
        fire += k
        place *= len(steps) + 1
        start, n = np.searchsorted(at, place + after[fire]), np.searchsorted(at, place + until[fire])
        n = n - start
        fire, start, n = fire[n > 0], start[n > 0], n[n > 0]
        through = np.cumsum(n)
        i = 0
        while i < len(n):
            j = max(i + 1, int(np.searchsorted(through, through[i] - n[i] + PAIR_ROWS, "right")))
            c = n[i:j]
            row = np.repeat(start[i:j] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            of = np.repeat(fire[i:j], c)
            for p in range(0, len(row), PAIR_ROWS):
                r, f = pa.array(row[p:p + PAIR_ROWS]), pa.array(of[p:p + PAIR_ROWS])
                yield pa.RecordBatch.from_arrays([*(a.take(r) for a in rows), *(a.take(f) for a in cols)], names)
            i = j


def _pairs_of_blocks(batches, half: float, strict_box: str, which: tuple, names: list[str]):
    """Rows (block, reading or null, fire or null), each block's readings before its fires -> the pairs of each block.

    The readings of one block are held, its fires stream past them."""
    block, held, readings = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        blocks, is_fire = b.column(0).to_numpy(), np.asarray(b.column(2).is_valid())
        cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_fire[1:] != is_fire[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if blocks[i] != block:
                block, held, readings = blocks[i], [], None
            if not is_fire[i]:
                held.append(b.column(1).slice(i, j - i))
                continue
            if held:
                readings, held = _indexed(held, *which), []
            if readings is not None:
                yield from _block_pairs(readings, b.column(2).slice(i, j - i), np.float64(half), strict_box, names)


def _pairs_by_fire(obs: DataFrame, fires: DataFrame, half: float, work, schema: T.StructType, columns: Sequence[str], coded: Sequence[str], *, strict_box: str = "abs",
                   obs_lat: str = "lat", obs_lon: str = "lon", obs_time: str = "time",
                   fire_lat: str = "lat", fire_lon: str = "lon", start: str = "idate", end: str = "fdate",
                   fire_cols: Sequence[str] = ("fire_id",), cell_deg: float | None = None,
                   period_days: int = 7, prefilter: bool = True) -> DataFrame:
    """``work`` done on the pairs of ``box_join``, all pairs of a fire in one task, one after another, and no pair ever shuffled.

    A fire belongs to the block of space and time in which it starts: a cell of its place and a span at least four times
    its length (spans grow by powers of two).  All rows of one ``fire_cols`` share a block.  A block gets the readings of
    the places and periods that its fires meet, so a reading is dealt to the blocks around it, however
    many fires they have; there the pairs are made fire by fire."""
    fire_cols, lat, lon, time, cell = list(fire_cols), obs_lat, obs_lon, obs_time, cell_deg or 2 * half
    o = _near_any_fire(obs, fires, half, lat, lon, time, fire_lat, fire_lon, start, end) if prefilter else obs
    place = ["_flat", "_flon", "_fs", "_fe"]
    f = fires.select(*fire_cols, F.col(fire_lat).alias("_flat"), F.col(fire_lon).alias("_flon"), F.col(start).cast("timestamp_ntz").alias("_fs"),
                     F.col(end).cast("timestamp_ntz").alias("_fe")).dropna(subset=place).filter("_fs <= _fe and not isnan(_flat) and not isnan(_flon)")
    days = _day_number(F.col("_fe")) - _day_number(F.col("_fs"))
    k = F.ceil(F.log2(F.greatest(days / period_days, F.lit(1.0))))
    span = 4 * period_days * F.pow(F.lit(2.0), k)
    f = f.withColumn("_block", F.struct(k, F.floor(F.col("_flat") / cell), F.floor(F.col("_flon") / cell), F.floor(_day_number(F.col("_fs")) / span)))
    f = f.withColumn("_block", F.min("_block").over(Window.partitionBy(*fire_cols)))
    many = f.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / BLOCK_FIRES).alias("_parts"))
    f = f.join(many, "_block").select(F.xxhash64("_block", F.pmod(F.xxhash64(*fire_cols), "_parts")).alias("_b"), *fire_cols, *place)
    bins = _fire_bins(f, half, cell, period_days, ["_b"], *place)
    at = _bin_of(lat, lon, time, cell, period_days)
    wanted = _places_met(o, bins, at, half, strict_box, lat, lon).select("_b", "_la", "_lo", "_cp").distinct()
    r = o.withColumns({"_op": at["_cp"], "_t": F.col(time).cast("timestamp_ntz")}).join(
        wanted.hint("merge"), (o[lat] == F.col("_la")) & (o[lon] == F.col("_lo")) & (F.col("_op") == F.col("_cp")))
    plain = isinstance(o.schema[time].dataType, T.TimestampNTZType)
    r = r.select("_b", F.struct(*[F.col(c) for c in o.columns], *([] if plain else ["_t"])).alias("_r"))
    f = f.select("_b", F.struct(*fire_cols, *place).alias("_f"))
    both = r.select("*", F.lit(None).cast(f.schema["_f"].dataType).alias("_f")).unionByName(
        f.select("_b", F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_f"))
    # a fixed number of partitions: a block's work is its pairs, so they are not merged by their bytes
    dealt = both.repartition(int(o.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_b").sortWithinPartitions(
        "_b", F.col("_f").isNotNull(), *[F.col("_f").getField(c) for c in fire_cols])
    column = o.columns.index
    which = (column(lat), column(lon), column(time) if plain else len(o.columns), [column(c) for c in columns], [column(c) for c in coded])
    names = [*columns, *[f"_code_{c}" for c in coded], *fire_cols]
    return dealt.mapInArrow(lambda b: work(_pairs_of_blocks(b, half, strict_box, which, names)), schema)


@dataclass(frozen=True)
class FirePairs:
    """The pairs of ``box_join``, not made yet, for work per fire: ``each`` makes them in the task that uses them, all pairs of
    a fire one after another, so that they are neither shuffled nor stored nor handed from Python to the JVM and back."""

    obs: DataFrame
    fires: DataFrame
    half: float
    how: dict

    @property
    def keys(self) -> list[str]:
        return list(self.how.get("fire_cols", ("fire_id",)))

    @property
    def position(self) -> list[str]:
        return [self.how.get(c, d) for c, d in (("obs_lat", "lat"), ("obs_lon", "lon"), ("obs_time", "time"))]

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """The pairs as rows, of all fires or of those with the given keys."""
        f = self.fires
        if keys is not None:
            some = F.broadcast(keys.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys]))
            same = F.lit(True)
            for k in self.keys:
                same = same & f[k].eqNullSafe(some[f"_k_{k}"])
            f = f.join(some, same, "left_semi")
        return box_join(self.obs, f, self.half, **self.how)

    def each(self, work, schema: T.StructType, columns: Sequence[str], coded: Sequence[str] = ()) -> DataFrame:
        """``work``: an iterator of Arrow batches of pairs -> an iterator of Arrow batches.  A pair has ``columns`` of its reading,
        ``_code_c`` for each c of ``coded``, a whole number that orders the fire's values of c, and the fire's keys."""
        return _pairs_by_fire(self.obs, self.fires, self.half, work, schema, columns, coded, **self.how)


def box_join(obs: DataFrame, fires: DataFrame, half: float, *, strict_box: str = "abs",
             obs_lat: str = "lat", obs_lon: str = "lon", obs_time: str = "time",
             fire_lat: str = "lat", fire_lon: str = "lon", start: str = "idate", end: str = "fdate",
             fire_cols: Sequence[str] = ("fire_id",), cell_deg: float | None = None,
             period_days: int = 7, prefilter: bool = True) -> DataFrame:
    """Readings inside a fire's box (boundary excluded) during its period (closed).

    ``strict_box="abs"``: ``abs(dlat) < half and abs(dlon) < half``;
    ``strict_box="bounds"``: ``lon - half < x < lon + half`` (and lat likewise), the form a
    point-within-rectangle test uses.

    Plan: each fire is exploded into the (cell, period) bins its box and period touch and meets the places
    there (distinct positions of readings), not the readings; the box is tested once per place.  A fire
    at a place is then exploded into its days and meets the readings of that place and day in an
    equi-join, which leaves only the hours before its start and after its end to be tested, so
    the candidates grow like the result.  Readings are first restricted to the
    global period and bounding box of all fires; these six numbers are the only job that runs
    while the plan is built.
    """
    cell = cell_deg or 2 * half
    bins = _fire_bins(fires, half, cell, period_days, fire_cols, fire_lat, fire_lon, start, end)
    o = _near_any_fire(obs, fires, half, obs_lat, obs_lon, obs_time, fire_lat, fire_lon, start, end) if prefilter else obs
    at = _bin_of(obs_lat, obs_lon, obs_time, cell, period_days)
    met = _places_met(o, bins, at, half, strict_box, obs_lat, obs_lon)
    first, past = F.col("_cp") * period_days, (F.col("_cp") + 1) * period_days - 1
    # with F.sequence(a, b) a > b would count downwards: a period that a bin names always holds a day of it
    days = F.explode(F.sequence(F.greatest(_day_number(F.col("_fs")), first), F.least(_day_number(F.col("_fe")), past))).alias("_day")
    met = met.select(*fire_cols, "_la", "_lo", "_cp", "_fs", "_fe", days)
    # pairs are many times the readings: sorted and merged in shuffle partitions (AQE splits hot ones), not made beside
    # a broadcast table in as many tasks as the readings have files
    j = o.withColumns({"_op": at["_cp"], "_od": _day_number(F.col(obs_time)).cast("long")}).join(
        met.hint("merge"), (o[obs_lat] == F.col("_la")) & (o[obs_lon] == F.col("_lo")) & (F.col("_op") == F.col("_cp")) & (F.col("_od") == F.col("_day")))
    during = (o[obs_time] >= F.col("_fs")) & (o[obs_time] <= F.col("_fe"))
    return j.filter(during).drop("_op", "_od", "_cp", "_day", "_la", "_lo", "_fs", "_fe")


def obs_near_fire(obs: DataFrame, fires: DataFrame, half: float = 0.5, together: bool = False, **kw) -> DataFrame | FirePairs:
    """One row per (reading, fire) with the reading within +/-half degrees (strict) during
    the fire's period (closed).  ``together``: as pairs that are made fire by fire where they are used (``FirePairs``)."""
    if together:
        return FirePairs(obs, fires, half, {"strict_box": "abs", **kw})
    return box_join(obs, fires, half, strict_box="abs", **kw)


def covering_fires(obs: DataFrame, fires: DataFrame, half: float, *, strict_box: str = "bounds",
                   obs_lat: str = "lat", obs_lon: str = "lon", obs_time: str = "time",
                   fire_lat: str = "lat", fire_lon: str = "lon", start: str = "idate", end: str = "fdate",
                   cell_deg: float | None = None, period_days: int = 7, out: str = "n_fires") -> DataFrame:
    """C4: readings inside at least one fire's box during its period, once each, with the number of such fires.

    Interval stabbing by differences: a fire adds one at its start and takes one away after its end.  The
    differences are summed per place and period, where a place is a distinct (lat, lon) that has readings in
    the period, and a reading's count is the sum of those up to its time.  So a reading meets one row, never
    its fires; fires meet places, which are as many as the stations, not the readings.  Per place and
    period, fires that start or end at one instant are one difference."""
    cell = cell_deg or 2 * half
    o = _near_any_fire(obs, fires, half, obs_lat, obs_lon, obs_time, fire_lat, fire_lon, start, end)
    bins = _fire_bins(fires, half, cell, period_days, (), fire_lat, fire_lon, start, end)
    at = _bin_of(obs_lat, obs_lon, obs_time, cell, period_days)
    met = _places_met(o, bins, at, half, strict_box, obs_lat, obs_lon)
    # instants in half microseconds since 1970: a start counts from 2 t on, an end from 2 t + 1 on
    zero = ntz_lit(datetime(1970, 1, 1))
    instant = lambda t: 2 * micros_between(zero, t)
    length = 2 * 86_400_000_000 * period_days
    changes = met.select("_la", "_lo", "_cp", F.explode(F.array(
        F.struct(F.greatest(instant(F.col("_fs")), F.col("_cp") * length).alias("k"), F.lit(1).cast("long").alias("d")),
        F.struct((instant(F.col("_fe")) + 1).alias("k"), F.lit(-1).cast("long").alias("d")))).alias("s")).filter(
        F.col("s.k") < (F.col("_cp") + 1) * length)
    steps = changes.groupBy("_la", "_lo", "_cp", F.col("s.k").alias("k")).agg(F.sum("s.d").alias("d")).groupBy("_la", "_lo", "_cp").agg(
        F.collect_list(F.struct("k", "d")).alias("_steps"))
    j = o.withColumn("_op", at["_cp"]).join(steps, (F.col(obs_lat) == F.col("_la")) & (F.col(obs_lon) == F.col("_lo"))
                                            & (F.col("_op") == F.col("_cp")))
    # the sum starts from the reading's time too: Spark does not count a column that only the lambda names, and would move the
    # filter below to the side of the steps, which has no time
    passed = F.aggregate("_steps", instant(F.col(obs_time)) * 0, lambda n, x: n + F.when(x["k"] <= instant(F.col(obs_time)), x["d"]).otherwise(0))
    return j.withColumn(out, passed).filter(F.col(out) > 0).select(*obs.columns, out)


def obs_within_fire_box(obs: DataFrame, fires: DataFrame, half: float = 1.0, **kw) -> DataFrame:
    """C4: readings within a fire's +/-1 degree box (boundary excluded) during its period;
    overlapping boxes keep duplicates; only the reading columns are returned."""
    counted = covering_fires(obs, fires, half, strict_box="bounds", out="_n_fires", **kw)
    counted = counted.repartition(*counted.columns)  # the copies are many times the readings: dealt before they are made
    return counted.select(*obs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_n_fires").cast("int"))).alias("_copy")).drop("_copy")


@dataclass(frozen=True)
class RegularAxis:
    """A regular axis: coordinate of index i is origin + i * step, for i in [0, n)."""

    origin: float
    step: float
    n: int

    @property
    def last(self) -> float:
        return self.origin + (self.n - 1) * self.step


@dataclass(frozen=True)
class IrregularAxis:
    """An axis with arbitrary increasing coordinates (e.g. a Gaussian latitude grid)."""

    values: tuple[float, ...]

    @property
    def origin(self) -> float:
        return self.values[0]

    @property
    def last(self) -> float:
        return self.values[-1]


def _points_up_to(v: Column, axis: IrregularAxis, strict: bool) -> Column:
    """How many axis points lie below ``v`` (``strict``) or at or below it: bisection over the constant array, about
    log2(n) looks a value however long the axis is."""
    n = len(axis.values)
    arr = F.array(*[F.lit(float(a)) for a in axis.values])  # folded into one literal by the optimizer
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def further(k, s):
        point = F.get(arr, k + s - 1)
        return F.when((k + s <= n) & ((point < v) if strict else (point <= v)), k + s).otherwise(k)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def nearest_index(v, axis: RegularAxis | IrregularAxis) -> Column:
    """Index of the nearest axis point; ties go to the lower index; outside the axis hull
    (beyond the first or last point) -> null.

    Regular axes use index arithmetic; irregular axes (a short constant array shipped with the
    plan) find the points below the value by bisection and pick the closer neighbour."""
    v = col_of(v)
    lo, hi = min(axis.origin, axis.last), max(axis.origin, axis.last)
    if isinstance(axis, IrregularAxis):
        arr = F.array(*[F.lit(float(a)) for a in axis.values])
        k = _points_up_to(v, axis, True)                             # first index with a >= v
        above = F.element_at(arr, k + 1)                             # element_at is 1-based
        below = F.element_at(arr, F.greatest(k, F.lit(1)))
        idx = F.when(k == 0, F.lit(0)).when((v - below) <= (above - v), k - 1).otherwise(k)
        return F.when(v.between(lo, hi), idx.cast("long"))
    pos = (v - axis.origin) / axis.step
    idx = F.ceil(pos - 0.5).cast("long")
    return F.when(v.between(lo, hi), idx)


def hours_since(time, origin) -> Column:
    """Hours from a fixed wall-clock origin to a TIMESTAMP_NTZ column (fractional)."""
    return micros_between(ntz_lit(origin), col_of(time)) / 3.6e9


def sample_nearest(obs: DataFrame, cells: DataFrame, lat_axis: RegularAxis, lon_axis: RegularAxis,
                   values: Sequence[str], *, lat: str = "lat", lon: str = "lon",
                   cell_y: str = "y", cell_x: str = "x", extra_keys: Sequence[tuple[str, str]] = (),
                   time_axis: RegularAxis | None = None, time: str = "time", cell_t: str = "t",
                   time_origin=None) -> DataFrame:
    """Per-dimension nearest cell value (left join; outside the grid hull -> null).

    With ``time_axis`` (hours since ``time_origin``) the time step is chosen by nearest too,
    as for hourly reanalysis grids; ``extra_keys`` pairs (obs column, cell column) that must
    match exactly.  Ties at half steps go to the lower index on every axis.  One equi-join on
    the integer cell; the readings are read once.
    """
    idx = {"_iy": nearest_index(lat, lat_axis), "_ix": nearest_index(lon, lon_axis)}
    if time_axis is not None:
        idx["_it"] = nearest_index(hours_since(time, time_origin), time_axis)
    o = obs.withColumns(idx)
    c = cells.select(F.col(cell_y).alias("_iy"), F.col(cell_x).alias("_ix"),
                     *([F.col(cell_t).alias("_it")] if time_axis is not None else []),
                     *[F.col(cc).alias(f"_k{i}") for i, (_, cc) in enumerate(extra_keys)],
                     *[F.col(v).alias(f"_s{i}") for i, v in enumerate(values)])
    cond = [o[k] == c[k] for k in idx]
    cond += [o[oc] == c[f"_k{i}"] for i, (oc, _) in enumerate(extra_keys)]
    j = o.join(c, cond, "left")
    return j.select(*[o[x] for x in obs.columns], *[F.col(f"_s{i}").alias(v) for i, v in enumerate(values)])


def lower_index(v, axis: RegularAxis | IrregularAxis) -> tuple[Column, Column]:
    """(index of the axis point at or below ``v``, fraction of the step above it in [0, 1));
    null outside the axis hull."""
    v = col_of(v)
    inside = v.between(min(axis.origin, axis.last), max(axis.origin, axis.last))
    if isinstance(axis, IrregularAxis):
        arr = F.array(*[F.lit(float(a)) for a in axis.values])
        k = _points_up_to(v, axis, False) - 1
        below, above = F.get(arr, k), F.get(arr, k + 1)
        frac = F.when(v == below, F.lit(0.0)).otherwise((v - below) / (above - below))
        return F.when(inside, k.cast("long")), F.when(inside, frac)
    pos = (v - axis.origin) / axis.step
    return F.when(inside, F.floor(pos).cast("long")), F.when(inside, pos - F.floor(pos))


def corner_table(cells: DataFrame, values: Sequence[str], dims: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Cells with the values of their upper neighbours packed beside their own.

    ``dims`` are the integer index columns; the result has ``keys``, ``dims`` and per value an array
    ``<value>_corners`` of 2**len(dims) numbers, the last dimension varying fastest (null where a
    neighbour is missing).  Every dimension takes one window along a grid line (a line's length is
    the size of the axis), so a gridded product can be packed once and kept.  A cell whose own row
    is missing needs no entry: its weight is never zero."""
    out = cells.select(*keys, *[F.col(d).cast("long").alias(d) for d in dims],
                       *[F.array(F.col(v).cast("double")).alias(f"{v}_corners") for v in values])
    for d in reversed(dims):
        line = Window.partitionBy(*keys, *[x for x in dims if x != d]).orderBy(d)
        adjacent = F.lead(d).over(line) == F.col(d) + 1
        packed = {}
        for v in values:
            own = F.col(f"{v}_corners")
            none = F.transform(own, lambda x: F.lit(None).cast("double"))
            packed[f"{v}_corners"] = F.concat(own, F.coalesce(F.when(adjacent, F.lead(own).over(line)), none))
        out = out.select(*keys, *dims, *[c.alias(n) for n, c in packed.items()])
    return out


def sample_linear(obs: DataFrame, cells: DataFrame, lat_axis: RegularAxis | IrregularAxis,
                  lon_axis: RegularAxis | IrregularAxis, values: str | Sequence[str], *, lat: str = "lat",
                  lon: str = "lon", cell_y: str = "y", cell_x: str = "x", out: Sequence[str] | None = None,
                  time_axis: RegularAxis | None = None, time: str = "time", cell_t: str = "t", time_origin=None,
                  extra_keys: Sequence[tuple[str, str]] = (), packed: bool = False) -> DataFrame:
    """Linear interpolation in lat and lon (and time, with ``time_axis`` in hours since
    ``time_origin``); null outside the grid hull or when a corner with non-zero weight is missing.

    A reading meets the packed corners of its cell (``corner_table``; pass ``packed=True`` when
    ``cells`` is one already) in a single left equi-join, and the value is an expression of the
    corners and the fractions: no explode, no aggregation, and repeated readings keep their rows.
    The join keeps no state, so streams use the same function.  ``extra_keys`` pairs (reading
    column, cell column) that must match exactly."""
    values = [values] if isinstance(values, str) else list(values)
    out = list(out) if out is not None else values
    dims = [(cell_y, lower_index(lat, lat_axis)), (cell_x, lower_index(lon, lon_axis))]
    if time_axis is not None:
        dims.insert(0, (cell_t, lower_index(hours_since(time, time_origin), time_axis)))
    keys = [k for _, k in extra_keys]
    grid = cells if packed else corner_table(cells, values, [d for d, _ in dims], keys)
    g = grid.select(*[F.col(d).alias(f"_c{i}") for i, (d, _) in enumerate(dims)],
                    *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                    *[F.col(f"{v}_corners").alias(f"_v{i}") for i, v in enumerate(values)])
    o = obs.withColumns({f"_i{i}": idx for i, (_, (idx, _)) in enumerate(dims)}
                        | {f"_f{i}": frac for i, (_, (_, frac)) in enumerate(dims)})
    cond = [F.col(f"_i{i}") == F.col(f"_c{i}") for i in range(len(dims))]
    cond += [o[oc] == F.col(f"_k{i}") for i, (oc, _) in enumerate(extra_keys)]
    j = o.join(g, cond, "left")

    def blend(corners, i=0, at=0):
        """Interpolate along dimension i; the upper side counts only where its fraction is not 0."""
        half = 1 << (len(dims) - i - 1)
        low = F.get(corners, F.lit(at)) if i + 1 == len(dims) else blend(corners, i + 1, at)
        high = F.get(corners, F.lit(at + half)) if i + 1 == len(dims) else blend(corners, i + 1, at + half)
        f = F.col(f"_f{i}")
        return F.when(f == 0, low).otherwise((1 - f) * low + f * high)

    return j.select(*[o[c] for c in obs.columns], *[blend(F.col(f"_v{i}")).alias(n) for i, n in enumerate(out)])


def sample_projected(obs: DataFrame, cells: DataFrame, spec: LambertSpec, value: str = "pm25_tot",
                     *, lat: str = "lat", lon: str = "lon", time: str = "time", cell_time: str = "time",
                     cell_row: str = "row", cell_col: str = "col", cell_lay: str = "lay",
                     out: str | None = None) -> DataFrame:
    """Lambert xy -> (row, col) by truncation toward zero, bounds check, exact time match,
    layer 0; else null (left join)."""
    out = out or value
    x, y = lambert_xy(lon, lat, spec)
    colf = ((x - spec.xorig) / spec.xcell).cast("long")   # cast truncates toward zero
    rowf = ((y - spec.yorig) / spec.ycell).cast("long")
    ok = (colf >= 0) & (colf < spec.ncols) & (rowf >= 0) & (rowf < spec.nrows)
    o = obs.withColumns({"_row": F.when(ok, rowf), "_col": F.when(ok, colf)})
    c = cells.filter(F.col(cell_lay) == 0).select(
        F.col(cell_time).alias("_t"), F.col(cell_row).alias("_row"), F.col(cell_col).alias("_col"),
        F.col(value).alias(out))
    j = o.join(c, (o["_row"] == c["_row"]) & (o["_col"] == c["_col"]) & (o[time] == c["_t"]), "left")
    return j.select(*[o[x] for x in obs.columns], c[out])


def sample_stations(images: DataFrame, stations: DataFrame, lat_axis: RegularAxis, lon_axis: RegularAxis,
                    value: str, *, image_id: str = "image_id", lat: str = "lat", lon: str = "lon",
                    cell_y: str = "y", cell_x: str = "x") -> DataFrame:
    """Value of every image at every station (nearest cell).

    Each distinct station gets its cell index once; image cells are equi-joined on that index
    (the planner broadcasts the stations when they are small), so the result is
    one row per (image, station) whose cell the image holds.  Stations outside the grid hull
    match no cell.
    """
    st = stations.select(lat, lon).distinct().withColumns(
        {"_iy": nearest_index(lat, lat_axis), "_ix": nearest_index(lon, lon_axis)}).filter(
        F.col("_iy").isNotNull() & F.col("_ix").isNotNull())
    c = images.select(image_id, F.col(cell_y).alias("_iy"), F.col(cell_x).alias("_ix"), value)
    return c.join(st, ["_iy", "_ix"]).select(image_id, lat, lon, value)


def nearest_in_time(fires: DataFrame, daily: DataFrame, *, key: str = "fire_id", fire_time: str = "idate",
                    daily_time: str = "time", take: Sequence[str] = ("lat", "lon"),
                    tolerance_hours: float = 24.0, tie: str | None = None) -> DataFrame:
    """Per fire, the daily record with the same key nearest in time (ties: earlier
    record, then ``tie``); farther than the tolerance -> nulls.  Fires keep their row.

    An as-of merge: records and fires are put into one column of time slices (the tolerance wide), a
    record into its own slice and the two beside it, so each (key, slice) holds all records a fire of
    that slice may take.  There the two tables are sorted by time once, and running windows carry the
    last record up to a fire and the first one after it.  No fire meets all records of its key, and a
    key with very many records is split by time.  Records of one key and time are one row before."""
    span = int(tolerance_hours * 3600 * 1e6)
    at = lambda t: micros_between(ntz_lit(datetime(1970, 1, 1)), F.col(t))
    slice_of = lambda t: F.floor(t / max(span, 1))
    val = F.struct(*[F.col(c) for c in take])
    one = daily.filter(F.col(key).isNotNull() & F.col(daily_time).isNotNull()).groupBy(F.col(key).alias("_k"), at(daily_time).alias("_t")).agg(
        (F.min_by(val, F.col(tie)) if tie else F.min(val)).alias("_v"))
    rec = one.select("_k", "_t", F.explode(F.array(*[slice_of(F.col("_t")) + d for d in (-1, 0, 1)])).alias("_s"), "_v",
                     F.lit(None).cast(fires.schema[key].dataType).alias("_fire"))
    f = fires.filter(F.col(key).isNotNull() & F.col(fire_time).isNotNull()).select(F.col(key).alias("_k"), at(fire_time).alias("_t")).distinct()
    ask = f.select("_k", "_t", slice_of(F.col("_t")).alias("_s"), F.lit(None).cast(rec.schema["_v"].dataType).alias("_v"), F.col("_k").alias("_fire"))
    both = rec.unionByName(ask)
    hit = F.when(F.col("_fire").isNull(), F.struct("_t", "_v"))
    # at one instant the record comes first, so "up to" includes it
    w = Window.partitionBy("_k", "_s").orderBy("_t", F.col("_fire").isNotNull())
    before = F.last(hit, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = both.select("_k", "_t", "_fire", before.alias("_b"), after.alias("_a")).filter("_fire is not null")
    db, da = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    take_before = F.col("_a").isNull() | (db <= da)
    best = near.select("_k", F.col("_t").alias("_ft"), F.when(take_before, db).otherwise(da).alias("_d"),
                       F.when(take_before, F.col("_b._v")).otherwise(F.col("_a._v")).alias("_v")).filter(F.col("_d") <= span)
    j = fires.withColumn("_at", at(fire_time)).join(best, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_ft")), "left")
    return j.select(*fires.columns, *[F.col("_v")[c].alias(c) for c in take])


def append_grid_bands(pixels: DataFrame, grid: DataFrame, bands: Sequence[str], *,
                      date: str = "obs_date", grid_date: str = "date", y: str = "y", x: str = "x",
                      grid_y: str = "gy", grid_x: str = "gx", factor: int = 4) -> DataFrame:
    """C10 (+H2): append daily grid fields to each pixel as extra bands.

    The coarse grid is resampled to the pixel grid by nearest cell (pixel (y, x) lies in coarse
    cell (y div factor, x div factor)); pixels on dates with no grid at all are skipped.
    """
    g = grid.select(F.col(grid_date).alias("_gd"), F.col(grid_y).alias("_gy"), F.col(grid_x).alias("_gx"),
                    *[F.col(b) for b in bands])
    days = g.select(F.col("_gd").alias(date)).distinct()
    p = pixels.join(days, date, "left_semi")
    p = p.withColumns({"_gd": F.col(date), "_gy": F.floor(F.col(y) / factor), "_gx": F.floor(F.col(x) / factor)})
    j = p.join(g, ["_gd", "_gy", "_gx"], "left")
    return j.select(*pixels.columns, *bands)


def append_grid_fields(pixels: DataFrame, hourly: DataFrame, lat_axis: RegularAxis | IrregularAxis,
                       lon_axis: RegularAxis | IrregularAxis, bilinear: Sequence[str], nearest: Sequence[str] = (), *,
                       date: str = "obs_date", lat: str = "lat", lon: str = "lon", time: str = "time",
                       cell_y: str = "y", cell_x: str = "x") -> DataFrame:
    """C10 by coordinates (+D17, H1, H2): hourly grid fields reduced to daily values and appended to
    each pixel by its latitude and longitude.  ``bilinear`` fields are daily means interpolated
    bilinearly, ``nearest`` fields (flags, classes) come from the first step of the day at the
    nearest cell.  NaN counts as missing.  Pixels on dates without a grid are skipped."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c))
    daily = hourly.groupBy(F.to_date(time).alias("_day"), cell_y, cell_x).agg(
        *[F.avg(clean(v)).alias(v) for v in bilinear],
        *[F.min_by(F.col(v), F.col(time)).alias(v) for v in nearest])
    days = hourly.select(F.to_date(time).alias(date)).distinct()
    p = pixels.join(days, date, "left_semi")
    if bilinear:
        p = sample_linear(p, daily, lat_axis, lon_axis, bilinear, lat=lat, lon=lon, cell_y=cell_y, cell_x=cell_x,
                          extra_keys=[(date, "_day")])
    if nearest:
        p = sample_nearest(p, daily, lat_axis, lon_axis, nearest, lat=lat, lon=lon, cell_y=cell_y, cell_x=cell_x,
                           extra_keys=[(date, "_day")])
    return p


def match_by_substring(items: DataFrame, dirs: DataFrame, *, item_key: str = "fire_key",
                       dir_name: str = "dir_name", bits: int = 1 << 22) -> DataFrame:
    """C11: for each item, the first directory (by name) whose name contains the item key;
    unmatched items keep nulls.

    The keys set bits in a table of ``bits`` bits, read by every task; a substring of a directory name
    is shuffled only if its bit is set (``possible_keys``) and is then joined to the keys.  Names and
    keys may have any length; 2^22 bits are half a megabyte and let through about one wrong
    substring in 40 at 100,000 keys.  Building the bits runs a job over the keys.
    """
    keys = items.select(F.col(item_key).alias("_sub")).filter(F.col("_sub").isNotNull()).distinct()
    subs = possible_keys(dirs.select(F.col(dir_name).cast("string").alias("name")).distinct(), keys.select(F.col("_sub").cast("string")), bits)
    hits = subs.groupBy(F.col("sub").alias("_sub")).agg(F.min("name").alias(dir_name)).join(keys, "_sub", "left_semi")
    return items.join(hits.withColumnRenamed("_sub", item_key), item_key, "left")


def in_calendar_windows(fires: DataFrame, start, end, width_days: float = 7.0, *,
                        idate: str = "idate") -> DataFrame:
    """Fires whose ignition falls in [anchor, anchor + width) for a weekly anchor (every
    Sunday at midnight from ``start`` to ``end`` inclusive).

    Anchors are periodic, so the latest anchor not after the ignition is computed directly
    (no anchor table, no join); a fire is kept once even when windows overlap.
    """
    t = F.col(idate)
    d = F.to_date(t)
    sunday = F.date_sub(d, F.dayofweek(d) - 1)                   # dayofweek: 1 = Sunday
    s = F.to_date(ntz_lit(start))
    e = F.to_date(ntz_lit(end))
    first = F.date_add(s, (8 - F.dayofweek(s)) % 7)
    last = F.date_sub(e, F.dayofweek(e) - 1)
    a = F.least(sunday, last)
    a_ts = a.cast("timestamp_ntz")
    width_us = int(width_days * 86400 * 1e6)
    within = micros_between(a_ts, t) < width_us
    return fires.filter((a >= first) & (a_ts <= t) & within)


def missing_cycles(listing: DataFrame, start, end, *, native: bool = False, url: str = "url",
                   primary_base: str = "https://primary.example/hrrr",
                   fallback_base: str = "https://fallback.example/hrrr", first_n: int = 10) -> DataFrame:
    """Hourly cycles in [start, end] x URL templates; a URL is found on the primary host,
    else the fallback, else it is missing.  Returns the first ``first_n`` missing pairs by
    cycle with the number of cycles checked and of missing pairs on every row."""
    spark = listing.sparkSession
    cyc = spark.range(1).select(F.explode(F.sequence(ntz_lit(start), ntz_lit(end), F.expr("interval 1 hour"))).alias("cycle"))
    kinds = ["wrfprsf00"] + (["wrfnatf00"] if native else [])
    cyc = cyc.select("cycle", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))

    def build(base):
        return F.concat(F.lit(base), F.lit("/hrrr."), F.date_format("cycle", "yyyyMMdd"), F.lit("/conus/hrrr.t"),
                        F.date_format("cycle", "HH"), F.lit("z."), F.col("kind"), F.lit(".grib2"))

    u = cyc.select("cycle", "kind", build(primary_base).alias("primary_url"), build(fallback_base).alias("fallback_url"))
    have = listing.select(F.col(url).alias("_u")).distinct()
    miss = (u.join(have.withColumnRenamed("_u", "primary_url"), "primary_url", "left_anti")
             .join(have.withColumnRenamed("_u", "fallback_url"), "fallback_url", "left_anti"))
    n_cycles = cyc.select(F.count_distinct("cycle")).scalar()
    n_missing = miss.select(F.count(F.lit(1))).scalar()
    return (miss.orderBy("cycle", "kind").limit(first_n)
                .select("cycle", "kind", "primary_url", "fallback_url",
                        n_cycles.alias("n_cycles"), n_missing.alias("n_missing")))


def subset_by_index(samples: DataFrame, idx: DataFrame, key: str = "sample_id") -> DataFrame:
    """C14: keep listed sample ids (left-semi join)."""
    return samples.join(idx.select(key), key, "left_semi")


def coverage_by_year(with_data: DataFrame, total: DataFrame, year: str = "year") -> DataFrame:
    """Two yearly counts aligned on year (full outer join); missing -> 0; percentage of
    fires with data rounded to 2 places (null when the total is 0)."""
    j = with_data.join(total, year, "full")
    a = F.coalesce(F.col("fires_with_data"), F.lit(0))
    b = F.coalesce(F.col("total_fires"), F.lit(0))
    return j.select(year, a.alias("fires_with_data"), b.alias("total_fires"),
                    F.round(F.try_divide(a * 100.0, b), 2).alias("percent_with_data"))


def daily_perimeters_for(fires: DataFrame, collections: DataFrame, *, key: str = "fire_id",
                         idate: str = "idate", fdate: str = "fdate", year: str = "year") -> DataFrame:
    """Daily records of every yearly collection a fire's period spans, matched by id.

    ``collections`` is the union of the yearly collections with a ``year`` column."""
    f = fires.select(key, F.year(idate).alias("_y0"), F.year(fdate).alias("_y1"))
    j = collections.join(f, key)
    return j.filter(F.col(year).between(F.col("_y0"), F.col("_y1"))).drop("_y0", "_y1")


def locate_sample(idx: DataFrame, per_fire: DataFrame, *, index: str = "global_idx",
                  count: str = "n_samples", offset: str = "offset",
                  keys: Sequence[str] = ("year", "fire_id")) -> DataFrame:
    """C17: global sample index -> (year, fire, in-fire index).  Negative indexes count from
    the end; an index out of range raises.

    The per-fire table is expanded to one row per sample (the size of the dataset index
    itself) and equi-joined, so each lookup is a hash match, not a range scan.
    """
    total = per_fire.select(F.sum(count)).scalar()
    norm = F.when(F.col(index) < 0, F.col(index) + total).otherwise(F.col(index))
    q = idx.withColumn("_g", norm)
    bad = (F.col("_g") < 0) | (F.col("_g") >= total)
    q = q.withColumn("_g", F.when(bad, F.raise_error(F.lit("sample index out of range"))).otherwise(F.col("_g")))
    ex = per_fire.select(*keys, F.col(count), F.col(offset).alias("_off"),
                         F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("in_fire_idx")
                         ).filter(F.col(count) > 0)
    ex = ex.withColumn("_g", F.col("_off") + F.col("in_fire_idx"))
    return q.join(ex, "_g", "left").drop("_g", "_off")


# Names of the 23 raster bands in band-index order.
BAND_NAMES = [
    "M11", "I2", "I1", "NDVI", "EVI2", "total precipitation", "wind speed", "wind direction",
    "minimum temperature", "maximum temperature", "energy release component", "specific humidity",
    "slope", "aspect", "elevation", "pdsi", "landcover class", "forecast total precipitation",
    "forecast wind speed", "forecast wind direction", "forecast temperature",
    "forecast specific humidity", "active fire",
]


def with_band_names(pixels_long: DataFrame, band: str = "band") -> DataFrame:
    """Band index -> band name (broadcast join with the fixed 23-row dictionary)."""
    spark = pixels_long.sparkSession
    names = spark.createDataFrame(list(enumerate(BAND_NAMES)), f"{band} int, band_name string")
    return pixels_long.join(F.broadcast(names), band, "left")
