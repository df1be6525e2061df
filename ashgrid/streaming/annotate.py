"""The sensor annotation job as a Structured Streaming query.

Sensor CSV files are read in bounded chunks (``maxBytesPerTrigger``), parsed, given their site id and
the key of their 1-degree x month cube.  The grid lies in Parquet tiles, one folder per block of time
steps, rows and columns; every micro-batch reads only the tiles that its readings touch, keeps the
recent ones, joins them on the cell index and writes its own output folder, so a restarted or failed
run resumes where it stopped.  ``trigger(availableNow=True)`` drains the backlog and stops.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ashgrid.functions.columns import normalise_sensor, site_id
from ashgrid.operators.joins import (RegularAxis, corner_table, hours_since, lower_index, nearest_index, sample_linear,
                                     sample_nearest)
from ashgrid.operators.quality import quarantine
from ashgrid.operators.sequences import cube_key
from ashgrid.sources.files import RAW_SENSOR_SCHEMA, path_exists

__all__ = ["TiledGrid", "write_tiled_grid", "TileCache", "sensor_stream", "stream_annotate", "stream_quarantine"]


BYTES_PER_TRIGGER = 1 << 30


def static_grid(grid: DataFrame, values: Sequence[str], method: str, timed: bool) -> DataFrame:
    """The grid as the stream joins it: cells for nearest sampling, packed corners for linear."""
    if method != "linear":
        return grid
    return corner_table(grid, values, [*(["t"] if timed else []), "y", "x"])


@dataclass(frozen=True)
class TiledGrid:
    """A grid (or, for ``method="linear"``, its packed corners) in Parquet, one folder per tile of
    ``size`` time steps, rows and columns (S1, S2, A4)."""

    spark: SparkSession
    path: str
    schema: T.StructType
    method: str
    timed: bool
    size: tuple[int, int, int]

    def tile(self, indexes: Sequence[Column]) -> list[Column]:
        """Tile of a cell, from its (step, row, column) or (row, column)."""
        return [F.floor(i / n).cast("long") for i, n in zip(indexes, self.size[-len(indexes):])]

    def folder(self, tile: Sequence[int]) -> str:
        return "/".join([self.path, *[f"{n}={k}" for n, k in zip(tile_names(self.timed), tile)]])

    def read(self, tiles: Sequence[Sequence[int]]) -> DataFrame | None:
        """The cells of the given tiles; only their folders are listed and read.  None if none of them exists."""
        there = [f for f in map(self.folder, tiles) if path_exists(self.spark, f)]
        return self.spark.read.schema(self.schema).parquet(*there) if there else None


def tile_names(timed: bool) -> list[str]:
    return [*(["tile_t"] if timed else []), "tile_y", "tile_x"]


def write_tiled_grid(grid: DataFrame, path: str, values: Sequence[str], method: str = "nearest", timed: bool = True,
                     size: tuple[int, int, int] = (240, 16, 16)) -> TiledGrid:
    """A4 as a sink: ``grid`` (t, y, x and ``values``) written as tiles; an existing tile is replaced as a whole."""
    dims = [*(["t"] if timed else []), "y", "x"]
    cells = static_grid(grid, values, method, timed)
    tiled = TiledGrid(grid.sparkSession, path.rstrip("/"), T.StructType(cells.schema.fields), method, timed, size)
    names = tile_names(timed)
    placed = cells.withColumns(dict(zip(names, tiled.tile([F.col(d) for d in dims]))))
    (placed.repartition(*names).sortWithinPartitions(*names, *dims)
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*names).parquet(tiled.path))
    return tiled


@dataclass
class TileCache:
    """The tiles that recent batches needed, at most ``limit`` of them (the least recently used go first).

    A batch of bounded size touches a bounded number of tiles; their keys come to the driver."""

    grid: TiledGrid
    limit: int = 4096
    groups: list[tuple[set, DataFrame]] = field(default_factory=list)

    def cells(self, keys: set) -> DataFrame:
        """Cells of all tiles in ``keys`` (and of others that were read together with them)."""
        missing = keys - set().union(*[k for k, _ in self.groups])
        if missing:
            got = self.grid.read(sorted(missing))
            got = self.grid.spark.createDataFrame([], self.grid.schema) if got is None else got.persist()
            self.groups.append((missing, got))
        used = [g for g in self.groups if g[0] & keys]
        self.groups = [g for g in self.groups if not g[0] & keys] + used
        while len(self.groups) > len(used) and sum(len(k) for k, _ in self.groups) > self.limit:
            self.groups.pop(0)[1].unpersist()
        frames = [df for _, df in used]
        out = frames[0] if frames else self.grid.spark.createDataFrame([], self.grid.schema)
        for df in frames[1:]:
            out = out.unionByName(df)
        return out

    def clear(self) -> None:
        while self.groups:
            self.groups.pop()[1].unpersist()


def sensor_stream(spark: SparkSession, src: str, schema: T.StructType = RAW_SENSOR_SCHEMA, keep: Sequence[str] = (),
                  max_bytes: int = BYTES_PER_TRIGGER, drop_bad_dates: bool = True) -> DataFrame:
    """Streaming DataFrame of parsed readings with site id and cube key."""
    raw = (spark.readStream.schema(schema).option("header", True)
                .option("maxBytesPerTrigger", max_bytes).csv(src))
    raw = raw.withColumn("site", site_id("State Code", "County Code", "Site Num"))
    obs = normalise_sensor(raw, keep=[*keep, "site"], drop_bad_dates=drop_bad_dates)
    return obs.withColumn("cube", cube_key("lat", "lon", "time"))


def sampled(batch: DataFrame, cache: TileCache, lat_axis: RegularAxis, lon_axis: RegularAxis, values: Sequence[str],
            time_axis: RegularAxis | None = None, time_origin=None) -> DataFrame:
    """A batch of readings with the grid's values, sampled at the nearest cell or interpolated, in time as
    well with ``time_axis`` (hours since ``time_origin``).  Only the tiles of its readings are read."""
    linear = cache.grid.method == "linear"
    index = (lambda v, axis: lower_index(v, axis)[0]) if linear else nearest_index
    at = [index("lat", lat_axis), index("lon", lon_axis)]
    if time_axis is not None:
        at.insert(0, index(hours_since("time", time_origin), time_axis))
    names = tile_names(time_axis is not None)
    keys = batch.select(*[c.alias(n) for n, c in zip(names, cache.grid.tile(at))]).dropna().distinct().collect()
    cells = cache.cells({tuple(k) for k in keys})
    timed = dict(time_axis=time_axis, time_origin=time_origin) if time_axis is not None else {}
    if linear:
        return sample_linear(batch, cells, lat_axis, lon_axis, values, packed=True, **timed)
    return sample_nearest(batch, cells, lat_axis, lon_axis, values, **timed)


def _run(stream: DataFrame, grid: DataFrame | TiledGrid, checkpoint: str, values: Sequence[str], method: str, timed: bool, write) -> TileCache:
    """Run ``write(batch, batch id, cache)`` over the stream.  A grid that is not tiled yet is written as
    tiles beside the stream's checkpoint first."""
    tiled = grid if isinstance(grid, TiledGrid) else write_tiled_grid(grid, f"{checkpoint.rstrip('/')}-grid", values, method, timed)
    cache = TileCache(tiled)

    def sink(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # read for its tiles and for its rows
        try:
            write(held, batch_id, cache)
        finally:
            held.unpersist()

    try:
        q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
                   .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        cache.clear()
    return cache


def stream_annotate(spark: SparkSession, src: str, out: str, checkpoint: str, grid: DataFrame | TiledGrid,
                    lat_axis: RegularAxis, lon_axis: RegularAxis, values: Sequence[str],
                    schema: T.StructType = RAW_SENSOR_SCHEMA, keep: Sequence[str] = (),
                    max_bytes: int = BYTES_PER_TRIGGER, method: str = "nearest",
                    time_axis: RegularAxis | None = None, time_origin=None) -> None:
    """Annotate every sensor file under ``src`` with the grid's values and write Parquet to ``out``.

    Each micro-batch overwrites its own ``batch=<id>`` folder, so a retried batch does not duplicate rows,
    and reads only the tiles of the grid that its readings touch (see ``TileCache``)."""
    def write(batch: DataFrame, batch_id: int, cache: TileCache) -> None:
        got = sampled(batch, cache, lat_axis, lon_axis, values, time_axis, time_origin)
        got.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(sensor_stream(spark, src, schema, keep, max_bytes), grid, checkpoint, values, method, time_axis is not None, write)


def stream_quarantine(spark: SparkSession, src: str, out: str, checkpoint: str, grid: DataFrame | TiledGrid,
                      lat_axis: RegularAxis, lon_axis: RegularAxis, values: Sequence[str],
                      schema: T.StructType = RAW_SENSOR_SCHEMA, keep: Sequence[str] = (),
                      max_bytes: int = BYTES_PER_TRIGGER, time_axis: RegularAxis | None = None, time_origin=None) -> None:
    """As S1, but rows failing a check go to ``out/rejected`` with a reason and the rest to
    ``out/good``; each micro-batch overwrites its own ``batch=<id>`` folder, so a retried batch
    does not duplicate rows.  ``out/report/batch=<id>`` has rows and rejections per cube."""
    rules = [("bad_time", F.col("time").isNull()), ("missing_value", F.col("pm25").isNull()),
             ("outside_grid", F.col(values[0]).isNull())]

    def write(batch: DataFrame, batch_id: int, cache: TileCache) -> None:
        tagged = quarantine(sampled(batch, cache, lat_axis, lon_axis, values, time_axis, time_origin), rules).persist()
        tagged.filter(F.col("reason").isNull()).drop("reason").write.mode("overwrite").parquet(f"{out}/good/batch={batch_id}")
        tagged.filter(F.col("reason").isNotNull()).write.mode("overwrite").parquet(f"{out}/rejected/batch={batch_id}")
        (tagged.groupBy("cube").agg(F.count(F.lit(1)).alias("rows"), F.count("reason").alias("rejected"))
               .write.mode("overwrite").parquet(f"{out}/report/batch={batch_id}"))
        tagged.unpersist()

    _run(sensor_stream(spark, src, schema, keep, max_bytes, drop_bad_dates=False), grid, checkpoint, values, "nearest",
         time_axis is not None, write)
