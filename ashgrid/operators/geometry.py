"""Table-level geometry operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashgrid.functions.columns import col_of


def padded_extent(df: DataFrame, group: str, pad: float = 0.1, lat: str = "lat", lon: str = "lon",
                  time: str = "time") -> DataFrame:
    """Per group the min/max lat and lon padded by ``pad`` degrees, the start of the first
    day and the start of the day after the last reading."""
    return df.groupBy(group).agg(
        (F.min(lat) - pad).alias("lat_min"), (F.max(lat) + pad).alias("lat_max"),
        (F.min(lon) - pad).alias("lon_min"), (F.max(lon) + pad).alias("lon_max"),
        F.min(time).cast("date").cast("timestamp_ntz").alias("t0"),
        (F.max(time) + F.expr("interval 1 day")).cast("date").cast("timestamp_ntz").alias("t1"))


# WGS84 equatorial radius (m) used for polygon areas on the sphere.
AREA_RADIUS = 6378137.0

# Outline of the contiguous United States (lon, lat), ring closed.
USA_RING = [
    (-125.1803892906456, 35.26328285844432), (-117.08916345892665, 33.2311514593429),
    (-114.35640058749676, 32.92199940444295), (-110.88773544819885, 31.612036247094473),
    (-108.91086200144109, 31.7082477979397), (-106.80030780089378, 32.42079476218232),
    (-103.63413436750255, 29.786401496314422), (-101.87558377066483, 30.622527701868453),
    (-99.40039768482492, 28.04018292597704), (-98.69085295525215, 26.724810345780593),
    (-96.42355704777482, 26.216515704595633), (-80.68508661702214, 24.546812350183075),
    (-75.56173032587596, 26.814533788629998), (-67.1540159827795, 44.40095539443753),
    (-68.07548734644243, 46.981170472447374), (-69.17500995805074, 46.98158998130476),
    (-70.7598785138901, 44.87172183866657), (-74.84994741250935, 44.748084983808),
    (-77.62168256782745, 43.005725611950055), (-82.45987924104175, 41.41068867019324),
    (-83.38318501671864, 42.09979904377044), (-82.5905167831457, 45.06163491639556),
    (-84.83301910769038, 46.83552648258547), (-88.26350848510909, 48.143646480291835),
    (-90.06706251069104, 47.553445811024204), (-95.03745451438925, 48.9881557770297),
    (-98.45773319567587, 48.94699366043251), (-101.7018751401119, 48.98284560308372),
    (-108.43164852530356, 48.81973606668503), (-115.07339190755627, 48.93699058308441),
    (-121.82530604190744, 48.9830983403776), (-122.22085227110232, 48.63535795404536),
    (-124.59504332589562, 47.695726563030405), (-125.1803892906456, 35.26328285844432),
]


def _bound(value, use) -> Column:
    """``use(v)`` with ``value`` computed once a row: inside a lambda (or a filter that the optimizer writes a
    projection into) an expression is computed at every use, a lambda's variable is not."""
    return F.get(F.transform(F.array(col_of(value)), use), F.lit(0))


def _edges(ring):
    """Consecutive (x0, y0, x1, y1) of a closed ring column (array<struct<lon, lat>>)."""
    return _bound(ring, lambda r: F.transform(
        F.sequence(F.lit(1), F.size(r) - 1),
        lambda i: F.struct(F.element_at(r, i)["lon"].alias("x0"), F.element_at(r, i)["lat"].alias("y0"),
                           F.element_at(r, i + 1)["lon"].alias("x1"), F.element_at(r, i + 1)["lat"].alias("y1"))))


def polygon_area(ring, radius: float = AREA_RADIUS) -> Column:
    """Area (m^2) of a closed lon/lat ring on the sphere:
    R^2 / 2 * |sum (lon1 - lon0) * (2 + sin lat0 + sin lat1)| with angles in radians."""
    s = F.aggregate(_edges(ring), F.lit(0.0),
                    lambda acc, e: acc + (F.radians(e["x1"]) - F.radians(e["x0"]))
                    * (2 + F.sin(F.radians(e["y0"])) + F.sin(F.radians(e["y1"]))))
    return F.abs(s) * (radius * radius / 2)


def polygon_centroid(ring) -> tuple[Column, Column]:
    """Planar (shoelace) centroid (lon, lat) of a closed ring."""
    e = _edges(ring)

    def total(f):
        return F.aggregate(e, F.lit(0.0), lambda acc, s: acc + f(s))

    cross = (lambda s: s["x0"] * s["y1"] - s["x1"] * s["y0"])
    a = total(cross) / 2
    # a degenerate (zero-area) ring has no centroid: null rather than a division error
    cx = F.try_divide(total(lambda s: (s["x0"] + s["x1"]) * cross(s)), 6 * a)
    cy = F.try_divide(total(lambda s: (s["y0"] + s["y1"]) * cross(s)), 6 * a)
    return cx, cy


def inside_ring(lon: str, lat: str, ring: Sequence[tuple[float, float]] = USA_RING) -> Column:
    """Point-in-polygon by ray casting against a fixed ring, with a bounding-box shortcut.

    The ring's non-horizontal edges are one constant array (a few hundred bytes, broadcast
    with the plan); the crossing count is a fold over it, which keeps the generated code small
    whatever the number of vertices."""
    edges = [(x0, y0, x1, y1) for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]) if y0 != y1]
    arr = F.array(*[F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"),
                             F.lit(float(c)).alias("x1"), F.lit(float(d)).alias("y1")) for a, b, c, d in edges])
    x, y = F.col(lon), F.col(lat)

    def step(acc, e):
        hit = ((e["y0"] > y) != (e["y1"] > y)) & (x < (e["x1"] - e["x0"]) * (y - e["y0"]) / (e["y1"] - e["y0"]) + e["x0"])
        return acc + hit.cast("int")

    crossings = F.aggregate(arr, F.lit(0), step)
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    in_box = x.between(min(xs), max(xs)) & y.between(min(ys), max(ys))
    return in_box & (crossings % 2 == 1)


def polygons_in_region(df: DataFrame, ring_col: str = "ring",
                       ring: Sequence[tuple[float, float]] = USA_RING) -> DataFrame:
    """Keep the features whose closed polygon (array<struct<lon, lat>>) intersects the region polygon:
    a vertex of one lies inside the other, or two of their edges cross.  A polygon's edges are made once, not once
    per corner of the region."""
    poly = F.col(ring_col)
    region = F.array(*[F.struct(F.lit(float(a)).alias("x0"), F.lit(float(b)).alias("y0"),
                                F.lit(float(c)).alias("x1"), F.lit(float(d)).alias("y1"))
                       for (a, b), (c, d) in zip(ring[:-1], ring[1:])])

    def within(x, y, edges):
        def step(acc, e):
            # a horizontal edge never straddles y; the guarded division keeps it out of the arithmetic
            at = F.try_divide((e["x1"] - e["x0"]) * (y - e["y0"]), e["y1"] - e["y0"]) + e["x0"]
            return acc + (((e["y0"] > y) != (e["y1"] > y)) & (x < at)).cast("int")
        return F.aggregate(edges, F.lit(0), lambda acc, e: F.coalesce(step(acc, e), acc)) % 2 == 1

    def side(ax, ay, bx, by, cx, cy):
        return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)

    def cross(a, b):
        d1 = side(a["x0"], a["y0"], a["x1"], a["y1"], b["x0"], b["y0"])
        d2 = side(a["x0"], a["y0"], a["x1"], a["y1"], b["x1"], b["y1"])
        d3 = side(b["x0"], b["y0"], b["x1"], b["y1"], a["x0"], a["y0"])
        d4 = side(b["x0"], b["y0"], b["x1"], b["y1"], a["x1"], a["y1"])
        return (d1 * d2 < 0) & (d3 * d4 < 0)

    def meets(p):
        # p: ring, edges, and the ring's lowest and highest latitude.  A corner at another latitude has no edge of the
        # ring beside it, and region edges at other latitudes cross none
        corner_in = F.exists(region, lambda r: (p["low"] <= r["y0"]) & (p["high"] > r["y0"]) & within(r["x0"], r["y0"], p["edges"]))
        beside = F.filter(region, lambda b: (F.least(b["y0"], b["y1"]) <= p["high"]) & (F.greatest(b["y0"], b["y1"]) >= p["low"]))
        crossing = _bound(beside, lambda near_edges: F.exists(p["edges"], lambda a: F.exists(near_edges, lambda b: cross(a, b))))
        return F.exists(p["ring"], lambda v: within(v["lon"], v["lat"], region)) | corner_in | crossing

    lats = F.transform(poly, lambda v: v["lat"])
    known = F.struct(poly.alias("ring"), _edges(ring_col).alias("edges"), F.array_min(lats).alias("low"), F.array_max(lats).alias("high"))
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    lon, lat = F.transform(poly, lambda v: v["lon"]), F.transform(poly, lambda v: v["lat"])
    near = ((F.array_max(lon) >= min(xs)) & (F.array_min(lon) <= max(xs))
            & (F.array_max(lat) >= min(ys)) & (F.array_min(lat) <= max(ys)))
    return df.filter(near & _bound(known, meets))


def points_in_region(df: DataFrame, lon: str = "lon", lat: str = "lat",
                     ring: Sequence[tuple[float, float]] = USA_RING) -> DataFrame:
    """Keep the features whose point lies in the region polygon."""
    return df.filter(inside_ring(lon, lat, ring))
