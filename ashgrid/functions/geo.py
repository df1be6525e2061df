"""Geometry and map-projection column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ashgrid.functions.columns import col_of

__all__ = [
    "degree_box", "km_box", "web_mercator_x", "web_mercator_y", "inverse_mercator_lon",
    "inverse_mercator_lat", "LambertSpec", "lambert_xy", "cell_coords", "raster_centre",
    "EARTH_RADIUS_SPHERE", "WEB_MERCATOR_RADIUS",
]

# Spherical radii (metres) and metres per degree of latitude.
EARTH_RADIUS_SPHERE = 6370997.0
WEB_MERCATOR_RADIUS = 6378137.0
METRES_PER_DEGREE = 111320.0


def degree_box(lon, lat, half: float) -> Column:
    """G1: struct(min_lon, min_lat, max_lon, max_lat) of a +/- half-degree box."""
    lon, lat = col_of(lon), col_of(lat)
    return F.struct((lon - half).alias("min_lon"), (lat - half).alias("min_lat"),
                    (lon + half).alias("max_lon"), (lat + half).alias("max_lat"))


def km_box(lon, lat, radius_m: float) -> Column:
    """Bounds of a metric buffer using metres per degree and cos(latitude) for longitude."""
    lon, lat = col_of(lon), col_of(lat)
    dlat = F.lit(radius_m / METRES_PER_DEGREE)
    dlon = F.try_divide(F.lit(radius_m), F.lit(METRES_PER_DEGREE) * F.cos(F.radians(lat)))   # null at the poles
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"),
                    (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def web_mercator_x(lon) -> Column:
    """EPSG:4326 longitude -> EPSG:3857 x (metres)."""
    return F.radians(col_of(lon)) * WEB_MERCATOR_RADIUS


def web_mercator_y(lat) -> Column:
    """EPSG:4326 latitude -> EPSG:3857 y (metres)."""
    return F.ln(F.tan(F.lit(math.pi / 4) + F.radians(col_of(lat)) / 2)) * WEB_MERCATOR_RADIUS


def inverse_mercator_lon(x) -> Column:
    return F.degrees(col_of(x) / WEB_MERCATOR_RADIUS)


def inverse_mercator_lat(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(col_of(y) / WEB_MERCATOR_RADIUS)) - math.pi / 2)


@dataclass(frozen=True)
class LambertSpec:
    """Lambert Conformal Conic grid description (two standard parallels, sphere)."""

    p_alp: float          # first standard parallel
    p_bet: float          # second standard parallel
    xcent: float          # central meridian
    ycent: float          # latitude of origin
    xorig: float          # x of the lower-left grid corner (m)
    yorig: float          # y of the lower-left grid corner (m)
    xcell: float          # cell width (m)
    ycell: float          # cell height (m)
    ncols: int
    nrows: int
    radius: float = EARTH_RADIUS_SPHERE

    def constants(self) -> tuple[float, float, float]:
        """(n, F, rho0) of the spherical LCC forward formulas."""
        p1, p2, p0 = (math.radians(v) for v in (self.p_alp, self.p_bet, self.ycent))
        if abs(p1 - p2) < 1e-12:
            n = math.sin(p1)
        else:
            n = (math.log(math.cos(p1) / math.cos(p2))
                 / math.log(math.tan(math.pi / 4 + p2 / 2) / math.tan(math.pi / 4 + p1 / 2)))
        f = math.cos(p1) * math.tan(math.pi / 4 + p1 / 2) ** n / n
        rho0 = self.radius * f / math.tan(math.pi / 4 + p0 / 2) ** n
        return n, f, rho0


def lambert_xy(lon, lat, spec: LambertSpec) -> tuple[Column, Column]:
    """Spherical Lambert Conformal Conic forward projection, metres (false origin 0, 0)."""
    n, f, rho0 = spec.constants()
    phi = F.radians(col_of(lat))
    rho = F.lit(spec.radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + phi / 2), F.lit(n))
    theta = F.lit(n) * F.radians(col_of(lon) - spec.xcent)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def cell_coords(row, col, a: float, b: float, c: float, d: float, e: float, f: float,
                centre: bool = True) -> tuple[Column, Column]:
    """Affine index -> coordinate: x = a*col + b*row + c, y = d*col + e*row + f.

    With ``centre`` the half-cell offset of a pixel centre is added.
    """
    off = 0.5 if centre else 0.0
    cc, rr = col_of(col) + off, col_of(row) + off
    return cc * a + rr * b + c, cc * d + rr * e + f


def raster_centre(left, bottom, right, top, crs_is_4326) -> tuple[Column, Column]:
    """Centre (lon, lat) of raster bounds; bounds in Web Mercator are projected back."""
    cx = (col_of(left) + col_of(right)) / 2
    cy = (col_of(bottom) + col_of(top)) / 2
    geo = col_of(crs_is_4326)
    return (F.when(geo, cx).otherwise(inverse_mercator_lon(cx)),
            F.when(geo, cy).otherwise(inverse_mercator_lat(cy)))
