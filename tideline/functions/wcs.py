"""Pixel numbers on flat projections (Calabretta & Greisen, 2002) as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project(kind: str, lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Plane coordinates in degrees of a direction in degrees: CAR, CEA, MER, SFL, ZEA or TAN."""
    d = lon - lon0
    d = d - 360.0 * F.floor((d + 180.0) / 360.0)
    if kind == "CAR":
        return d, lat - lat0
    if kind == "CEA":
        k = F.pow(F.cos(F.radians(F.lit(lat0))), 2)
        return d, F.degrees((F.sin(F.radians(lat)) - F.sin(F.radians(F.lit(lat0)))) / k)
    if kind == "MER":
        y = lambda c: F.degrees(F.log(F.tan(F.radians((90.0 + c) / 2))))
        return d, y(lat) - y(F.lit(lat0))
    if kind == "SFL":
        return d * F.cos(F.radians(lat)), lat - lat0
    a, b, b0 = F.radians(d), F.radians(lat), F.radians(F.lit(lat0))
    east = F.cos(b) * F.sin(a)
    north = F.sin(b) * F.cos(b0) - F.cos(b) * F.sin(b0) * F.cos(a)
    along = F.sin(b) * F.sin(b0) + F.cos(b) * F.cos(b0) * F.cos(a)
    if kind == "TAN":
        seen = along > 0
        return F.when(seen, F.degrees(east / along)), F.when(seen, F.degrees(north / along))
    if kind == "ZEA":
        s = F.sqrt(2 / (1 + along))
        return F.when(along > -1, F.degrees(east * s)), F.when(along > -1, F.degrees(north * s))
    raise ValueError(f"no projection {kind}")


def wcs_pixel(kind: str, lon: Column, lat: Column, center: tuple[float, float], size: tuple[int, int], resolution: float) -> Column:
    """row-major pixel: column counted against longitude; -1 outside the image in either direction."""
    x, y = project(kind, lon, lat, *center)
    col = F.floor(-x / resolution + size[0] / 2.0)
    row = F.floor(y / resolution + size[1] / 2.0)
    inside = (col >= 0) & (col < size[0]) & (row >= 0) & (row < size[1])
    return F.when(F.coalesce(inside, F.lit(False)), col + row * size[0]).otherwise(-1).cast("long")
