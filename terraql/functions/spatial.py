"""Points on the sphere: distances, boxes and cells."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(x, F.lit(1.0))))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point on a sphere of radius 1."""
    a, o = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


def box(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    """A filter of plain comparisons, fit to be pushed to a scan, that holds all points within the distance."""
    dlat = math.degrees(km / EARTH_KM) * 1.000001
    near = lat.between(at[0] - dlat, at[0] + dlat)
    top = min(abs(at[0]) + dlat, 90.0)
    if top >= 90:
        return near
    ratio = math.sin(km / EARTH_KM) / math.cos(math.radians(at[0])) if km / EARTH_KM < math.pi / 2 else 1.0
    if ratio >= 1:
        return near
    dlon = math.degrees(math.asin(ratio)) * 1.000001
    low, high = at[1] - dlon, at[1] + dlon
    if low < -180 or high > 180:  # around the date line
        return near & ((lon >= (low + 540) % 360 - 180) | (lon <= (high + 540) % 360 - 180))
    return near & lon.between(low, high)


def within(lat: Column, lon: Column, at: tuple[float, float], km: float) -> Column:
    return box(lat, lon, at, km) & (haversine(lat, lon, F.lit(at[0]), F.lit(at[1])) <= km)


def cell(lat: Column, lon: Column, degrees: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of a point."""
    return F.floor((lat + 90) / degrees).cast("int"), F.floor((lon + 180) / degrees).cast("int")


def z_order(row: Column, column: Column, bits: int = 16) -> Column:
    """Bits of two small numbers in turn, the row's above the column's."""
    out = F.lit(0).cast("bigint")
    for b in range(bits):
        for x, at in ((column, 2 * b), (row, 2 * b + 1)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x.cast("bigint"), b).bitwiseAND(F.lit(1).cast("bigint")), at))
    return out


#: What readers of points give.
POINT = "struct<lat:double,lon:double>"
NUMBER = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def _point(lat: Column, lon: Column) -> Column:
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def from_geojson(text: Column) -> Column:
    """A point from ``{"type": "Point", "coordinates": [lon, lat]}``; NULL for anything else."""
    read = F.from_json(text, "type string, coordinates array<double>")
    at = read["coordinates"]
    return F.when(read["type"] == "Point", _point(F.get(at, F.lit(1)), F.get(at, F.lit(0))))


def from_wkt(text: Column) -> Column:
    """A point from ``POINT (lon lat)``; NULL for anything else."""
    form = rf"(?i)^\s*POINT\s*Z?\s*\(\s*{NUMBER}\s+{NUMBER}(?:\s+{NUMBER})?\s*\)\s*$"
    lon, lat = (F.regexp_extract(text, form, i).try_cast("double") for i in (1, 2))
    return _point(lat, lon)


def to_wkb() -> Callable:
    """Points as 21 bytes: little-endian, type 1, longitude, latitude."""

    @F.arrow_udf("binary")
    def packed(lat: pa.Array, lon: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else b"\x01\x01\x00\x00\x00" + np.array([b, a], "<f8").tobytes() for a, b in zip(lat.to_pylist(), lon.to_pylist(), strict=True)], pa.binary())

    return packed


def from_wkb() -> Callable:
    """Points from their binary form in either byte order; NULL for anything else."""

    @F.arrow_udf(POINT)
    def read(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            order = {0: ">", 1: "<"}.get(x[0]) if x is not None and len(x) >= 21 else None
            if order is None or np.frombuffer(x, order + "u4", 1, 1)[0] % 1000 != 1:
                out.append(None)
            else:
                lon, lat = np.frombuffer(x, order + "f8", 2, 5).tolist()
                out.append({"lat": lat, "lon": lon})
        return pa.array(out, pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))

    return read
