"""Grid cells and distances (F-20, F-21)."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotline.functions.numbers import rounded

REFERENCE_LAT, CELL_M, M_PER_LAT, EARTH_KM = 40.4168, 350.0, 111_320.0, 6371.0088
M_PER_LON = M_PER_LAT * cos(radians(REFERENCE_LAT))


def cell_x(lon: Column, cell_m: float = CELL_M) -> Column:
    return F.floor(lon * F.lit(M_PER_LON) / F.lit(cell_m))


def cell_y(lat: Column, cell_m: float = CELL_M) -> Column:
    return F.floor(lat * F.lit(M_PER_LAT) / F.lit(cell_m))


def _code(i: Column) -> Column:
    return F.concat(F.when(i >= 0, "p").otherwise("m"), F.lower(F.conv(F.abs(i).cast("string"), 10, 36)))


def microzone_cell(lat: Column, lon: Column, cell_m: float = CELL_M) -> Column:
    """F-20: signed base-36 numbers of the cell, longitude first."""
    return F.concat(_code(cell_x(lon, cell_m)), F.lit("-"), _code(cell_y(lat, cell_m)))


def microzone_centroid(lat: Column, lon: Column, cell_m: float = CELL_M) -> Column:
    """F-20: struct(lat, lon) of the middle of the cell."""
    mid = lambda i, per: rounded((i + F.lit(0.5)) * F.lit(cell_m) / F.lit(per), 6)
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(mid(cell_y(lat, cell_m), M_PER_LAT).alias("lat"), mid(cell_x(lon, cell_m), M_PER_LON).alias("lon")))


def microzone_label(zone: Column, lat: Column, lon: Column) -> Column:
    """F-20: cell named after its zone; null without a point."""
    return F.concat(F.coalesce(zone, F.lit("Sin zona")), F.lit(" / MZ "), microzone_cell(lat, lon))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """F-21: great-circle distance; null if a coordinate is."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))
