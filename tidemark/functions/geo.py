"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6_371_000.0

# Fixed value: compass points, clockwise from north.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = (p2 - p1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def sphere_cell(lon: Column, lat: Column, size_m: float) -> list[Column]:
    """Cube of edge ``size_m`` that holds the point of the Earth's sphere: three numbers.

    A chord is never longer than its arc, so points within ``size_m`` lie in the same or in
    neighbouring cubes at any latitude and across the date line.
    """
    p, q = F.radians(lat), F.radians(lon)
    scale = EARTH_RADIUS_M / size_m
    return [F.floor(F.cos(p) * F.cos(q) * scale), F.floor(F.cos(p) * F.sin(q) * scale), F.floor(F.sin(p) * scale)]


def neighbour_cells(cell: list[Column]) -> Column:
    """The 27 cubes around one, as an array of structs x, y, z."""
    return F.array(*[F.struct((cell[0] + i).alias("x"), (cell[1] + j).alias("y"), (cell[2] + k).alias("z")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])


def lon_gap(a: Column, b: Column) -> Column:
    """Degrees between two longitudes, the short way round."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dl = F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def compass(deg: Column) -> Column:
    sector = F.floor(F.pmod(deg + 11.25, F.lit(360.0)) / 22.5).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), sector + 1)
