"""Geometry on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree of longitude at the equator and of a degree of latitude.
METRES_LON, METRES_LAT = 111320.0, 110540.0


def to_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    k = METRES_LON * math.cos(math.radians(lat0))
    return (lon - F.lit(lon0)) * F.lit(k), (lat - F.lit(lat0)) * F.lit(METRES_LAT)


def to_degrees(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    k = METRES_LON * math.cos(math.radians(lat0))
    return x / F.lit(k) + F.lit(lon0), y / F.lit(METRES_LAT) + F.lit(lat0)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile numbers, with fractions."""
    n = 2.0**zoom
    r = F.radians(lat)
    return (lon + 180) / 360 * n, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    n = 2.0**zoom
    return x / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y / n))))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def ring_area(ring: Column) -> Column:
    """Area inside a ring of (x, y) structs, closed or not, by the shoelace rule."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def ring_perimeter(ring: Column) -> Column:
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, shifted, lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def round_significant(x: Column, digits: int = 2) -> Column:
    """x with so many significant digits; null for null, not-a-number and infinite values."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.round(x * scale) / scale)


def parse_lat_lon(text: Column) -> Column:
    """A struct (lat, lon) of text like "1.5, 30.2" within range, else null."""
    form = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*,\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    part = lambda i: F.regexp_extract(text, form, i).try_cast("double")
    lat, lon = part(1), part(2)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def coordinate_status(lon: Column, lat: Column, envelope: Column, attr_lon: Column, attr_lat: Column, tolerance: float) -> Column:
    """reported, unknown or conflict: a place that is null, not finite or outside the envelope of its province, a struct (west,
    south, east, north), is unknown; one apart from its attribute coordinates by over the tolerance is a conflict. Attribute
    coordinates that are null don't count."""
    inside = lon.between(envelope["west"], envelope["east"]) & lat.between(envelope["south"], envelope["north"]) & ~F.isnan(lon) & ~F.isnan(lat)
    apart = F.coalesce(F.abs(attr_lon - lon) > tolerance, F.lit(False)) | F.coalesce(F.abs(attr_lat - lat) > tolerance, F.lit(False))
    return F.when(~F.coalesce(inside, F.lit(False)), "unknown").when(apart, "conflict").otherwise("reported")


def densified(ax: Column, ay: Column, bx: Column, by: Column, step: float, middle: bool) -> Column:
    """Points along a segment at most step apart: at s/steps from 0 to steps, or the middles of its steps, each with the length it stands for."""
    length = distance(ax, ay, bx, by)
    steps = F.greatest(F.lit(1), F.ceil(length / step)).cast("int")
    share = lambda s: ((s + 0.5) if middle else s) / steps
    return F.transform(F.sequence(F.lit(0), steps - 1 if middle else steps), lambda s: F.struct(s.alias("s"), (ax + (bx - ax) * share(s)).alias("x"), (ay + (by - ay) * share(s)).alias("y"), (length / steps).alias("length")))
