"""Great-circle and planar geometry as columns; coordinates are degrees, arrays are [lon, lat]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METERS = 6_371_000.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points on a sphere."""
    up = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    across = F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across
    return F.lit(2 * EARTH_METERS) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def lerp(a: Column, b: Column, share: Column) -> Column:
    """The value at a share of the way, planar in degrees."""
    return a + (b - a) * share


def parts(geometry_type: Column, coordinates: Column) -> Column:
    """The lines of a LineString (one) or a MultiLineString, each with its vertices, from variant coordinates; else null."""
    single = F.try_variant_get(coordinates, "$", "array<array<double>>")
    several = F.try_variant_get(coordinates, "$", "array<array<array<double>>>")
    return F.when((geometry_type == "LineString") & single.isNotNull(), F.array(single)).when(geometry_type == "MultiLineString", several)


def lines(geometry_type: Column, coordinates: Column) -> Column:
    """All vertices of parts(), line after line: for boxes and exports. What is between two lines is no road."""
    return F.flatten(parts(geometry_type, coordinates))


def pairs(coordinates: Column) -> Column:
    """Neighbouring vertices of one line, as structs from and to."""
    n = F.size(coordinates)
    none = F.array().cast("array<struct<from:array<double>,to:array<double>>>")
    each = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(coordinates, i).alias("from"), F.get(coordinates, i + 1).alias("to")))
    return F.when(n >= 2, each).otherwise(none)


def line_length(coordinates: Column) -> Column:
    """Metres along one line."""
    step = lambda p: haversine(p["from"][0], p["from"][1], p["to"][0], p["to"][1])
    return F.aggregate(pairs(coordinates), F.lit(0.0), lambda s, p: s + step(p))


def lines_length(parts_: Column) -> Column:
    """Metres along several lines, without what is between them."""
    return F.aggregate(parts_, F.lit(0.0), lambda s, line: s + F.coalesce(line_length(line), F.lit(0.0)))


def mid_vertex(coordinates: Column) -> Column:
    """The vertex at floor(n / 2), null for an empty line."""
    return F.get(coordinates, F.floor(F.size(coordinates) / 2).cast("int"))


def feature(geometry: str, coordinates: Column, properties: Column) -> Column:
    """A GeoJSON feature."""
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties"))
