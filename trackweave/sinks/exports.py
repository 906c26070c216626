"""GPX and GeoJSON documents, and snapshots of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave import snapshots
from trackweave.functions import text
from trackweave.functions.geo import feature  # noqa: F401
from trackweave.operators.runs import in_order


# The frame of a GPX 1.1 document.
FOOT = "    </trkseg>\n  </trk>\n</gpx>"


def gpx_head(name: Column, distance: Column) -> Column:
    """What comes before the points of a GPX 1.1 document of one track; the name is escaped."""
    title = text.escaped(F.coalesce(name, F.lit("")))
    return F.concat_ws(
        "\n",
        F.lit('<?xml version="1.0" encoding="UTF-8"?>'),
        F.lit('<gpx version="1.1" creator="trackweave" xmlns="http://www.topografix.com/GPX/1/1">'),
        F.lit("  <metadata>"),
        F.concat(F.lit("    <name>"), title, F.lit("</name>")),
        F.concat(F.lit("    <desc>Distance: "), distance, F.lit("</desc>")),
        F.lit("  </metadata>"),
        F.lit("  <trk>"),
        F.concat(F.lit("    <name>"), title, F.lit("</name>")),
        F.lit("    <trkseg>"),
    )


def gpx_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit('      <trkpt lat="'), text.plain_number(lat), F.lit('" lon="'), text.plain_number(lon), F.lit('"></trkpt>'))


def gpx_documents(points: DataFrame, order: list[str], meters: Column | None = None, name: str = "name") -> DataFrame:
    """(route_id, file, document) of points(route_id, name, lon, lat, ...), a value a route; files.write_gpx is for routes of any size.

    Routes without points have none.
    """
    rows = points.groupBy("route_id").agg(F.first(name).alias("name"), in_order(gpx_point(F.col("lon"), F.col("lat")), order).alias("points"), (F.lit(None).cast("double") if meters is None else F.first(meters)).alias("meters"))
    document = F.concat_ws("\n", gpx_head(F.col("name"), text.distance_text(F.col("meters"))), F.array_join("points", "\n"), F.lit(FOOT))
    return rows.select("route_id", F.concat(text.slug(F.col("name")), F.lit(".gpx")).alias("file"), document.alias("document"))


def collections_of(features: DataFrame, feature_column: str, order: list[str]) -> DataFrame:
    """(route_id, document): a FeatureCollection of a route's features, in order."""
    rows = features.groupBy("route_id").agg(in_order(F.col(feature_column), order).alias("features"))
    return rows.select("route_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("document"))


def save_permanent(tracks: DataFrame, path: str, read: int | None = None) -> int:
    """The permanent tracks' snapshot, as a new version at path; tracks may come from there. Its number."""
    return snapshots.save(tracks.filter("isPermanent"), path, read)


def save_all(table: DataFrame, path: str, read: int | None = None) -> int:
    """The snapshot of a whole collection: all tracks, or the custom profiles."""
    return snapshots.save(table, path, read)


def clear_saved(tracks: DataFrame, path: str) -> int:
    """An empty snapshot of tracks; profiles are left alone."""
    return snapshots.save(tracks.limit(0), path)
