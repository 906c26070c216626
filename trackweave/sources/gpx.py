"""GPX files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The elements of GPX 1.1 that are read.
POINT = "struct<_lat: double, _lon: double, ele: double, time: string>"
DOCUMENT = f"metadata struct<name: string>, trk array<struct<name: string, trkseg: array<struct<trkpt: array<{POINT}>>>>>"


def points(spark: SparkSession, path: str) -> DataFrame:
    """(file, track_idx, name, segment_idx, vertex_idx, lon, lat, elevation, time) of all points of all files, numbered in their order.

    A track without a name has its file's. A file that is no XML gives no rows. A file is read by one task as one row.
    """
    rows = spark.read.format("xml").schema(DOCUMENT).option("rowTag", "gpx").option("ignoreNamespace", True).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    tracks = rows.select("file", "metadata.name", F.posexplode("trk").alias("track_idx", "t"))
    segments = tracks.select("file", "track_idx", F.coalesce("t.name", "name").alias("name"), F.posexplode("t.trkseg").alias("segment_idx", "s"))
    each = segments.select("file", "track_idx", "name", "segment_idx", F.posexplode("s.trkpt").alias("vertex_idx", "p"))
    return each.select("file", "track_idx", "name", "segment_idx", "vertex_idx", F.col("p._lon").alias("lon"), F.col("p._lat").alias("lat"), F.col("p.ele").alias("elevation"), F.col("p.time").cast("timestamp").alias("time"))
