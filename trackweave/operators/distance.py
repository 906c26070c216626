"""Running distance, markers at fixed intervals, and lengths of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators.ordered import with_previous, with_running_sum

INTERVAL_METERS = 5000


def running_distance(segments: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """segments with after, the distance covered with each one, and before, without it."""
    rows = with_running_sum(segments, ["route_id"], order, F.col("distance"), "after", bucket)
    return rows.withColumn("before", F.col("after") - F.col("distance"))


def distance_markers(measured: DataFrame, interval: int = INTERVAL_METERS) -> DataFrame:
    """A row for each multiple of interval with before < k * interval <= after, with its number and share.

    measured has before, after and distance. One piece can hold several markers; a piece that ends
    on a multiple holds that one, at share 1. Pieces of no length hold none.
    """
    low, high = (F.floor(F.col("before") / interval) + 1).cast("bigint"), F.floor(F.col("after") / interval).cast("bigint")
    marks = F.when((high >= low) & (F.col("distance") > 0), F.sequence(low, high))
    rows = measured.withColumn("marker", F.explode(marks))
    return rows.withColumn("share", (F.col("marker") * interval - F.col("before")).cast("double") / F.col("distance").cast("double"))


def _lines(features: DataFrame) -> Column:
    """The lines of each feature: column parts, or coordinates as one line where there are no parts."""
    return F.col("parts") if "parts" in features.columns else F.array("coordinates")


def vertex_pairs(features: DataFrame, *more: str) -> DataFrame:
    """(route_id, seg_idx, line_idx, pair_idx, from, to, distance, and columns named in more) of neighbouring vertices inside each line of each feature.

    features has parts (lines of vertices) or coordinates (one line).
    """
    each = features.select("route_id", "seg_idx", *more, F.posexplode(_lines(features)).alias("line_idx", "line"))
    each = each.select("route_id", "seg_idx", *more, "line_idx", F.posexplode(geo.pairs(F.col("line"))).alias("pair_idx", "pair"))
    each = each.select("route_id", "seg_idx", *more, "line_idx", "pair_idx", "pair.from", "pair.to")
    return each.withColumn("distance", geo.haversine(F.col("from")[0], F.col("from")[1], F.col("to")[0], F.col("to")[1]))


def route_markers(features: DataFrame, interval: int = INTERVAL_METERS, bucket: str | None = None) -> DataFrame:
    """(route_id, marker, label, lon, lat): markers along the vertices of a route's line features.

    Distance runs on over all lines and features of a route, but the gap between two of them does not count.
    label is the distance in kilometres. bucket: a column of features that cuts a route in its order.
    """
    more = [bucket] if bucket not in (None, "seg_idx") else []
    measured = running_distance(vertex_pairs(features, *more), ["seg_idx", "line_idx", "pair_idx"], bucket)
    found = distance_markers(measured, interval)
    km = F.col("marker") * (interval / 1000)
    label = F.when(km == F.floor(km), km.cast("bigint").cast("string")).otherwise(km.cast("string"))
    at = [geo.lerp(F.col("from")[i], F.col("to")[i], F.col("share")) for i in (0, 1)]
    return found.select("route_id", *more, "marker", label.alias("label"), at[0].alias("lon"), at[1].alias("lat"))


def route_lengths(features: DataFrame) -> DataFrame:
    """(route_id, meters): lengths inside the lines of features, summed."""
    return features.select("route_id", geo.lines_length(_lines(features)).alias("m")).groupBy("route_id").agg(F.sum("m").alias("meters"))


def point_pairs(points: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """points(route_id, lon, lat, ...) with the metres from the point before (null at the first)."""
    rows = with_previous(points, ["route_id"], order, F.struct("lon", "lat"), "__prev", bucket)
    p = F.col("__prev.value")
    return rows.withColumn("meters", geo.haversine(p["lon"], p["lat"], F.col("lon"), F.col("lat"))).drop("__prev")
