"""Points, boxes and flattened lines of routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.runs import in_order


def bounding_boxes(points: DataFrame, by: str = "route_id") -> DataFrame:
    """(by, min_lon, min_lat, max_lon, max_lat); groups without points have no row."""
    return points.groupBy(by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lon", "lat")))


def vertices(features: DataFrame) -> DataFrame:
    """(route_id, seg_idx, vertex_idx, lon, lat) of every line vertex, in feature order."""
    each = features.select("route_id", "seg_idx", F.posexplode("coordinates").alias("vertex_idx", "c"))
    return each.select("route_id", "seg_idx", "vertex_idx", F.get("c", F.lit(0)).alias("lon"), F.get("c", F.lit(1)).alias("lat"))


def flattened(features: DataFrame) -> DataFrame:
    """(route_id, coordinates): all vertices of a route as one value. For exports of single routes."""
    return features.filter(F.size("coordinates") > 0).groupBy("route_id").agg(F.flatten(in_order(F.col("coordinates"), ["seg_idx"])).alias("coordinates"))


def ends(points: DataFrame, order: list[str], circular: bool = False) -> DataFrame:
    """(route_id, origin, destination, n_via): as first_last_via, without gathering a route's points."""
    point, at = F.struct("lat", "lon"), F.struct(*order)
    first, last, n = F.min_by(point, at), F.max_by(point, at), F.count("*")
    via = n - 1 if circular else F.greatest(n - 2, F.lit(0))
    return points.groupBy("route_id").agg(first.alias("origin"), (first if circular else last).alias("destination"), via.alias("n_via"))


def first_last_via(points: DataFrame, order: list[str], circular: bool = False) -> DataFrame:
    """(route_id, origin, destination, via): ends of a route's waypoints and what is between, for requests of few stops.

    A circular route ends where it starts, so all but the first point are on the way.
    """
    rows = points.groupBy("route_id").agg(in_order(F.struct("lat", "lon"), order).alias("p"))
    n = F.size("p")
    via = F.slice("p", F.lit(2), n - 1) if circular else F.slice("p", F.lit(2), F.greatest(n - 2, F.lit(0)))
    end = F.get("p", F.lit(0)) if circular else F.get("p", n - 1)
    return rows.select("route_id", F.get("p", F.lit(0)).alias("origin"), end.alias("destination"), via.alias("via"))
