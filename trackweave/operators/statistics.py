"""Route statistics that the contract only describes; the reading chosen is in each docstring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ordered import with_previous


def share(where: Column) -> Column:
    """Aggregate: percentage of the length for which where holds."""
    return 100 * F.sum(F.when(where, F.col("distance")).otherwise(0)) / F.nullif(F.sum("distance"), F.lit(0))


def steep(limit: float = 6.0) -> Column:
    return share(F.abs("slope") > limit)


def slope() -> Column:
    return F.sum(F.col("slope") * F.col("distance")) / F.nullif(F.sum("distance"), F.lit(0))


def busy(least: float = 4.0) -> Column:
    return share(F.col("stress") >= least)


def rough() -> Column:
    return share(F.col("surface").startswith("UNPAVED") | (F.col("surface") == "PAVED_BAD"))


def summary(segments: DataFrame) -> DataFrame:
    """(route_id, steep, slope, traffic, rough): the four statistics below, in one pass."""
    return segments.groupBy("route_id").agg(steep().alias("steep"), slope().alias("slope"), busy().alias("traffic"), rough().alias("rough"))


def steep_share(segments: DataFrame, limit: float = 6.0) -> DataFrame:
    """(route_id, pct): share of the length whose slope is steeper than limit, up or down."""
    return segments.groupBy("route_id").agg(steep(limit).alias("pct"))


def mean_slope(segments: DataFrame) -> DataFrame:
    """(route_id, slope): weighted by length."""
    return segments.groupBy("route_id").agg(slope().alias("slope"))


def high_traffic_share(segments: DataFrame, least: float = 4.0) -> DataFrame:
    """(route_id, pct): share of the length with a stress of `least` or more, of 1 to 5."""
    return segments.groupBy("route_id").agg(busy(least).alias("pct"))


def rough_share(segments: DataFrame) -> DataFrame:
    """(route_id, pct): share of the length that is unpaved or badly paved."""
    return segments.groupBy("route_id").agg(rough().alias("pct"))


def climbs(points: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """(route_id, gain, loss): sums of rises and falls between neighbouring points, not smoothed.

    With a bucket (a piece of the order, such as a day) a hot route spreads over tasks.
    """
    before = with_previous(points, ["route_id"], order, F.col("elevation"), "__p", bucket)
    rows = before.select("route_id", (F.col("elevation") - F.col("__p.value")).alias("d"))
    part = lambda d: F.coalesce(F.sum(F.when(d > 0, d)).cast("double"), F.lit(0.0))
    return rows.groupBy("route_id").agg(part(F.col("d")).alias("gain"), part(-F.col("d")).alias("loss"))


def rolled_up(steps: DataFrame) -> DataFrame:
    """Distances and durations of steps, legs and routes; leg_idx is null for a route, both for a response."""
    return steps.rollup("response_id", "route_idx", "leg_idx").agg(F.sum("distanceMeters").alias("distanceMeters"), F.sum("durationSeconds").alias("durationSeconds")).filter("response_id IS NOT NULL")


def labelled(routes: DataFrame, by: str, key: str, duration: str, friendly: str) -> DataFrame:
    """(by, fastest, friendliest): keys of the routes of least time and most friendly share; ties to the least key."""
    return routes.groupBy(by).agg(F.min_by(key, F.struct(duration, key)).alias("fastest"), F.min_by(key, F.struct(-F.col(friendly), F.col(key))).alias("friendliest"))
