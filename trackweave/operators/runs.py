"""Runs of neighbouring segments with one surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ordered import with_islands


def numbered(segments: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """segments(route_id, surface, ...) with run_id; neighbouring missing surfaces are one run."""
    return with_islands(segments, ["route_id"], order, F.col("surface"), "run_id", bucket)


def surface_runs(segments: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """(route_id, run_id, surface, distance, n_segments) of each run. Missing distances add nothing."""
    rows = numbered(segments, order, bucket)
    return rows.groupBy("route_id", "run_id").agg(F.first("surface").alias("surface"), F.sum("distance").alias("distance"), F.count("*").alias("n_segments"))


def run_counts(segments: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """(route_id, n_runs)."""
    return numbered(segments, order, bucket).groupBy("route_id").agg((F.max("run_id") + 1).alias("n_runs"))


def in_order(values: Column, order: list[str]) -> Column:
    """Aggregate: the group's values as an array in order (one run or route is one value)."""
    keyed = F.array_sort(F.collect_list(F.struct(*order, values.alias("__v"))))
    return F.transform(keyed, lambda x: x["__v"])


def run_coordinates(segments: DataFrame, order: list[str], bucket: str | None = None) -> DataFrame:
    """(route_id, run_id, coordinates): the segments' vertices one after the other.

    Shared end points stay twice; segments without coordinates add nothing.
    """
    rows = numbered(segments, order, bucket)
    empty = F.array().cast("array<array<double>>")
    return rows.groupBy("route_id", "run_id").agg(F.flatten(in_order(F.coalesce("coordinates", empty), order)).alias("coordinates"))
