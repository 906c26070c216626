"""The track list's order: eight keys, three states a column, ties by insertion."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.storage import written

COLUMNS = ("name", "pts", "date", "distance", "time", "elevation", "match", "saved")


class Sort(NamedTuple):
    column: str | None = "date"
    direction: str = "desc"


def clicked(sort: Sort, column: str) -> Sort:
    """A new column sorts up; a second click down, a third not at all, a fourth up again."""
    if sort.column != column:
        return Sort(column, "asc")
    return {"asc": Sort(column, "desc"), "desc": Sort(None, "none")}.get(sort.direction, Sort(column, "asc"))


def track_keys(tracks: DataFrame) -> dict[str, Column]:
    """Sort keys of tracks as documents; missing numbers sort as 0."""
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return {
        "name": F.lower("name"),
        "pts": F.coalesce(F.size("waypoints"), F.lit(0)),
        "date": F.unix_millis(F.to_timestamp("createdAt")),
        "distance": zero("route.stats.distanceMeters"),
        "time": zero("route.stats.durationSeconds"),
        "elevation": zero("route.stats.elevationGainMeters"),
        "match": zero("route.stats.userSettingsMatch"),
        "saved": F.when(F.col("isPermanent"), 1).otherwise(0),
    }


def ordering(keys: dict[str, Column], sort: Sort, ord: str = "ord") -> list[Column]:
    """Order expressions; ties keep insertion order in either direction, no column means newest first."""
    if sort.column is None or sort.direction == "none":
        return [keys["date"].desc(), F.col(ord).asc()]
    key = keys[sort.column]
    return [key.asc() if sort.direction == "asc" else key.desc(), F.col(ord).asc()]


def sorted_tracks(tracks: DataFrame, sort: Sort = Sort()) -> DataFrame:
    return tracks.orderBy(*ordering(track_keys(tracks), sort))


def positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with its place, from 1, in a global order: a range-partitioned sort, counts of its parts, and sums.

    No task sees more than its range. The sorted rows are written once, so that a second look at
    them, or a lost executor, finds the same parts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "positions")
    before, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy("__part").count().collect()):  # one row a partition
        before[part], total = total, total + n
    if not before:
        return placed.select(*df.columns, F.lit(0).cast("bigint").alias(name))
    offset = F.get(F.lit([before.get(i, 0) for i in range(max(before) + 1)]).cast("array<bigint>"), F.col("__part"))
    return placed.select(*df.columns, (offset + F.col("__at") + 1).alias(name))
