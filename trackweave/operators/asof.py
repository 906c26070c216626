"""Joins in order: the last row at or before a time, and the intervals around a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.operators.ordered import with_last


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, bucket: Callable[[Column], Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """left with the columns of right's last row of the same key at or before each row's time; null where there is none.

    Both have by and at; other names of right must be new. Of rows of right at one time the greatest by ties counts. bucket cuts
    time into pieces, as days: both tables meet inside (key, bucket), and only each bucket's last row goes on to those after it,
    so a key with a large share of the rows spreads. Null keys are a key like others.
    """
    mine, theirs = [c for c in left.columns if c not in (*by, at)], [c for c in right.columns if c not in (*by, at)]
    shared = [*by, at]
    kind = right.select(F.struct(*theirs)).schema[0].dataType
    asks = left.select(*shared, F.lit(1).alias("__side"), F.struct(*mine).alias("__left"), F.lit(None).cast(kind).alias("__right"))
    rows = asks.unionByName(right.select(*shared, F.lit(0).alias("__side"), F.lit(None).cast(asks.schema["__left"].dataType).alias("__left"), F.struct(*theirs).alias("__right")))
    order = [at, "__side", *(f"__tie{i}" for i in range(len(ties)))]
    rows = rows.withColumn("__part", bucket(F.col(at))).withColumns({f"__tie{i}": F.col(f"__right.{t}") for i, t in enumerate(ties)})
    out = with_last(rows, by, order, {"__found": F.col("__right")}, "__part").filter("__side = 1")
    return out.select(*shared, *(F.col(f"__left.{c}").alias(c) for c in mine), *(F.col(f"__found.{c}").alias(c) for c in theirs))


def in_force(left: DataFrame, right: DataFrame, by: list[str], at: str, until: str, bucket: Callable[[Column], Column], ties: tuple[str, ...] = ()) -> DataFrame:
    """As asof, for intervals of one key that don't overlap: right's columns are null from its `until` on (null: it never ends)."""
    out = asof(left, right, by, at, bucket, ties)
    over = F.col(at) >= F.col(until)
    theirs = [c for c in right.columns if c not in (*by, at)]
    return out.select(*(F.when(~F.coalesce(over, F.lit(False)), F.col(c)).alias(c) if c in theirs else F.col(c) for c in out.columns))


def within(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, end: str, bucket: Callable[[Column], Column]) -> DataFrame:
    """Inner join of points with all intervals of their key that hold them, start included, end not; intervals may overlap.

    bucket numbers pieces of time. Intervals are cut at the borders of pieces, so that points meet only those of their own piece: choose it
    about as long as an interval. Key and piece together deal out the rows. An interval that ends before it starts holds nothing.
    """
    first, last = bucket(F.col(start)).cast("bigint"), bucket(F.col(end)).cast("bigint")
    pieces = intervals.filter(F.col(end) > F.col(start)).withColumn("__piece", F.explode(F.sequence(first, last)))
    rows = points.withColumn("__piece", bucket(F.col(at)).cast("bigint"))
    return rows.join(pieces, [*by, "__piece"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__piece")
