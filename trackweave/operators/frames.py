"""Frames over a distance, and quantiles that merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over_distance(rows: DataFrame, group: list[str], at: str, reach: int, values: dict[str, Column], width: int | None = None) -> DataFrame:
    """rows with each aggregate of values over the rows of the group from `reach` before a row's place to its place.

    at is the place along the group, a whole number (metres, or hundredths); rows at one place are in each other's frames. The group is cut into
    pieces of `width` (at least reach, eight times reach if not given); a piece has copies of what the one before has within reach, a share
    of reach / width of all rows, so that windows run inside pieces and a large group spreads.
    """
    width = 8 * reach if width is None else max(width, reach)
    first, last = F.floor(F.col(at) / width), F.floor((F.col(at) + reach) / width)
    copies = rows.withColumn("__own", first).withColumn("__piece", F.explode(F.sequence(first, last)))
    frame = Window.partitionBy(*group, "__piece").orderBy(at).rangeBetween(-reach, 0)
    return copies.withColumns({n: v.over(frame) for n, v in values.items()}).filter("__own = __piece").drop("__own", "__piece")


def quantile_sketches(rows: DataFrame, levels: list[str], value: Column, bucket: str, k: int = 200) -> DataFrame:
    """(levels, sketch): mergeable quantile sketches of value, rolled up: all levels, then without the last one, and so on to all rows.

    Null levels stand for "all"; levels themselves are never null. Sketches are made in (levels, bucket), where a large group is many small ones, and merged upwards.
    The rank of what quantile() gives is off by less than 2 in k with high probability.
    """
    parts = rows.groupBy(*levels, bucket).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("__sketch"))
    return parts.rollup(*levels).agg(F.kll_merge_agg_double("__sketch", F.lit(k)).alias("sketch"))


def quantile(sketch: Column | str, share: float) -> Column:
    """The value below which that share of a sketch's values lies."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))
