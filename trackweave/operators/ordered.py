"""Ordered operators whose groups may be larger than a task.

A group (route) is cut into buckets of its order. Windows run inside (group, bucket), so that a hot
group spreads over tasks; what a bucket needs from those before it (last row, sums) comes from one
small row a bucket. All steps share the partitioning by group and bucket: the rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Names = list[str]


def _keyed(df: DataFrame, group: Names, bucket: str) -> DataFrame:
    """df with __key, group and bucket as one value: never null itself, nulls inside compare equal.

    Windows, aggregates and joins on __key have one partitioning, so rows move once for all of them.
    """
    return df.withColumn("__key", F.struct(*group, bucket))


def _before(summary: DataFrame, group: Names, bucket: str, value: Column) -> DataFrame:
    """(__at, __before): value over the buckets of a group before each one."""
    w = Window.partitionBy(*(F.col(f"__key.{g}") for g in group)).orderBy(F.col(f"__key.{bucket}"))
    return summary.select(F.col("__key").alias("__at"), value.over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))


def _previous(rows: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str) -> DataFrame:
    boxed = F.struct(value.alias("value"))
    w = Window.partitionBy("__key").orderBy(*order)
    last = rows.groupBy("__key").agg(F.max_by(boxed, F.struct(*order)).alias("__last"))
    before = _before(last, group, bucket, F.last("__last"))
    out = rows.withColumn(name, F.lag(boxed).over(w)).join(before, F.col("__key") == F.col("__at"))
    # inside a bucket only its first row has nothing before it
    return out.withColumn(name, F.coalesce(F.col(name), F.col("__before"))).drop("__at", "__before")


def _running_sum(rows: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str) -> DataFrame:
    w = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = _before(rows.groupBy("__key").agg(F.sum(value).alias("__sum")), group, bucket, F.sum("__sum"))
    out = rows.withColumn(name, F.sum(value).over(w))
    kind = out.schema[name].dataType
    total = F.when(F.col("__before").isNull(), F.col(name)).otherwise(F.coalesce(F.col(name), F.lit(0)) + F.col("__before"))
    return out.join(before, F.col("__key") == F.col("__at")).withColumn(name, total.cast(kind)).drop("__at", "__before")


def with_previous(df: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """df with `name`: {value} of the row before in the group, null at its first row."""
    if bucket is None:
        return df.withColumn(name, F.lag(F.struct(value.alias("value"))).over(Window.partitionBy(*group).orderBy(*order)))
    return _previous(_keyed(df, group, bucket), group, order, value, name, bucket).drop("__key")


def with_running_sum(df: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """df with `name`: the sum of value up to and with each row of the group."""
    if bucket is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return _running_sum(_keyed(df, group, bucket), group, order, value, name, bucket).drop("__key")


def with_last(df: DataFrame, group: Names, order: Names, values: dict[str, Column], bucket: str | None = None) -> DataFrame:
    """df with each name of values: the last of its values up to and with each row of the group that isn't null."""
    latest = {n: F.last(v, ignorenulls=True) for n, v in values.items()}
    if bucket is None:
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *(v.over(w).alias(n) for n, v in latest.items()))
    rows = _keyed(df, group, bucket)
    w = Window.partitionBy("__key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.struct(*order)
    ends = rows.groupBy("__key").agg(*(F.max_by(v, F.when(v.isNotNull(), at)).alias(n) for n, v in values.items()))
    back = Window.partitionBy(*(F.col(f"__key.{g}") for g in group)).orderBy(F.col(f"__key.{bucket}")).rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("__key").alias("__at"), *(F.last(n, ignorenulls=True).over(back).alias(f"__before_{n}") for n in values))
    out = rows.select("*", *(v.over(w).alias(n) for n, v in latest.items())).join(before, F.col("__key") == F.col("__at"))
    return out.withColumns({n: F.coalesce(n, f"__before_{n}") for n in values}).drop("__key", "__at", *(f"__before_{n}" for n in values))


def keyed_islands(df: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str) -> DataFrame:
    """with_islands and the key of each bucket, __key: what is grouped by it, and more, moves no row again."""
    changed = F.when(F.col("__prev").isNotNull() & ~value.eqNullSafe(F.col("__prev.value")), 1).otherwise(0).cast("bigint")
    rows = _previous(_keyed(df, group, bucket), group, order, value, "__prev", bucket).withColumn("__changed", changed)
    return _running_sum(rows, group, order, F.col("__changed"), name, bucket).drop("__prev", "__changed")


def with_islands(df: DataFrame, group: Names, order: Names, value: Column, name: str, bucket: str | None = None) -> DataFrame:
    """df with `name`: the number, from 0, of the run of equal neighbouring values; nulls are equal."""
    if bucket is not None:
        return keyed_islands(df, group, order, value, name, bucket).drop("__key")
    changed = F.when(F.col("__prev").isNotNull() & ~value.eqNullSafe(F.col("__prev.value")), 1).otherwise(0).cast("bigint")
    rows = with_previous(df, group, order, value, "__prev").withColumn("__changed", changed)
    return with_running_sum(rows, group, order, F.col("__changed"), name).drop("__prev", "__changed")
