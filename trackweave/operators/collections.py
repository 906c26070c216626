"""Keyed, ordered collections as DataFrames: every table has an id and its place `ord`.

Operations return a new table; nothing is changed in place. An existing key keeps its place when it
is written again, as in an insertion-ordered map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.text import trimmed
from trackweave.operators.ordered import with_running_sum


def latest(changes: DataFrame, key: str = "id", seq: str = "ord") -> DataFrame:
    """One row a key: that of the last change, at the place of the first one.

    Aggregated before the shuffle, so a key changed very often does not gather in one task.
    """
    rest = [c for c in changes.columns if c not in (key, seq)]
    picked = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__row"), F.min(seq).alias(seq))
    return picked.select(key, *(F.col(f"__row.{c}").alias(c) for c in rest), seq).select(*changes.columns)


def upsert(table: DataFrame, changes: DataFrame, key: str = "id", ord: str = "ord") -> DataFrame:
    """table with changes written over it, row by row; changes' ord says when, and counts from 0."""
    first = table.agg(F.coalesce(F.max(ord) + 1, F.lit(0).cast("bigint")).alias("__from"))
    later = changes.crossJoin(F.broadcast(first)).withColumn(ord, F.col(ord) + F.col("__from")).drop("__from")
    return latest(table.unionByName(later), key, ord)


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """table without the keys of ids; keys it doesn't have change nothing."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def only(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the wanted keys; unknown keys are skipped."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def update_if_present(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """table with the rows replaced whose key is in changes (one row a key); other changes are not kept."""
    rest = [c for c in changes.columns if c != key]
    marked = changes.select(key, F.struct(*rest).alias("__new"))
    out = table.join(marked, key, "left")
    return out.select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in rest else F.col(c) for c in table.columns))


def overlay(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Every field of right that isn't null over the same field of left, key by key."""
    shared = [c for c in right.columns if c != key]
    out = left.join(right.select(key, *(F.col(c).alias(f"__{c}") for c in shared)), key, "left")
    return out.select(key, *(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in left.columns if c != key))


def overlay_struct(left: Column, right: Column, fields: list[str]) -> Column:
    """The same on two structs of these fields."""
    return F.struct(*(F.coalesce(right[f], left[f]).alias(f) for f in fields))


def concatenated(*tables: DataFrame, ord: str = "ord") -> DataFrame:
    """All tables, one after the other in their orders; ids may repeat. ord orders, with gaps, in the result."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn(ord, F.struct(F.lit(i).alias("part"), F.col(ord).cast("bigint").alias("place")))
        out = t if out is None else out.unionByName(t)
    return out


def renumbered(table: DataFrame, by: list[str], order: list[str], name: str = "number", start: int = 1, bucket: str | None = None) -> DataFrame:
    """table with `name` counting from start in order within each group of `by`; a bucket spreads a hot group."""
    numbered = with_running_sum(table, by, order, F.lit(1).cast("bigint"), name, bucket)
    return numbered.withColumn(name, F.col(name) - 1 + start)


def next_number(table: DataFrame, by: list[str], name: str = "next") -> DataFrame:
    """(by, name): the number that a row added to each group gets."""
    return table.groupBy(*by).agg((F.count("*") + 1).alias(name))


def replaced(table: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """table with all rows of new's groups replaced by those of new; groups that new lacks stay."""
    return table.join(new.select(*by).distinct(), by, "left_anti").select(*table.columns).unionByName(new)


def set_field(table: DataFrame, where: Column, field: str, value: Column) -> DataFrame:
    return table.withColumn(field, F.when(where, value).otherwise(F.col(field)))


def promote_copy(table: DataFrame, id: str, new_id: str, name: str) -> DataFrame:
    """A track is copied to a permanent, visible one under a new id and name, at the end; the old row goes if it was temporary.

    An id that isn't there changes nothing.
    """
    last = table.agg(F.max("ord").alias("__last"))
    fresh = table.filter(F.col("id") == id).crossJoin(F.broadcast(last)).withColumn("ord", F.col("__last") + 1).drop("__last")
    fresh = fresh.withColumns({"id": F.lit(new_id), "name": F.lit(name), "isPermanent": F.lit(True), "isVisible": F.lit(True)}).select(*table.columns)
    return table.filter(~(F.col("id").eqNullSafe(id) & ~F.coalesce("isPermanent", F.lit(False)))).unionByName(fresh)


def promote_in_place(table: DataFrame, id: str, name: str) -> DataFrame:
    """A track is marked permanent under its old id, with the trimmed name."""
    here = F.col("id") == id
    return set_field(set_field(table, here, "isPermanent", F.lit(True)), here, "name", trimmed(F.lit(name)))


def clear_temporary(table: DataFrame) -> DataFrame:
    return table.filter("isPermanent")


def temporary(table: DataFrame) -> DataFrame:
    return table.filter("NOT isPermanent")


def others_visible(table: DataFrame, id: str) -> DataFrame:
    """Visible tracks but this one."""
    return table.filter((F.col("id") != id) & F.coalesce(F.col("isVisible"), F.lit(False)))


def add_routes(table: DataFrame, routes: DataFrame, replace: bool = False) -> DataFrame:
    """New temporary tracks beside, or instead of, the temporary ones there are."""
    return upsert(clear_temporary(table) if replace else table, routes)


def routes_after_edit(routes: DataFrame, waypoints: DataFrame) -> DataFrame:
    """The routes of sets of at least two waypoints; others are cleared. Both have set_id."""
    enough = waypoints.groupBy("set_id").count().filter("count >= 2")
    return routes.join(enough, "set_id", "left_semi")


def default_or_first(table: DataFrame, by: list[str], is_default: Column, order: list[str]) -> DataFrame:
    """One row of each group: a default one if there is any, else the first."""
    best = F.struct(F.when(is_default, 0).otherwise(1), *order)
    out = table.groupBy(*by).agg(F.min_by(F.struct(*(c for c in table.columns if c not in by)), best).alias("__row"))
    return out.select(*by, "__row.*")


def with_fresh_id(rows: DataFrame) -> DataFrame:
    """Custom profiles with new random ids."""
    return rows.withColumns({"id": F.uuid(), "isCustom": F.lit(True)})


def counts(tracks: DataFrame) -> DataFrame:
    """One row: tracks, permanent, temporary, visible, waypoints; null where the interface hides a zero."""
    hidden = lambda c: F.nullif(c, F.lit(0).cast("bigint"))
    return tracks.agg(
        hidden(F.count("*")).alias("routes"),
        hidden(F.count_if("isPermanent")).alias("saved"),
        hidden(F.count_if(~F.col("isPermanent"))).alias("temporary"),
        F.count_if(F.coalesce("isVisible", F.lit(False))).alias("visible"),
        F.coalesce(F.sum(F.size("waypoints")), F.lit(0)).cast("bigint").alias("waypoints"),
    )
