"""Colours and ids derived from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The colour table that ids hash into, and the one that routes cycle through.
HASH_COLORS = ("#FF1493", "#FF4500", "#FFD700", "#ADFF2F", "#00FFFF", "#1E90FF", "#9932CC", "#FF00FF")
ROUTE_COLORS = ("#3B82F6", "#EF4444", "#10B981", "#F59E0B", "#8B5CF6", "#EC4899", "#14B8A6", "#F97316")


def _pick(table: tuple[str, ...], slot: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), slot.cast("int"))


def code_sum(text: Column) -> Column:
    """The sum of the characters' UTF-16 units; characters beyond the basic plane have two."""
    points = F.aggregate(F.split(text, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c == "", 0).otherwise(F.ascii(c)).cast("bigint"))
    coded = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(coded) - 3, F.lit(4)), lambda i: F.conv(F.substring(coded, i, F.lit(4)), 16, 10).cast("bigint"))
    return F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), F.aggregate(units, F.lit(0).cast("bigint"), lambda s, u: s + u)).otherwise(points)


def hash_slot(key: Column) -> Column:
    return F.pmod(code_sum(key), F.lit(len(HASH_COLORS)).cast("bigint"))


def hash_color(key: Column) -> Column:
    return _pick(HASH_COLORS, hash_slot(key))


def route_color(index: Column) -> Column:
    return _pick(ROUTE_COLORS, F.pmod(index, F.lit(len(ROUTE_COLORS))))


def color_or_hash(color: Column, key: Column) -> Column:
    """A missing or empty colour is replaced by the key's."""
    return F.coalesce(F.nullif(color, F.lit("")), hash_color(key))
