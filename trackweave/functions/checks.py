"""Validation predicates; each is true, false or, where it says so, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.functions.geo import lines
from trackweave.functions.text import trimmed


def is_hex_color(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)^#[0-9A-F]{6}$"), F.lit(False))


def has_name(text: Column) -> Column:
    return F.coalesce(F.length(trimmed(text)) > 0, F.lit(False))


def is_search_term(text: Column, least: int = 3) -> Column:
    return F.coalesce(F.length(trimmed(text)) >= least, F.lit(False))


def can_route(waypoints: Column, circular: bool = False) -> Column:
    """Two waypoints make a route, one a circular one."""
    return F.coalesce(waypoints, F.lit(0)) >= (1 if circular else 2)


def circular_meters(kilometers: Column) -> Column:
    """Metres of a circular route of 10 to 200 whole kilometres, else null."""
    ok = kilometers.between(10, 200) & (kilometers == F.floor(kilometers))
    return F.when(ok, kilometers * 1000.0)


def has_routes(routes: Column) -> Column:
    return F.coalesce(F.size(routes) > 0, F.lit(False))


def is_visible(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def is_line(geometry: Column) -> Column:
    """A line or multi-line geometry (variant coordinates) with vertices."""
    return F.coalesce(F.size(lines(geometry["type"], geometry["coordinates"])) > 0, F.lit(False))
