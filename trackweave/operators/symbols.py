"""First-match rules: segment symbols, surface colours and classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions.geo import mid_vertex

# Colours from mild to severe.
PALETTE = ("#e2d705", "#eab35a", "#ed8c82", "#ea5fa4", "#e205c4")
# The limits, colours and priorities of symbols.
#: (least stress, colour, priority), severe first; stress comes before slope.
STRESS_RULES = ((5, PALETTE[4], 0), (4, PALETTE[3], 0), (3, PALETTE[1], 10))
#: (slope steeper than, symbol, colour, priority), steep first, each way up and down.
SLOPE_RULES = ((20, "chevron_4", PALETTE[4], 20), (15, "chevron_3", PALETTE[3], 20), (10, "chevron_2", PALETTE[2], 30), (6, "chevron_1", PALETTE[1], 30), (4, "chevron_1", PALETTE[0], 30))

# Surfaces, their colours and labels.
SURFACES = (
    ("PAVED_EXCELLENT", "#1E40AF", "Paved - Excellent"),
    ("PAVED_GOOD", "#3B82F6", "Paved - Good"),
    ("PAVED_INTERMEDIATE", "#60A5FA", "Paved - Intermediate"),
    ("PAVED_BAD", "#93C5FD", "Paved - Bad"),
    ("UNPAVED_INTERMEDIATE", "#C084FC", "Unpaved - Intermediate"),
    ("UNPAVED_BAD", "#E879F9", "Unpaved - Bad"),
    ("UNPAVED_HORRIBLE", "#F472B6", "Unpaved - Horrible"),
    ("UNPAVED_IMPASSABLE", "#EC4899", "Unpaved - Impassable"),
    ("UNKNOWN", "#6B7280", "Unknown"),
)
DEFAULT_COLOR = "#6B7280"


def symbol(stress: Column, slope: Column) -> Column:
    """struct(symbol, color, priority, rotation) by the first rule that holds, else null."""
    row = lambda s, c, p, r: F.struct(F.lit(s).alias("symbol"), F.lit(c).alias("color"), F.lit(p).alias("priority"), F.lit(r).alias("rotation"))
    rules = [(stress >= least, row("car", color, priority, 0)) for least, color, priority in STRESS_RULES]
    for limit, name, color, priority in SLOPE_RULES:
        rules += [(slope > limit, row(name, color, priority, 0)), (slope < -limit, row(name, color, priority, 180))]
    out = F.when(*rules[0])
    for test, value in rules[1:]:
        out = out.when(test, value)
    return out


def route_symbols(features: DataFrame, *more: str) -> DataFrame:
    """(route_id, seg_idx, symbol, color, priority, rotation, coordinates, and columns named in more) at the middle vertex; segments without a symbol go."""
    rows = features.withColumn("__s", symbol(F.col("stress"), F.col("slope"))).filter("__s IS NOT NULL")
    return rows.select("route_id", "seg_idx", "__s.*", mid_vertex(F.col("coordinates")).alias("coordinates"), *more)


def surface_color(surface: Column) -> Column:
    out = F.when(surface == SURFACES[0][0], SURFACES[0][1])
    for value, color, _ in SURFACES[1:]:
        out = out.when(surface == value, color)
    return out.otherwise(DEFAULT_COLOR)


def is_smooth(surface: Column) -> Column:
    return F.coalesce(surface == "UNPAVED_INTERMEDIATE", F.lit(False))


def is_ok(surface: Column) -> Column:
    return F.coalesce(surface == "UNPAVED_BAD", F.lit(False))


def is_technical(surface: Column) -> Column:
    return F.coalesce(surface.isin("UNPAVED_HORRIBLE", "UNPAVED_IMPASSABLE"), F.lit(False))


def is_unpaved(surface: Column) -> Column:
    return is_smooth(surface) | is_ok(surface) | is_technical(surface)


def unpaved_class(surface: Column) -> Column:
    """smooth, ok or technical; null for what isn't unpaved."""
    return F.when(is_smooth(surface), "smooth").when(is_ok(surface), "ok").when(is_technical(surface), "technical")
