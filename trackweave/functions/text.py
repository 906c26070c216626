"""Display text. Rounding is that of fixed-point printing: exact binary value, ties away from zero."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# The white space of names, which is that of Unicode with line ends and the byte order mark.
SPACE = r"\x{09}-\x{0D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def trimmed(text: Column) -> Column:
    """text without white space, of any kind, at its ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def fixed(value: Column, digits: int) -> Column:
    """The value with so many decimals, rounded by its exact binary value, halves away from zero.

    Doubles tell on which side of a half a value lies unless it is very near to one, as 1.45 (which is
    less) and 0.25 (which is one) are; those, and values too large to count on, go through an Arrow function.
    """
    value = value.cast("double")
    unit, whole = Decimal(1).scaleb(-digits), 10**digits
    scaled = F.abs(value) * whole
    near = (scaled >= 1e15) | F.isnan(value) | (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-9 * F.greatest(scaled, F.lit(1.0)))
    count = F.floor(F.when(~near, scaled) + 0.5).cast("bigint")
    body = count.cast("string")
    if digits:
        body = F.concat(((count - count % whole) / whole).cast("bigint").cast("string"), F.lit("."), F.lpad((count % whole).cast("string"), digits, "0"))
    plain = F.concat(F.when(value < 0, "-").otherwise(""), body)

    @F.pandas_udf("string")
    def show(v: pd.Series) -> pd.Series:
        return v.map(lambda x: format(Decimal(x).quantize(unit, ROUND_HALF_UP), "f") if pd.notna(x) else None)

    return F.coalesce(plain, show(F.when(near, value)))


def js_round(value: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(value + 0.5)


def shown(value: Column, text: Column, zero_is_missing: bool) -> Column:
    """text, or N/A where the value is missing; in the wide view 0 is missing too."""
    there = value.isNotNull() & ~F.isnan(value)
    if zero_is_missing:
        there = there & (value != 0)
    return F.when(there, text).otherwise(F.lit("N/A"))


def distance_text(meters: Column, zero_is_missing: bool = True) -> Column:
    return shown(meters, F.concat(fixed(meters / 1000, 1), F.lit("km")), zero_is_missing)


def duration_text(seconds: Column, zero_is_missing: bool = True) -> Column:
    return shown(seconds, F.concat(js_round(seconds / 60).cast("string"), F.lit("min")), zero_is_missing)


def gain_text(meters: Column, zero_is_missing: bool = True) -> Column:
    return shown(meters, F.concat(F.lit("↗"), fixed(meters, 0), F.lit("m")), zero_is_missing)


def number_text(value: Column) -> Column:
    """Whole numbers without decimals, others as they are."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def match_text(percent: Column) -> Column:
    """Zero is a value here in every view."""
    return F.when(percent.isNotNull(), F.concat(number_text(percent), F.lit("%"))).otherwise(F.lit("N/A"))


def date_text(time: Column) -> Column:
    return F.date_format(time, "MM/dd/yy")


def slug(name: Column) -> Column:
    """Runs of white space, of any kind, become a hyphen."""
    return F.regexp_replace(name, f"[{SPACE}]+", "-")


def escaped(text: Column) -> Column:
    """Text as XML content."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def plain_number(value: Column) -> Column:
    """A coordinate without exponent; doubles print exponents below 1e-3."""
    small = (F.abs(value) < 1e-3) & (value != 0)
    exact = F.regexp_replace(F.format_string("%.20f", value), "0+$", "")
    return F.when(small, exact).otherwise(number_text(value))


def display_name(labels: Column, index: Column, prefix: str = "Route") -> Column:
    """The labels, joined; or the prefix and the number of the route."""
    return F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) > 0, F.array_join(labels, ", ")).otherwise(F.concat(F.lit(f"{prefix} "), (index + 1).cast("bigint").cast("string")))
