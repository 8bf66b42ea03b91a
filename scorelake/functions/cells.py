"""Cell columns: numbers in text, rounding regimes and zero tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """Double without NaN and infinities (null instead)."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def to_float(value: Column, compat: bool = False) -> Column:
    """Number in a string cell; null for blanks, text, NaN and infinities.  With ``compat`` true is 1 and false 0."""
    text = F.trim(value.cast("string"))
    number = finite(text.try_cast("double"))
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(number) if compat else number


def rounded(value: Column, digits: int) -> Column:
    return F.round(finite(value), digits)


def mean_above(value: Column, limit: str) -> Column:
    """Aggregate: whether a group's mean is above ``limit``, a number as text; null without values.

    A sum of doubles depends on the order of its rows, so a mean that equals the limit may come out above it.  Figures that
    18 decimals hold are summed exactly; a group with others (NaN, infinities, 1e19 and more) has its mean in doubles."""
    v, kind = value.cast("double"), "decimal(37,18)"
    figure = v.try_cast(kind)
    off = F.when(figure.cast("double") == v, figure - F.lit(limit).cast(kind))
    total = F.try_sum(off)
    return F.when((F.count(off) == F.count(v)) & total.isNotNull(), total > 0).otherwise(F.avg(v) > F.lit(limit).cast("double"))


def signature_cell(value: Column, digits: int = 2) -> Column:
    """Text of a cell for content comparison: trimmed, numbers rounded, whole numbers without a point."""
    number = F.round(to_float(F.trim(value.cast("string"))), digits)
    whole = F.abs(number - F.rint(number)) < F.lit(10.0**-digits)
    return F.when(number.isNotNull() & whole, F.rint(number).cast("bigint").cast("string")).when(number.isNotNull(), number.cast("string")).otherwise(F.trim(value.cast("string")))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def is_zeroish(value: Column, tolerance: float = 0.2) -> Column:
    """Null, or a number within ``tolerance`` of zero; other text isn't."""
    number = to_float(value.cast("string"))
    return value.isNull() | F.coalesce(F.abs(number) <= tolerance, F.lit(False))


def plain_number(value: Column) -> Column:
    """Plain decimal text without trailing zeros; ``-0`` is ``0``; null if it isn't a number."""
    number = value.cast("string").try_cast("decimal(38,12)").cast("string")
    cut = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(cut == "-0", "0").otherwise(cut)


def canonical(value: Column) -> Column:
    """Cell as votes compare it: numbers (to 26 digits before the point and 12 after it) in plain decimal text, NaN and
    infinities null, other text trimmed."""
    trimmed = F.trim(value.cast("string"))
    endless = F.lower(trimmed).rlike(r"^[+-]?(nan|inf|infinity)$")
    return F.when(~endless, F.coalesce(plain_number(trimmed), trimmed))


def surname(value: Column) -> Column:
    """Last word of a name, lower case, letters and digits only."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9 ]+", " "), r"\s+"), lambda x: x != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
