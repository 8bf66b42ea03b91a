"""Temporal relations between a field and two points: predicates and their wording."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = float | int | str | Column


def _c(p: Point) -> Column:
    return p if isinstance(p, Column) else F.lit(p)


#: relation -> (predicate over field, low point, high point; SQL text; wording).
RELATIONS: dict[str, tuple[Callable[[Column, Column, Column], Column], str, str]] = {
    "before": (lambda x, a, b: x < a, "({x} < {a})", "when over is before {a}"),
    "after": (lambda x, a, b: x > b, "({x} > {b})", "when over is after {b}"),
    "before_or_at": (lambda x, a, b: x <= a, "({x} <= {a})", "when over is at or before {a}"),
    "after_or_at": (lambda x, a, b: x >= b, "({x} >= {b})", "when over is at or after {b}"),
    "between": (lambda x, a, b: x.between(a, b), "({x} BETWEEN {a} AND {b})", "when over is between {a} and {b}"),
    "overlaps": (lambda x, a, b: (x <= b) & (a <= x), "({x} <= {b} AND {a} <= {x})", "when over falls between {a} and {b}"),
    "within": (lambda x, a, b: (x > a) & (x < b), "({x} > {a} AND {x} < {b})", "when over is strictly between {a} and {b}"),
    "starts": (lambda x, a, b: x == a, "({x} = {a})", "when over equals {a}"),
    "finishes": (lambda x, a, b: x == b, "({x} = {b})", "when over equals {b}"),
    "equals": (lambda x, a, b: x == a, "({x} = {a})", "when over equals {a}"),
    "meets": (lambda x, a, b: x == a, "({x} = {a})", "when over equals {a}"),
    "met-by": (lambda x, a, b: x == b, "({x} = {b})", "when over equals {b}"),
    "during": (lambda x, a, b: (a < x) & (x < b), "({a} < {x} AND {x} < {b})", "when over is between {a} and {b}"),
}


def predicate(relation: str | None, field: Column, low: Point, high: Point) -> Column:
    """Column predicate of ``relation``; no relation holds everywhere, an unknown one raises."""
    if not relation or relation.lower() == "none":
        return F.lit(True)
    if relation.lower() not in RELATIONS:
        raise ValueError(f"unknown temporal relation {relation!r}")
    return RELATIONS[relation.lower()][0](field, _c(low), _c(high))


def phrase(relation: str | None, low: float, high: float, field: str = "overs") -> tuple[str | None, str]:
    """(SQL text or None, wording) with the points in rising order."""
    if not relation or relation.lower() == "none":
        return None, "the entire match"
    if relation.lower() not in RELATIONS:
        raise ValueError(f"unknown temporal relation {relation!r}")
    low, high = min(low, high), max(low, high)
    _, sql, words = RELATIONS[relation.lower()]
    return sql.format(x=field, a=low, b=high), words.format(a=low, b=high)


def snap_over_ball(value: float, one_to_six: bool = True) -> float:
    """Legal ``over.ball`` at or after ``value``'s tenths: balls run 1 to 6 (or 0 to 5), beyond which
    the over is carried."""
    over, tenths = divmod(math.floor(value * 10 + 1e-9), 10)
    low, high = (1, 6) if one_to_six else (0, 5)
    if tenths > high:
        over, tenths = over + 1, low
    return round(over + max(tenths, low) / 10, 1)


def snap_column(value: Column, one_to_six: bool = True) -> Column:
    """``snap_over_ball`` as a column."""
    low, high = (1, 6) if one_to_six else (0, 5)
    tenths = F.floor(value * 10 + F.lit(1e-9))
    over, ball = F.floor(tenths / 10), F.pmod(tenths, F.lit(10))
    return F.when(ball > high, over + 1 + low / 10).otherwise(over + F.greatest(ball, F.lit(low)) / 10).cast("double")
