"""Predicted tables: their accepted shapes, validation, row keys and skeletons, as column expressions.

A table is ``struct<columns: array<string>, rows: array<array<string>>>``; cells are texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells

TABLE = "struct<columns: array<string>, rows: array<array<string>>>"
# What marks a header as a measure, inside it, at its ends, or as all of it.
METRIC_INSIDE = ("strike_rate", "economy", "percentage", "ratio", "avg_", "average", "frequency", "conversion", "cumulative", "longest", "shortest", "maximum", "minimum", "count")
METRIC_STARTS = ("total_", "max_", "min_", "num_", "count_")
METRIC_ENDS = ("_rate", "_percentage", "_ratio", "_count", "_frequency")
METRIC_NAMES = ("runs", "balls", "wickets", "dot_balls", "boundaries", "fours", "sixes")


def _of_objects(objects: Column, headers: Column) -> Column:
    return F.transform(objects, lambda o: F.transform(headers, lambda h: F.try_element_at(o, h)))


def from_text(text: Column, headers: Column | None = None) -> Column:
    """Table of a JSON text: ``{columns, rows}``, ``{table: [objects]}`` or a list of objects; null for other
    text.  Objects become rows in the order of ``headers`` (the first object's keys without them)."""
    plain = F.from_json(text, f"{TABLE[:-1]}, table: array<map<string, string>>>")
    listed = F.from_json(text, "array<map<string, string>>")
    objects = F.coalesce(plain["table"], F.when(F.ltrim(text).startswith("["), listed))
    names = headers if headers is not None else F.map_keys(F.try_element_at(objects, F.lit(1)))
    of_objects = F.struct(F.coalesce(names, F.array().cast("array<string>")).alias("columns"), _of_objects(objects, names).alias("rows"))
    empty = F.array().cast("array<array<string>>")
    whole = F.struct(F.coalesce(plain["columns"], F.array().cast("array<string>")).alias("columns"), F.coalesce(plain["rows"], empty).alias("rows"))
    keys = F.json_object_keys(F.when(F.ltrim(text).startswith("{"), text))
    is_table = F.array_contains(keys, "columns") & F.array_contains(keys, "rows")
    return F.when(is_table, whole).when(objects.isNotNull() & (F.size(objects) == 0), F.struct(F.array().cast("array<string>").alias("columns"), empty.alias("rows"))).when(objects.isNotNull(), of_objects)


def is_valid(table: Column, headers: Column, rows: Column | None = None) -> Column:
    """Whether a table has just these headers, rows as wide as they are, and (if given) so many rows."""
    wide = F.forall(table["rows"], lambda r: F.coalesce(F.size(r) == F.size(headers), F.lit(False)))
    right = (table["columns"] == headers) & wide
    if rows is not None:
        right = right & (rows.isNull() | (F.size(table["rows"]) == rows))
    return F.coalesce(right, F.lit(False))


def is_metric(header: Column) -> Column:
    """Whether a header names a measure, not a key."""
    h = F.lower(F.trim(F.coalesce(header, F.lit(""))))
    tests = [*(F.contains(h, F.lit(x)) for x in METRIC_INSIDE), *(F.startswith(h, F.lit(x)) for x in METRIC_STARTS), *(F.endswith(h, F.lit(x)) for x in METRIC_ENDS), h.isin(*METRIC_NAMES)]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def row_keys(primary_key: Column, headers: Column, rows: Column) -> Column:
    """Key columns of a table: the headers before the first measure, those of the primary key among them
    if there are any; else the primary key; else, unless the table has one row, the first header."""
    none = F.array().cast("array<string>")
    before = F.aggregate(
        headers, F.struct(none.alias("kept"), F.lit(False).alias("ended")),
        lambda a, h: F.struct(F.when(a["ended"] | is_metric(h), a["kept"]).otherwise(F.concat(a["kept"], F.array(h))).alias("kept"), (a["ended"] | is_metric(h)).alias("ended")),
        lambda a: a["kept"],
    )
    stated = F.filter(F.coalesce(primary_key, none), lambda c: F.array_contains(headers, c) & ~is_metric(c))
    refined = F.filter(before, lambda c: F.array_contains(stated, c))
    return (
        F.when(F.size(refined) > 0, refined).when((F.size(before) > 0) & (rows == 1) & (F.size(before) == F.size(headers)), none)
        .when(F.size(before) > 0, before).when(F.size(stated) > 0, stated).when(rows == 1, none).otherwise(F.slice(headers, 1, 1))
    )


def distinct_headers(row_headers: Column, keys: Column) -> Column:
    """Key values of each row header (a map), the first of equal ones."""
    return F.array_distinct(F.transform(row_headers, lambda r: F.transform(keys, lambda k: F.try_element_at(r, k))))


def skeleton(headers: Column, keys: Column, values: Column) -> Column:
    """Table with a row for each list of key values; every other cell is null."""
    cell = lambda row, h: F.when(F.array_contains(keys, h), F.try_element_at(row, F.array_position(keys, h).cast("int")))
    return F.struct(headers.alias("columns"), F.transform(values, lambda row: F.transform(headers, lambda h: cell(row, h))).alias("rows"))


def as_text(table: Column) -> Column:
    """Rows as lines of cells with bars, nulls as a dash."""
    return F.array_join(F.transform(table["rows"], lambda r: F.array_join(r, "|", "-")), "\n")


def mismatches(records: DataFrame, match: str = "content_match") -> DataFrame:
    """Records that aren't known to match."""
    return records.filter(~F.coalesce(F.col(match), F.lit(False)))


def joined_results(skills: DataFrame, results: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Results of all models beside their records' skills; a record with two rows of skills raises at run time."""
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    single = skills.groupBy(*on).agg(F.count(F.lit(1)).alias("__k"), *(F.first(c).alias(c) for c in skills.columns if c not in on))
    checked = single.withColumn("__ok", F.assert_true(F.col("__k") == 1, F.lit("a record has more than one row of skills")))
    return every.join(checked, list(on)).filter("__ok IS NULL").drop("__k", "__ok")


def numeric_columns(table: Column, rows: int = 50) -> Column:
    """Names of a table's columns with a number in one of its first ``rows`` rows (short rows lack cells); of a
    repeated name the last column counts."""
    first = F.slice(table["rows"], 1, rows)
    last = lambda i: ~F.array_contains(F.slice(table["columns"], i + 2, F.size(table["columns"])), F.element_at(table["columns"], i + 1))
    has = lambda i: F.exists(first, lambda r: F.coalesce(cells.to_float(F.try_element_at(r, i + 1)).isNotNull(), F.lit(False)))
    return F.filter(table["columns"], lambda c, i: last(i) & has(i))
