"""Checks of predicted answers to the ten session questions against the questions' schemas.

An answer is a JSON text, a list of objects.  It is parsed as a variant, so a cell keeps the type that it
was written with, and is checked where it stands: no answer is shuffled, and an answer's problems are an
array beside it or, exploded, a long table.

Defined cases: a null or malformed text, or JSON that isn't a list of objects, has the one problem
``unreadable``; an unknown question ``unknown question``; a cell that is JSON null has the wrong type; an
order is checked only among cells of one kind, as others have none.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Question:
    """Columns with their types; how many rows there are, if that is fixed; the column that orders them."""

    columns: Mapping[str, str]
    rows: int | None = None
    ordered_by: str | None = None
    ranked: bool = False


# The ten questions' columns, types and orders.
QUESTIONS = {
    "Q1": Question({"product_id": "string", "name": "string", "total_qty_sold": "number"}, ordered_by="product_id"),
    "Q2": Question({"product_id": "string", "name": "string", "total_revenue": "number"}, ordered_by="product_id"),
    "Q3": Question({"customer_id": "string", "total_qty": "number"}, ordered_by="customer_id"),
    "Q4": Question({"customer_id": "string", "total_spent": "number"}, ordered_by="customer_id"),
    "Q5": Question({"rank": "integer", "product_id": "string", "name": "string", "revenue": "number"}, 5, "rank", True),
    "Q6": Question({"rank": "integer", "product_id": "string", "name": "string", "qty_sold": "number"}, 5, "rank", True),
    "Q7": Question({"total_revenue": "number"}, 1),
    "Q8": Question({"total_qty_all": "number"}, 1),
    "Q9": Question({"category": "string", "revenue": "number"}, ordered_by="category"),
    "Q10": Question({"customer_id": "string", "average_order_value": "number"}, ordered_by="customer_id"),
}
#: Parts of the names of amounts, which have two decimals.
AMOUNTS = ("revenue", "spent", "average", "price")
_ROWS = "array<map<string, variant>>"
_PROBLEM = "array<struct<row: int, column: string, problem: string>>"


def _kind(cell: Column) -> Column:
    """``string``, ``integer``, ``number`` (with decimals) or another JSON type; null if there is no cell."""
    name = F.regexp_extract(F.schema_of_variant(cell), "^[A-Z]+", 0)
    return F.when(name == "BIGINT", "integer").when(name.isin("DECIMAL", "DOUBLE", "FLOAT"), "number").otherwise(F.lower(name))


def _number(cell: Column) -> Column:
    """A cell's value; null if it is a text or missing."""
    return F.when(_kind(cell) != "string", F.try_variant_get(cell, "$", "double"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(questions: Mapping[str, Question]) -> Column:
    """The schemas as a constant map, so that a plan doesn't grow with them."""
    columns = lambda q: F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(k == "number" and any(part in n for part in AMOUNTS)).alias("amount")) for n, k in q.columns.items()))
    schema = lambda q: F.struct(columns(q).alias("columns"), F.lit(q.rows).cast("int").alias("rows"), F.lit(q.ordered_by).cast("string").alias("ordered_by"), F.lit(q.ranked).alias("ranked"))
    return F.create_map(*(x for name, q in questions.items() for x in (F.lit(name), schema(q))))


def _problem(problem: Column | str, column: Column | str | None = None, row: Column | None = None) -> Column:
    at = F.lit(None) if row is None else row
    as_text = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(at.cast("int").alias("row"), as_text(column).alias("column"), as_text(problem).alias("problem"))


def _cell_problem(cell: Column, column: Column) -> Column:
    """What is wrong with a cell: null if nothing."""
    wanted, found = column["kind"], _kind(cell)
    right = F.when(wanted == "number", found.isin("integer", "number")).otherwise(found == wanted)
    exact = ~column["amount"] | (F.abs(F.round(_number(cell), 2) - _number(cell)) <= 1e-8)
    return F.when(cell.isNull(), "missing").when(~right, F.concat(F.lit("expected "), wanted, F.lit(", got "), found)).when(~exact, "more than two decimals")


def _cells(rows: Column, columns: Column) -> Column:
    of_row = lambda r, i: F.transform(columns, lambda c: _bound(F.try_element_at(r, c["name"]), lambda cell: _problem(_cell_problem(cell, c), c["name"], i)))
    return F.filter(F.flatten(F.transform(rows, of_row)), lambda p: p["problem"].isNotNull())


def _is_rising(cells: Column) -> Column:
    """Whether cells never fall; true if they aren't all numbers or all texts."""
    all_of = lambda *kinds: F.forall(cells, lambda c: F.coalesce(_kind(c).isin(*kinds), F.lit(False)))
    rises = lambda values: _bound(values, lambda v: v == F.array_sort(v))
    texts = F.transform(cells, lambda c: F.try_variant_get(c, "$", "string"))
    return F.when(all_of("integer", "number"), rises(F.transform(cells, _number))).when(all_of("string"), rises(texts)).otherwise(True)


def _of_rows(rows: Column, schema: Column, may_be_empty: bool) -> Column:
    when = lambda wrong, *problem: F.when(F.coalesce(wrong, F.lit(False)), F.array(_problem(*problem))).otherwise(F.array().cast(_PROBLEM))
    size, wanted = F.size(rows), schema["rows"]
    column = lambda name: F.transform(rows, lambda r: F.try_element_at(r, name))
    first_rank = F.try_element_at(F.filter(column(F.lit("rank")), lambda c: c.isNotNull()), F.lit(1))
    return F.concat(
        when(size != wanted, F.concat(F.lit("expected "), wanted.cast("string"), F.lit(" rows, got "), size.cast("string"))),
        when((size == 0) & F.lit(not may_be_empty), "no rows"),
        _cells(rows, schema["columns"]),
        when(schema["ranked"] & first_rank.isNotNull() & ~F.coalesce(_number(first_rank) == 1, F.lit(False)), "ranks don't start at 1", "rank"),
        when(schema["ordered_by"].isNotNull() & ~_bound(column(schema["ordered_by"]), _is_rising), "not in order", schema["ordered_by"]),
    )


def problems(question: Column, answer: Column, questions: Mapping[str, Question] = QUESTIONS, may_be_empty: bool = False) -> Column:
    """Array of an answer's problems (``row`` from 0, ``column``, ``problem``; nulls where none is meant), empty for a
    right one.  ``may_be_empty`` lets answers be without rows."""
    rows = F.try_variant_get(F.try_parse_json(answer), "$", _ROWS)
    both = F.struct(rows.alias("rows"), F.try_element_at(_table(questions), F.coalesce(question, F.lit(""))).alias("schema"))
    readable = lambda r: r.isNotNull() & F.forall(r, lambda x: x.isNotNull())
    judged = lambda b: F.when(b["schema"].isNull(), F.array(_problem("unknown question"))).when(~F.coalesce(readable(b["rows"]), F.lit(False)), F.array(_problem("unreadable"))).otherwise(_of_rows(b["rows"], b["schema"], may_be_empty))
    return _bound(both, judged)


def check(answers: DataFrame, question_col: str = "question", answer_col: str = "answer", may_be_empty: bool = False) -> DataFrame:
    """``answers`` with ``problems`` and ``ok``."""
    found = answers.withColumn("problems", problems(F.col(question_col), F.col(answer_col), may_be_empty=may_be_empty))
    return found.withColumn("ok", F.size("problems") == 0)


def long_form(checked: DataFrame, keys: list[str]) -> DataFrame:
    """One row a problem of ``check``'s result."""
    return checked.select(*keys, F.inline("problems"))
