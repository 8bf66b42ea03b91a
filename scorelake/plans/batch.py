"""Execution of many statements over one source in few jobs.

Statements are analysed one by one, which starts no job: those that the guard refuses or that don't resolve
fail alone.  The others become one tagged union for each ``PLAN_SIZE`` distinct statements, whose equal
exchanges Spark runs once, over a source that is cached while they run.  A union that fails while it runs is
halved until the failing statement is alone.  Results are written to the scratch folder and come back to the
driver a partition at a time, each up to a stated number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.signature import json_value
from ..session import scratch_folder

#: Statements of one union.
PLAN_SIZE = 64


class Source(Protocol):
    session: SparkSession
    relation: str

    def run(self, sql: str) -> DataFrame: ...


def _cell(column: Column, kind: T.DataType) -> Column | None:
    """A cell as JSON holds it: whole numbers, booleans and text as they are, doubles if finite, decimals and times
    as text; None for other types."""
    if isinstance(kind, T.IntegralType | T.BooleanType | T.StringType):
        return column
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        x = column.cast("double")
        return F.when(F.abs(x) < float("inf"), x)
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(column, "SSSSSS") == "000000", whole).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    if isinstance(kind, T.DateType | T.NullType):
        return column.cast("string")
    return column.cast("string") if isinstance(kind, T.DecimalType) and kind.scale <= 6 else None


def _tagged(df: DataFrame, number: int, most_rows: int) -> DataFrame | None:
    """``statement``, ``nth`` (rising in the result's order) and ``row`` (JSON array); None if a column has a type that
    rows can't hold."""
    kinds = [f.dataType for f in df.schema]
    plain = df.toDF(*(f"c{i}" for i in range(len(kinds))))
    cells = [_cell(F.col(f"c{i}"), k) for i, k in enumerate(kinds)]
    if any(c is None for c in cells):
        return None
    row = F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(cells))), {"ignoreNullFields": "false"})
    return plain.limit(most_rows + 1).select(F.lit(number).alias("statement"), F.monotonically_increasing_id().alias("nth"), row.alias("row"))


def answers(source: Source, statements: Iterable[str], most_rows: int, plan_size: int = PLAN_SIZE, jobs: list[int] | None = None) -> Mapping[str, dict | Exception]:
    """``{columns, rows}`` of each distinct statement, or what made it fail; more than ``most_rows`` rows fail.

    ``jobs`` gets the number of statements of each union that ran."""
    spark = source.session
    texts = list(dict.fromkeys(statements))
    found: dict[str, dict | Exception] = {}
    ready: list[tuple[int, list[str], DataFrame]] = []
    for number, sql in enumerate(texts):
        try:
            df = source.run(sql)
            tagged = _tagged(df, number, most_rows)
            if tagged is None:
                rows = df.limit(most_rows + 1).collect()
                found[sql] = _answer(df.columns, [list(r) for r in rows], most_rows)
            else:
                ready.append((number, df.columns, tagged))
        except Exception as e:  # noqa: BLE001  any failure of a statement is its result
            found[sql] = e

    def run(some: list[tuple[int, list[str], DataFrame]]) -> None:
        uri = scratch_folder(spark, "answers")
        if jobs is not None:
            jobs.append(len(some))
        try:
            reduce(DataFrame.unionAll, (t for _, _, t in some)).write.parquet(uri)
        except Exception as e:  # noqa: BLE001  halves tell which statement it was
            if len(some) == 1:
                found[texts[some[0][0]]] = e
                return
            run(some[: len(some) // 2])
            run(some[len(some) // 2 :])
            return
        rows: dict[int, list[list]] = {number: [] for number, _, _ in some}
        for r in spark.read.schema("statement int, nth bigint, row string").parquet(uri).orderBy("statement", "nth").toLocalIterator():
            rows[r["statement"]].append(list(json.loads(r["row"]).values()))
        for number, columns, _ in some:
            found[texts[number]] = _answer(columns, rows[number], most_rows)

    view = spark.table(source.relation)
    shared = len(ready) > 1 and not view.is_cached
    if shared:
        view.persist()
    try:
        for at in range(0, len(ready), plan_size):
            run(ready[at : at + plan_size])
    finally:
        if shared:
            view.unpersist()
    return found


def _answer(columns: list[str], rows: list[list], most_rows: int) -> dict | Exception:
    if len(rows) > most_rows:
        return ValueError(f"the answer has more than {most_rows} rows")
    return {"columns": list(columns), "rows": [[json_value(v) for v in r] for r in rows]}
