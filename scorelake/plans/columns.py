"""Queries of cell and text columns, bins and classes, signatures and aligned tables over the driver tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells, text
from ..operators import align, lineage, pressure, sessions, signature, strata, temporal
from .catalog import Tables, query


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _simple(name: str, sql: str, table: str, keys: Sequence[str], column: Callable[[], Column], out: str) -> None:
    """Register a query of one derived column."""

    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(*keys, column().alias(out))

    run.__name__ = name
    query(sql)(run)


# cells: numbers, blanks and text in one column

_CELL = "CASE event_id % 9 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN '  ' || CAST(value AS VARCHAR) || ' ' WHEN 2 THEN 'NaN' WHEN 3 THEN 'inf' WHEN 4 THEN '' WHEN 5 THEN event_type WHEN 7 THEN CAST(user_id AS VARCHAR) WHEN 8 THEN '0.' || CAST(event_id % 4 AS VARCHAR) || '0' END"
_CELLS = f"(SELECT event_id, value, {_CELL} AS cell FROM events)"
_NUMBER = "CASE WHEN isfinite(TRY_CAST(trim(cell) AS DOUBLE)) THEN TRY_CAST(trim(cell) AS DOUBLE) END"


def _cells(t: Tables) -> DataFrame:
    return t.events.select("event_id", "value", F.expr(_CELL.replace("VARCHAR", "STRING")).alias("cell"))


def _cell_query(name: str, sql: str, column: Callable[[], Column]) -> None:
    def run(t: Tables) -> DataFrame:
        return _cells(t).select("event_id", column().alias("x"))

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS x FROM (SELECT *, {_NUMBER} AS n FROM {_CELLS})")(run)


_cell_query("cell_to_float", "n", lambda: cells.to_float(F.col("cell")))
_cell_query("cell_rounded", "round(n, 1)", lambda: cells.rounded(cells.to_float(F.col("cell")), 1))
_cell_query("cell_blank_to_null", "nullif(trim(cell), '')", lambda: cells.blank_to_null(F.col("cell")))
_cell_query("cell_is_zeroish", "cell IS NULL OR coalesce(abs(n) <= 0.2, false)", lambda: cells.is_zeroish(F.col("cell")))
_cell_query(
    "cell_signature",
    "CASE WHEN abs(round(n, 2) - round_even(round(n, 2), 0)) < 0.01 THEN CAST(CAST(round_even(round(n, 2), 0) AS BIGINT) AS VARCHAR) WHEN n IS NOT NULL THEN CAST(round(n, 2) AS VARCHAR) ELSE trim(cell) END",
    lambda: cells.signature_cell(F.col("cell")),
)
_cell_query(
    "cell_plain_number",
    r"nullif(regexp_replace(regexp_replace(CAST(TRY_CAST(trim(cell) AS DECIMAL(38,12)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', ''), '-0')",
    lambda: cells.plain_number(F.trim("cell")),
)
_simple("cell_surname", "SELECT c_custkey, regexp_extract(lower(c_mktsegment || ' ' || c_name), '([a-z0-9]+)[^a-z0-9]*$', 1) AS x FROM customer", "customer", ["c_custkey"], lambda: cells.surname(F.concat_ws(" ", "c_mktsegment", "c_name")), "x")


# text of statements and prose

_STATEMENT = "'SELECT  a -- note ' || event_type || chr(10) || '/* x' || chr(10) || 'y */ FROM df WHERE k = ''' || event_type || ''' AND v > ' || CAST(value AS VARCHAR) || '  AND u = ' || CAST(user_id AS VARCHAR) || ' '"


def _statement() -> Column:
    return F.expr(_STATEMENT.replace("VARCHAR", "STRING"))


_SHAPE = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(s, '(?s)/\*.*?\*/', ' ', 'g'), '--[^\n]*', ' ', 'g')), '''[^'']*''', '<str>', 'g'), '\b\d+(\.\d+)?\b', '<num>', 'g'), '\s+', ' ', 'g'))"
_simple("statement_shape", f"SELECT event_id, {_SHAPE} AS x FROM (SELECT event_id, {_STATEMENT} AS s FROM events)", "events", ["event_id"], lambda: text.canonical_sql_shape(_statement()), "x")


@query(f"WITH s AS (SELECT event_id, sha256({_SHAPE}) AS fp FROM (SELECT event_id, {_STATEMENT} AS s FROM events)) SELECT fp, count(*) AS n, min(event_id) AS first FROM s GROUP BY fp")
def statement_fingerprints(t: Tables) -> DataFrame:
    """Statements by the fingerprint of their shape; all here have one."""
    return t.events.select("event_id", text.fingerprint(text.canonical_sql_shape(_statement())).alias("fp")).groupBy("fp").agg(_n(), F.min("event_id").alias("first"))


_simple(
    "description_fingerprint",
    r"SELECT doc_id, CASE WHEN c IS NULL OR c = '' THEN '' ELSE sha256(c) END AS fp FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '\d+(\.\d+)?', '<num>', 'g'), '\s+', ' ', 'g') AS c FROM documents)",
    "documents", ["doc_id"], lambda: text.fingerprint(text.canonical_description(F.col("text"))), "fp",
)
_simple(
    "tidy_lines",
    r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text || chr(13) || chr(10) || 'a ' || chr(9) || chr(13) || repeat(chr(10), 6) || 'b', '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{4,}', repeat(chr(10), 3), 'g')) AS x FROM documents",
    "documents", ["doc_id"], lambda: F.sha2(text.tidy_lines(F.concat("text", F.lit("\r\na \t\r" + "\n" * 6 + "b"))), 256), "x",
)
_simple(
    "unquote_placeholders",
    "SELECT event_id, 'a = {x} AND ''{table_name}'' AND b = {y_1} AND ''' || event_type || ' {z}''' AS x FROM events",
    "events", ["event_id"], lambda: text.unquote_placeholders(F.concat(F.lit("a = '{x}' AND '{table_name}' AND b = \"{y_1}\" AND '"), F.col("event_type"), F.lit(" {z}'"))), "x",
)
_simple("variable_names", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(trim(p_name || ', ' || p_type || '  ' || p_brand), '\\s*,\\s*|\\s+'), lambda x: x <> ''), '|') AS x FROM part", "part", ["p_partkey"], lambda: F.array_join(text.names_of(F.concat("p_name", F.lit(", "), "p_type", F.lit("  "), "p_brand")), "|"), "x")
_simple("strip_fences", "SELECT event_id, trim(event_type || CASE WHEN event_id % 2 = 0 THEN ' x' ELSE '' END) AS x FROM events", "events", ["event_id"], lambda: text.strip_fences(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so:\n```json\n"), "event_type", F.lit(" x\n```\nend"))).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))), "x")


def _mapped(df: DataFrame, function: Callable[..., object], columns: Sequence[str], key: str, schema: str) -> DataFrame:
    """``key`` and a string made by a plain function of the ``columns``, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [function(*row) for row in zip(*(batch.column(i + 1).to_pylist() for i in range(len(columns))), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "x"])

    return df.select(key, *columns).mapInArrow(run, schema)


@query("SELECT event_id, 'SELECT ''it''''s ' || event_type || ''' FROM df WHERE u = ' || CAST(user_id AS VARCHAR) || ' AND v > ' || CAST(value AS VARCHAR) || ' AND (overs < 3.1) AND w = {w} AND n IS NULL' AS x FROM events")
def instantiate_statements(t: Tables) -> DataFrame:
    template = "SELECT '{name}' FROM {table_name} WHERE u = {u} AND v > {v} AND {temporal_predicate} AND w = {w} AND n IS {n}"
    values = {"name": F.concat(F.lit("it's "), "event_type"), "table_name": F.lit("df"), "u": F.col("user_id"), "v": F.col("value"), "temporal_predicate": F.lit("(overs < 3.1)"), "n": F.lit(None).cast("string")}
    return t.events.select("event_id", text.instantiated(F.lit(template), values).alias("x"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN 'TRUE' ELSE '''' || event_type || '''''s''' END AS x FROM events")
def sql_literals(t: Tables) -> DataFrame:
    of_type = [F.lit(None).cast("double"), F.col("user_id"), F.lit(True), F.concat("event_type", F.lit("'s"))]
    return t.events.select("event_id", F.element_at(F.array(*map(text.literal, of_type)), (F.col("event_id") % 4 + 1).cast("int")).alias("x"))


@query("SELECT event_id, event_type || '/' || CAST(user_id AS VARCHAR) AS x FROM events")
def parameters_of_questions(t: Tables) -> DataFrame:
    """What turns a question template into the question asked, and back."""

    def both(kind: str, user: int) -> str:
        template = "How many {kind} events has user {user}, of {kind}?"
        found = text.parameters_of(template, text.fill(template, {"kind": kind, "user": user}))
        return f"{found['kind']}/{found['user']}"

    return _mapped(t.events, both, ["event_type", "user_id"], "event_id", "event_id bigint, x string")


@query("SELECT event_id, CAST(props->>'k' AS VARCHAR) AS x FROM events")
def first_json_objects(t: Tables) -> DataFrame:
    """The first JSON object in free text, trailing commas forgiven."""
    found = lambda props: str(text.first_json("so {x: } " + props.replace("}", ",}") + " and {more}")["k"])
    return _mapped(t.events, found, ["props"], "event_id", "event_id bigint, x string")


@query("SELECT event_id, trim(CAST(value AS VARCHAR), '') AS x FROM (SELECT event_id, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value FROM events)")
def canonical_cells(t: Tables) -> DataFrame:
    return t.events.select("event_id", cells.canonical(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit("00 "))).alias("x"))


# bins and classes


def _bins(x: str, bins: Sequence[tuple[float, str]], beyond: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'missing' " + " ".join(f"WHEN {x} <= {bound} THEN '{name}'" for bound, name in bins) + f" ELSE '{beyond}' END"


def _named(x: str, names: dict[str, object], otherwise: str) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in names.items()) + f" ELSE {otherwise} END"


_ROWS = _bins("event_id % 260", pressure.CONTRIBUTING_ROWS, "201+")
_COLUMNS = _bins("event_id % 9", pressure.SOURCE_COLUMNS, "7+")
_BAND = "CASE WHEN s IS NULL THEN 'missing_num_steps' WHEN s < 2 THEN 'expert' WHEN s <= 2 THEN 'easy' WHEN s <= 4 THEN 'medium' WHEN s <= 6 THEN 'hard' ELSE 'expert' END"
_STEPS = "(SELECT event_id, nullif(event_id % 11, 10) AS s FROM events)"
_simple("contributing_rows_bins", f"SELECT event_id, {_ROWS} AS bin FROM events", "events", ["event_id"], lambda: pressure.contributing_rows_bin(F.col("event_id") % 260), "bin")
_simple("source_columns_bins", f"SELECT event_id, {_COLUMNS} AS bin FROM events", "events", ["event_id"], lambda: pressure.source_columns_bin(F.col("event_id") % 9), "bin")
_steps = lambda: F.nullif(F.col("event_id") % 11, F.lit(10))
_simple("difficulty_bands", f"SELECT event_id, {_BAND} AS band FROM {_STEPS}", "events", ["event_id"], lambda: pressure.difficulty_band(_steps()), "band")
_COMPOSED = "CASE WHEN s IS NULL THEN 'missing_num_steps' WHEN s = 2 THEN '2-step composition' WHEN s IN (3, 4) THEN '3-4 step composition' WHEN s IN (5, 6) THEN '5-6 step composition' ELSE '7+ step composition' END"
_simple("composition_classes", f"SELECT event_id, {_COMPOSED} AS class FROM {_STEPS}", "events", ["event_id"], lambda: pressure.composition(_steps()), "class")

_VARIABLES = ("", "batsman", "batsman,bowler", "table_name", "bowler,table_name", "x1,x2")


def _variables() -> Column:
    return F.split(F.element_at(F.array(*map(F.lit, _VARIABLES)), (F.col("event_id") % len(_VARIABLES) + 1).cast("int")), ",")


_simple("grounding_classes", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'single-entity grounding' WHEN 2 THEN 'multi-entity grounding' WHEN 3 THEN 'schema-only grounding' WHEN 4 THEN 'single-entity grounding' ELSE 'no entity grounding' END AS class FROM events", "events", ["event_id"], lambda: pressure.grounding(_variables()), "class")
_simple("grounding_pressures", "SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' ELSE 'other' END AS level FROM events", "events", ["event_id"], lambda: pressure.grounding_pressure(pressure.grounding(_variables())), "level")
_SPANS = ("entire", "first_half", "second_half", "middle")
_span = lambda: F.try_element_at(F.array(*map(F.lit, _SPANS)), (F.col("event_id") % 5 + 1).cast("int"))
_simple("scoping_classes", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'full-span reasoning' WHEN 1 THEN 'partial-span reasoning' WHEN 2 THEN 'partial-span reasoning' WHEN 3 THEN 'other-span:middle' ELSE 'missing_span' END AS class FROM events", "events", ["event_id"], lambda: pressure.scoping(_span()), "class")
_RELATIONS = ("after", "Before", "between", "overlaps", "meets", "none")
_relation = lambda: F.try_element_at(F.array(*map(F.lit, _RELATIONS)), (F.col("event_id") % 7 + 1).cast("int"))
_simple("temporal_classes", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'non-temporal control' ELSE CASE event_id % 7 WHEN 0 THEN 'point-based temporal filtering' WHEN 1 THEN 'point-based temporal filtering' WHEN 2 THEN 'range-based temporal filtering' WHEN 3 THEN 'interval overlap reasoning' WHEN 4 THEN 'other-temporal:meets' ELSE 'non-temporal control' END END AS class FROM events", "events", ["event_id"], lambda: pressure.temporal_class(F.col("event_id") % 3 != 0, _relation()), "class")

_CLAUSES = ("where", "aggregate", "group_by", "having", "order_by", "limit", "case", "subquery", "distinct")
_SQL_CLAUSES = "(SELECT event_id, list_filter(['select', " + ", ".join(f"CASE WHEN (event_id >> {i}) % 2 = 1 THEN '{c}' END" for i, c in enumerate(_CLAUSES)) + "], lambda x: x IS NOT NULL) AS c FROM events)"


def _quoted(names: str) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names.split()) + "]"


_CLASS = "CASE WHEN len(c) = 2 AND list_contains(c, 'where') THEN 'simple retrieval' " + " ".join(f"WHEN list_has_all(c, {_quoted(has)})" + (f" AND NOT list_has_any(c, {_quoted(lacks)})" if lacks else "") + f" THEN '{name}'" for name, _, has, lacks in pressure.SQL_CLASSES) + " ELSE 'other retrieval' END"


def _clauses() -> Column:
    return F.array_compact(F.array(F.lit("select"), *(F.when(F.shiftright("event_id", i) % 2 == 1, F.lit(c)) for i, c in enumerate(_CLAUSES))))


_simple("sql_classes", f"SELECT event_id, {_CLASS} AS class FROM {_SQL_CLAUSES}", "events", ["event_id"], lambda: pressure.sql_class(_clauses()), "class")
_GROUP = "CASE WHEN NOT (list_contains(c, 'group_by') AND list_contains(c, 'having')) AND NOT list_contains(c, 'aggregate') THEN 'Simple retrieval' WHEN list_contains(c, 'group_by') AND list_contains(c, 'having') THEN 'Group comparison' WHEN list_contains(c, 'group_by') THEN 'Grouped aggregation' WHEN NOT list_contains(c, 'having') THEN 'Filtered aggregation' ELSE 'Simple retrieval' END"
_simple("sql_groups", f"SELECT event_id, {_GROUP} AS class FROM {_SQL_CLAUSES}", "events", ["event_id"], lambda: pressure.sql_group(pressure.sql_class(_clauses())), "class")
_POINTS = lambda x: f"CASE WHEN {x} <= 1 THEN 'low' WHEN {x} <= 3 THEN 'medium' ELSE 'high' END"
_EXECUTION = "(" + _named(_GROUP, pressure.SQL_POINTS, "1") + " + CASE WHEN s IS NULL THEN 1 WHEN s = 2 THEN 0 WHEN s IN (3, 4) THEN 1 WHEN s IN (5, 6) THEN 2 ELSE 3 END)"
_simple("execution_pressures", f"SELECT event_id, {_POINTS(_EXECUTION)} AS level FROM {_SQL_CLAUSES} JOIN {_STEPS} USING (event_id)", "events", ["event_id"], lambda: pressure.execution_pressure(pressure.sql_group(pressure.sql_class(_clauses())), pressure.composition(_steps())), "level")
_SHARE = "nullif(event_id % 50, 0) / 100.0"
_LOCAL = f"(CASE WHEN event_id % 3 <> 0 AND event_id % 7 <= 4 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 IN (1, 2) THEN 1 ELSE 0 END + CASE WHEN {_SHARE} IS NOT NULL THEN CASE WHEN {_SHARE} <= 0.10 THEN 2 WHEN {_SHARE} <= 0.25 THEN 1 ELSE 0 END WHEN event_id % 260 <= 10 THEN 2 WHEN event_id % 260 <= 50 THEN 1 ELSE 0 END)"
_share = lambda: F.nullif(F.col("event_id") % 50, F.lit(0)) / 100.0
_simple("localization_pressures", f"SELECT event_id, {_POINTS(_LOCAL)} AS level FROM events", "events", ["event_id"], lambda: pressure.localization_pressure(pressure.temporal_class(F.col("event_id") % 3 != 0, _relation()), _span(), _share(), pressure.contributing_rows_bin(F.col("event_id") % 260)), "level")


@query(
    f"SELECT event_id, 'G=' || CASE event_id % 6 WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' ELSE 'other' END || ' | L=' || {_POINTS(_LOCAL)} || ' | E=' || {_POINTS(_EXECUTION)} || ' | O=' || "
    + _POINTS("(CASE WHEN event_id % 9 IN (2, 3) THEN 1 WHEN event_id % 9 = 1 THEN 0 WHEN event_id % 9 IN (4, 5, 6) THEN 2 ELSE 3 END + CASE WHEN event_id % 30 <= 1 THEN 0 WHEN event_id % 30 <= 5 THEN 1 WHEN event_id % 30 <= 10 THEN 2 WHEN event_id % 30 <= 20 THEN 3 ELSE 4 END)")
    + f" AS pressure_profile FROM {_SQL_CLAUSES} JOIN {_STEPS} USING (event_id)"
)
def pressure_profiles(t: Tables) -> DataFrame:
    """The four pressures of each record as one text."""
    made = t.events.select("event_id", _steps().alias("steps"), _variables().alias("v"), _span().alias("span"), (F.col("event_id") % 3 != 0).alias("temporal"), _relation().alias("relation"), _clauses().alias("c"), _share().alias("share"), (F.col("event_id") % 260).alias("rows"), (F.col("event_id") % 9).alias("columns"), (F.col("event_id") % 30).alias("out"))
    return pressure.add_pressures(made, "steps", "v", "span", "temporal", "relation", "c", "share", "rows", "columns", "out").select("event_id", "pressure_profile")


# snapping, spans and transcripts


def _snap(low: int, high: int) -> str:
    tenths = "CAST(floor(value * 10 + 1e-9) AS BIGINT)"
    return f"CASE WHEN {tenths} % 10 > {high} THEN {tenths} // 10 + 1 + {low} / 10.0 ELSE {tenths} // 10 + greatest({tenths} % 10, {low}) / 10.0 END"


_simple("snap_balls_from_one", f"SELECT event_id, CAST(round({_snap(1, 6)}, 1) AS DOUBLE) AS x FROM events", "events", ["event_id"], lambda: F.round(temporal.snap_column(F.col("value")), 1), "x")
_simple("snap_balls_from_zero", f"SELECT event_id, CAST(round({_snap(0, 5)}, 1) AS DOUBLE) AS x FROM events", "events", ["event_id"], lambda: F.round(temporal.snap_column(F.col("value"), one_to_six=False), 1), "x")

_LOG = "CASE event_type WHEN 'purchase' THEN 'place_order' WHEN 'error' THEN 'return_item' WHEN 'click' THEN 'modify_item' WHEN 'view' THEN 'confirm_payment' ELSE 'inventory_adjustment' END"


def _log(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", F.expr(_LOG).alias("op"), F.col("user_id").alias("customer_id"), (F.col("event_id") % 20).alias("product_id"), F.lit(2.0).alias("qty"),
        F.lit(1.0).alias("old_qty"), F.lit(4.0).alias("new_qty"), F.col("value").alias("unit_price"), F.col("event_id").alias("order_id"),
    )


@query(
    f"SELECT event_id, CASE {_LOG} WHEN 'place_order' THEN u || ' takes 2.00 of ' || p WHEN 'return_item' THEN u || ' gives back 2.00 of ' || p WHEN 'modify_item' THEN u || ' changes ' || p || ' from 1.00 to 4.00' WHEN 'confirm_payment' THEN u || ' pays ' || printf('%.2f', value) ELSE 'stock of ' || p || ' is corrected' END AS line FROM (SELECT *, CAST(user_id AS VARCHAR) AS u, CAST(event_id % 20 AS VARCHAR) AS p FROM events)"
)
def transcript_lines(t: Tables) -> DataFrame:
    return _log(t).select("event_id", sessions.transcript_line().alias("line"))


_SIGNED = f"(SELECT CASE {_LOG} WHEN 'place_order' THEN 2 WHEN 'return_item' THEN -2 WHEN 'modify_item' THEN 3 ELSE 0 END AS q, CASE {_LOG} WHEN 'confirm_payment' THEN value WHEN 'place_order' THEN 2 * value WHEN 'return_item' THEN -2 * value WHEN 'modify_item' THEN 3 * value ELSE 0 END AS a FROM events)"


@query(f"SELECT round(sum(a), 2) AS total_revenue FROM {_SIGNED}")
def sessions_total_revenue(t: Tables) -> DataFrame:
    return sessions.overall(sessions.signed(_log(t))).select("total_revenue")


@query(f"SELECT CAST(round(sum(q), 2) AS DOUBLE) AS total_quantity FROM {_SIGNED}")
def sessions_total_quantity(t: Tables) -> DataFrame:
    return sessions.overall(sessions.signed(_log(t))).select("total_quantity")


# signatures, registries, row ids, aligned tables


@query("SELECT count(*) AS rows, 6 AS columns, true AS same, false AS changed FROM orders")
def frame_signatures(t: Tables) -> DataFrame:
    """A table's signature doesn't depend on its order, and on every cell."""
    other = t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.5).otherwise(F.col("o_totalprice")))
    frames = {"one": t.orders, "two": t.orders.repartition(7, "o_custkey"), "three": other}
    made = [signature.frame_signature(df).withColumn("frame", F.lit(name)) for name, df in frames.items()]
    of = lambda name: F.max(F.when(F.col("frame") == name, F.col("signature")))
    met = reduce(DataFrame.unionByName, made).agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"), of("one").alias("a"), of("two").alias("b"), of("three").alias("c"))
    return met.select("rows", "columns", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("changed"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1)")
def seen_before(t: Tables) -> DataFrame:
    return signature.seen_before(t.part, "p_name", t.part.filter("p_size = 1")).select("p_partkey", "p_name")


@query("SELECT p_name, max(p_partkey) AS last_key FROM part GROUP BY 1 ORDER BY last_key DESC LIMIT 12")
def latest_distinct(t: Tables) -> DataFrame:
    """The texts seen last, for a prompt that names what exists."""
    return signature.latest_distinct(t.part, "p_name", "p_partkey", 12).select("p_name", F.col("at").alias("last_key"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def global_row_ids(t: Tables) -> DataFrame:
    """Dense ids in a full order, without a window over all rows."""
    return lineage.with_row_ids(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT user_id, event_id AS row_id FROM events WHERE event_type = 'purchase' AND value > 50")
def lineage_long_form(t: Tables) -> DataFrame:
    """Lineage with one base row a row, and no id list of a group."""
    return lineage.long_group(t.events.filter("event_type = 'purchase' AND value > 50"), "event_id", ["user_id"])


def _answers(t: Tables) -> DataFrame:
    cell = lambda v: F.array(F.col("event_id").cast("double"), v)
    table = lambda rows: F.to_json(F.struct(F.array(F.lit("k"), F.lit("v")).alias("columns"), F.array_sort(F.array_compact(F.collect_list(rows))).alias("rows")))
    predicted = F.when(F.col("event_type") != "error", cell(F.col("value") + F.when(F.col("event_id") % 2 == 0, 0.125).otherwise(1.0)))
    grouped = t.events.groupBy(F.floor(F.col("event_id") / 8).alias("record_id")).agg(table(cell(F.col("value"))).alias("gold"), table(predicted).alias("pred"))
    return grouped.withColumn("primary_key", F.array(F.lit("k")))


@query(
    "WITH e AS (SELECT event_id // 8 AS record_id, event_type <> 'error' AS there, CASE WHEN event_id % 2 = 0 THEN 0.125 ELSE 1.0 END AS d FROM events) "
    "SELECT record_id, count(*) = count(*) FILTER (there) AS row_match, count(*) AS gold_rows, count(*) FILTER (there) AS pred_rows, count(*) FILTER (there) AS pairs, count(*) FILTER (there AND d < 0.2) AS correct_cells, "
    "round(count(*) FILTER (there) / count(*), 6) AS pk_recall, round(100.0 * count(*) FILTER (there AND d < 0.2) / nullif(count(*) FILTER (there), 0), 6) AS cell_acc, "
    "CAST(round(avg(d) FILTER (there), 6) AS DOUBLE) AS weighted_mae, round(sqrt(avg(d * d) FILTER (there)), 6) AS weighted_rmse FROM e GROUP BY record_id"
)
def aligned_table_scores(t: Tables) -> DataFrame:
    """Predicted against gold tables, rows aligned by key at least cost."""
    scored = align.score_tables(_answers(t))
    rounded = [F.round(c, 6).alias(c) for c in ("pk_recall", "cell_acc", "weighted_mae", "weighted_rmse")]
    return scored.select("record_id", "row_match", "gold_rows", "pred_rows", "pairs", "correct_cells", *rounded)


@query("WITH e AS (SELECT p.quality - g.quality AS q, p.toxic - g.toxic AS t FROM (SELECT doc_id, quality, toxic FROM labels) g JOIN (SELECT doc_id, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS toxic FROM documents) p USING (doc_id)) SELECT round((avg(abs(q)) + avg(abs(t))) / 2, 6) AS weighted_mae, 2 * count(*) AS pairs FROM e")
def macro_errors(t: Tables) -> DataFrame:
    from .evaluation import _pred

    metrics = strata.numeric_metrics(t.labels, _pred(t), ["doc_id"], ["quality", "toxic"])
    return strata.macro(metrics).select(F.round("weighted_mae", 6).alias("weighted_mae"), "pairs")


@query("SELECT round(sqrt(avg((l_extendedprice * l_discount - l_quantity) * (l_extendedprice * l_discount - l_quantity))), 4) AS rmse, round(avg(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' OR l_returnflag <> 'R' AND l_linestatus <> 'O' THEN 1 ELSE 0 END), 6) AS accuracy FROM lineitem")
def error_and_accuracy(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.round(strata.rmse(F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity")), 4).alias("rmse"), F.round(strata.accuracy(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"), 6).alias("accuracy"))


@query("WITH s AS (SELECT lang, source, avg(CASE WHEN toxic = 0 THEN quality END) AS a, avg(CASE WHEN toxic = 1 THEN quality END) AS b, least(count(*) FILTER (toxic = 0), count(*) FILTER (toxic = 1)) AS w FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1, 2) SELECT round(sum((b - a) * w) / sum(w), 6) AS weighted_delta, count(*) AS strata FROM s WHERE w > 0")
def weighted_strata_delta(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    deltas = strata.matched_deltas(joined, "toxic", 0, 1, ["lang", "source"], "quality")
    return strata.weighted_delta(deltas).select(F.round("weighted_delta", 6).alias("weighted_delta"), "strata")


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS attempts, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def usage_totals(t: Tables) -> DataFrame:
    """Counters by setting and over all."""
    sums = strata.totals(t.lineitem.select("l_returnflag", F.col("l_linenumber").alias("attempts"), F.col("l_quantity").alias("quantity")), "l_returnflag", ["attempts", "quantity"])
    return sums.select("l_returnflag", "attempts", F.round("quantity", 2).alias("quantity"))


@query("SELECT user_id, round(coalesce(sum(CASE WHEN event_type = 'click' THEN value END) / nullif(count(*) FILTER (event_type = 'click'), 0), 0), 6) AS mean FROM events GROUP BY user_id")
def usage_per_success(t: Tables) -> DataFrame:
    """Average over the successful samples alone; 0 without any."""
    by = t.events.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("used"), F.count_if(F.col("event_type") == "click").alias("good"))
    return by.select("user_id", F.round(strata.guarded_ratio("used", "good"), 6).alias("mean"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_entry(t: Tables) -> DataFrame:
    """Last entry of a key wins, as in a map of JSON lines."""
    return strata.latest(t.orders, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")
