"""Queries of statement texts, of their lineage, and of shapes that templates seldom have."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import session
from ..operators import idioms as op
from ..sources import readers, writers
from . import difficulty, guard, trace, validate
from .catalog import Tables, query


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# projections, joins and groupings


@query("SELECT * FROM nation")
def select_star(t: Tables) -> DataFrame:
    return t.nation.select("*")


@query("SELECT n.*, r.r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def select_qualified_star(t: Tables) -> DataFrame:
    return t.nation.alias("n").join(t.region.alias("r"), F.col("n_regionkey") == F.col("r_regionkey")).select("n.*", "r.r_name")


@query("SELECT c_custkey, n_name FROM (SELECT * FROM nation WHERE n_regionkey < 2) n RIGHT JOIN customer ON n_nationkey = c_nationkey")
def join_right(t: Tables) -> DataFrame:
    return t.nation.filter("n_regionkey < 2").join(t.customer, F.col("n_nationkey") == F.col("c_nationkey"), "right").select("c_custkey", "n_name")


@query("SELECT o_orderkey, total FROM (SELECT o_orderkey, o_custkey FROM orders) NATURAL JOIN (SELECT l_orderkey AS o_orderkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY 1)")
def join_natural(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    left = t.orders.select("o_orderkey", "o_custkey")
    return left.join(sums, [c for c in left.columns if c in sums.columns]).select("o_orderkey", "total")


@query("SELECT p_partkey, word FROM part, LATERAL (SELECT unnest(string_split(p_name, ' ')) AS word)")
def join_lateral(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT p.event_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON p.user_id = c.user_id AND p.ts >= c.ts")
def join_asof(t: Tables) -> DataFrame:
    """Each purchase with the user's last click before it."""
    clicks = t.events.filter("event_type = 'click'").select("user_id", "ts", "value")
    return op.asof(t.events.filter("event_type = 'purchase'"), clicks, ["user_id"], "ts", "ts", {"value": "last_click"}).select("event_id", "last_click")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())")
def grouping_sets(t: Tables) -> DataFrame:
    sets = [[F.col("o_orderpriority")], [F.col("o_orderstatus")], []]
    return t.orders.groupingSets(sets, "o_orderpriority", "o_orderstatus").agg(_n()).select("o_orderpriority", "o_orderstatus", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_mean_of_five(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.round(op.moving(F.col("value"), ["user_id"], [F.col("event_id")], 5), 6).alias("mean"))


@query("SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) <= 2")
def qualify_top_two(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.desc("value"), "event_id"))
    return op.qualify(t.events, place, lambda q: q <= 2).select("event_id")


_SMOOTHED = "WITH RECURSIVE steps(nth, level) AS (SELECT nth, mean FROM years WHERE nth = 0 UNION ALL SELECT q.nth, s.level / 2 + q.mean / 2 FROM steps s JOIN years q ON q.nth = s.nth + 1) SELECT CAST(nth AS INT) AS nth, round(level, 4) AS level FROM steps"


@query(_SMOOTHED.replace("WITH RECURSIVE", "WITH RECURSIVE years AS (SELECT nth - min(nth) OVER () AS nth, mean FROM (SELECT year(o_orderdate) AS nth, avg(o_totalprice) AS mean FROM orders GROUP BY 1)),"))
def recursive_cte(t: Tables) -> DataFrame:
    """Smoothed means of years, each from the one before: a recursion as deep as the calendar."""
    years = t.orders.groupBy(F.year("o_orderdate").alias("nth")).agg(F.avg("o_totalprice").alias("mean"))
    uri = session.scratch_folder(t.spark, "years")  # read at every step
    years.withColumn("nth", F.col("nth") - F.min("nth").over(Window.partitionBy())).coalesce(1).write.parquet(uri)
    return t.spark.sql(_SMOOTHED.replace("years", "{years}"), years=t.spark.read.parquet(uri))


# dialect differences


@query("SELECT l_returnflag, round(CAST(CAST(count(*) AS FLOAT) / 7 AS DOUBLE), 3) AS share FROM lineitem GROUP BY l_returnflag")
def float_ratio(t: Tables) -> DataFrame:
    """A ratio of a 4-byte float stays one."""
    ratio = (F.count(F.lit(1)).cast("float") / 7).cast("float").cast("double")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(ratio, 3).alias("share"))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality DESC NULLS LAST, doc_id LIMIT 40")
def order_desc_nulls(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").orderBy(F.desc_nulls_last("quality"), "doc_id").limit(40)


@query("SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) > 90 AND CAST(user_id AS VARCHAR) <> '7'")
def string_number_compare(t: Tables) -> DataFrame:
    """Strings meet numbers by explicit casts."""
    return t.events.filter((F.get_json_object("props", "$.k").cast("bigint") > 90) & (F.col("user_id").cast("string") != "7")).select("event_id")


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS BIGINT) AS month, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders")
def date_functions(t: Tables) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return t.orders.select("o_orderkey", F.month("o_orderdate").cast("bigint").alias("month"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("first_day"), days.alias("days"))


# statement texts over a table


def _run(table: str, sql: str, oracle: str, name: str) -> None:
    def run(t: Tables) -> DataFrame:
        return validate.Source(getattr(t, table)).run(sql)

    run.__name__ = name
    run.__doc__ = "A guarded statement over one table as ``df``."
    query(oracle.replace("df", table) if oracle == sql else oracle)(run)


for _name, _table, _sql in (
    ("statement_with_comments", "lineitem", "-- totals\nSELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS total /* all */\nFROM df WHERE l_quantity > 10 GROUP BY l_returnflag"),
    ("statement_alias_shadowing", "lineitem", "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM df GROUP BY l_suppkey HAVING lines > 100"),
    ("statement_quoted_identifiers", "orders", "SELECT \"o_orderstatus\", count(*) AS n FROM df GROUP BY \"o_orderstatus\""),
    ("statement_cte_and_subquery", "orders", "WITH a AS (SELECT o_custkey, count(*) AS n FROM df GROUP BY o_custkey) SELECT o_custkey, n FROM a WHERE n = (SELECT max(n) FROM a)"),
):
    _run(_table, _sql + (";" if "comments" in _name else ""), _sql.replace(" df", f" {_table}"), _name)


@query("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM lineitem GROUP BY l_suppkey HAVING sum(l_linenumber) > 150")
def statement_alias_hides_column(t: Tables) -> DataFrame:
    return validate.Source(t.lineitem).run("SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS l_linenumber FROM df GROUP BY l_suppkey HAVING sum(l_linenumber) > 150")


_STATEMENTS = (
    ("SELECT a FROM df", "easy", 0, True),
    ("SELECT a, COUNT(*) FROM df WHERE b > 1 GROUP BY a", "medium", 4, True),
    ("SELECT a, SUM(b) AS s FROM df WHERE b > 1 GROUP BY a HAVING SUM(b) > 3 ORDER BY s LIMIT 5", "hard", 8, True),
    ("WITH x AS (SELECT a, SUM(b) AS s FROM df GROUP BY a) SELECT a, ROW_NUMBER() OVER (ORDER BY s) AS n FROM x ORDER BY n", "expert", 10, True),
    ("SELECT * FROM csv.`/tmp/x`", None, None, False),
    ("SELECT java_method('java.lang.System', 'exit', 1)", None, None, False),
    ("DROP TABLE df", None, None, False),
    ("SELECT 1; SELECT 2", None, None, False),
)


def _values(rows: Sequence[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


@query(_values([(i, label, score) for i, (_, label, score, ok) in enumerate(_STATEMENTS) if ok], "nth, label, score"))
def difficulty_labels(t: Tables) -> DataFrame:
    rows = [(i, a["label"], a["score"]) for i, (sql, _, _, ok) in enumerate(_STATEMENTS) if ok for a in [difficulty.analyse(t.spark, sql)]]
    return t.spark.createDataFrame(rows, "nth int, label string, score int")


@query(_values([(i, ok) for i, (_, _, _, ok) in enumerate(_STATEMENTS)], "nth, allowed"))
def guard_decisions(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(i, guard.is_read_only(t.spark, sql)) for i, (sql, *_) in enumerate(_STATEMENTS)], "nth int, allowed boolean")


@query(_values([(0, 1, 0, 1), (1, 1, 1, 2), (2, 2, 1, 2), (3, 3, 1, 2)], "nth, sources, derived, width"))
def projection_statistics(t: Tables) -> DataFrame:
    """Source columns named, most derived columns of a stage, and its widest output."""
    rows = []
    for i, (sql, _, _, ok) in enumerate(_STATEMENTS):
        if ok:
            p = trace.projection(t.spark, sql, ["a", "b"])
            rows.append((i, p["targeted_source_column_count"], p["max_derived_column_count"], p["max_stage_column_count"]))
    return t.spark.createDataFrame(rows, "nth int, sources int, derived int, width int")


@query("SELECT unnest(['zero', 'text', 'empty']) AS column_name")
def zero_columns(t: Tables) -> DataFrame:
    """Columns with nothing but zeros, nulls and text that is no number."""
    made = t.events.select("value", F.lit(0).alias("zero"), F.col("event_type").alias("text"), F.lit(None).cast("double").alias("empty"))
    return t.spark.createDataFrame([(c,) for c in validate.zero_columns(made)], "column_name string")


# lineage of statement texts: output rows and the base rows they came from


def _lineage(name: str, sql: str, columns: Sequence[str], oracle: str) -> None:
    def run(t: Tables) -> DataFrame:
        traced = trace.trace(t.events, "event_id", sql)
        return traced.result.select(trace.OUT, *columns).join(traced.lineage, trace.OUT).select(*columns, "row_id")

    run.__name__ = name
    run.__doc__ = f"Base rows of ``{sql}``."
    query(oracle)(run)


_lineage("lineage_sql_where", "SELECT user_id, value FROM df WHERE value > 90 AND event_type <> 'view' ORDER BY value DESC", ["user_id", "value"], "SELECT user_id, value, event_id AS row_id FROM events WHERE value > 90 AND event_type <> 'view'")
_lineage("lineage_sql_group", "SELECT user_id, count(*) AS n FROM df WHERE event_type = 'purchase' GROUP BY user_id HAVING count(*) > 2 ORDER BY n", ["user_id", "n"], "SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n, event_id AS row_id FROM events WHERE event_type = 'purchase' QUALIFY n > 2")
_lineage("lineage_sql_expression_group", "SELECT CEIL(value / 10) AS part, COUNT(*) AS n FROM df t GROUP BY part", ["n"], "SELECT count(*) OVER (PARTITION BY ceil(value / 10)) AS n, event_id AS row_id FROM events")
_lineage("lineage_sql_cte", "WITH a AS (SELECT user_id, event_type, count(*) AS k FROM df WHERE value > 95 GROUP BY user_id, event_type), b AS (SELECT user_id, max(k) AS top FROM a WHERE k >= 2 GROUP BY user_id) SELECT user_id, top FROM b", ["user_id", "top"], "WITH a AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS k FROM events WHERE value > 95) SELECT user_id, max(k) OVER (PARTITION BY user_id) AS top, event_id AS row_id FROM a WHERE k >= 2")
_lineage("lineage_sql_global", "SELECT count(*) AS n FROM df WHERE event_type = 'error'", ["n"], "SELECT count(*) OVER () AS n, event_id AS row_id FROM events WHERE event_type = 'error'")
_lineage("lineage_sql_derived", "SELECT kind, max(v) AS best FROM (SELECT event_type AS kind, value AS v FROM df WHERE user_id < 20) x GROUP BY kind", ["kind", "best"], "SELECT event_type AS kind, max(value) OVER (PARTITION BY event_type) AS best, event_id AS row_id FROM events WHERE user_id < 20")
_lineage("lineage_sql_distinct", "SELECT DISTINCT event_type, user_id FROM df WHERE value < 20", ["event_type", "user_id"], "SELECT event_type, user_id, event_id AS row_id FROM events WHERE value < 20")
_lineage("lineage_sql_top", "SELECT user_id, sum(CAST(value * 100 AS BIGINT)) AS total FROM df GROUP BY user_id ORDER BY total DESC, user_id LIMIT 3", ["user_id"], "WITH s AS (SELECT user_id, sum(CAST(trunc(value * 100) AS BIGINT)) AS total FROM events GROUP BY 1 ORDER BY total DESC, user_id LIMIT 3) SELECT user_id, event_id AS row_id FROM events JOIN s USING (user_id)")


# sinks and what reads them back


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def jsonl_round_trip(t: Tables) -> DataFrame:
    folder = session.scratch_folder(t.spark, "records") + ".jsonl"
    writers.write_jsonl(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), folder)
    return readers.read_records(t.spark, folder, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")


@query("SELECT n_nationkey, n_name FROM nation")
def envelope_round_trip(t: Tables) -> DataFrame:
    """Records inside one JSON object, as a file of a finished run has them."""
    path = session.scratch_folder(t.spark, "envelope") + ".json"
    writers.write_envelope(t.nation.select("n_nationkey", "n_name"), path, {"seed": 42})
    return readers.read_records(t.spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT CAST(CASE WHEN place < extra * (size + 1) THEN place // (size + 1) ELSE extra + (place - extra * (size + 1)) // size END AS INT) AS shard, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () // 7 AS size, count(*) OVER () % 7 AS extra FROM orders) GROUP BY 1")
def shards_round_trip(t: Tables) -> DataFrame:
    """Contiguous shards of at most one row's difference."""
    folder = session.scratch_folder(t.spark, "shards")
    writers.write_shards(t.orders.select("o_orderkey"), "o_orderkey", 7, folder)
    return t.spark.read.schema("o_orderkey bigint, shard int").json(folder).groupBy("shard").agg(_n(), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT CAST(count(DISTINCT s_nationkey) AS INT) AS files, 0 AS broken, 1 AS broken_after FROM supplier")
def release_audit(t: Tables) -> DataFrame:
    """Checksums of written files against their manifest, before and after one changes."""
    folder, listed = session.scratch_folder(t.spark, "release"), session.scratch_folder(t.spark, "manifest")
    t.supplier.repartition("s_nationkey").write.partitionBy("s_nationkey").json(folder)
    writers.checksums(t.spark, folder).write.parquet(listed)
    manifest = t.spark.read.parquet(listed)
    before = writers.audit(t.spark, folder, manifest).count()
    writers.replace_file(t.spark, f"{folder}/{manifest.agg(F.min('name')).first()[0]}", "{}")
    after = writers.audit(t.spark, folder, manifest)
    return manifest.agg(F.count(F.lit(1)).cast("int").alias("files")).select("files", F.lit(before).alias("broken"), F.lit(after.count()).alias("broken_after"))


@query("SELECT CAST(row_number() OVER (PARTITION BY s_suppkey // 50 ORDER BY s_suppkey) - 1 AS INT) AS nth, 'SELECT ' || s_suppkey || ' FROM df' AS sql FROM supplier")
def sql_files(t: Tables) -> DataFrame:
    """Statements of files that hold up to fifty each."""
    folder = session.scratch_folder(t.spark, "sql")
    statement = F.concat(F.lit("-- Query of "), "s_name", F.lit("\nSELECT "), "s_suppkey", F.lit(" FROM df\n"))
    listed = F.array_sort(F.collect_list(F.struct("s_suppkey", statement.alias("text"))))["text"]
    t.supplier.groupBy(F.floor(F.col("s_suppkey") / 50).alias("file")).agg(F.array_join(listed, "\n").alias("value")).write.partitionBy("file").text(folder)
    return readers.read_sql_file(t.spark, folder).select("nth", "sql")


@query("SELECT id, question, n_variables FROM (VALUES ('a', 'How many?', 2), ('1', 'Who?', 0)) AS v(id, question, n_variables)")
def template_files(t: Tables) -> DataFrame:
    path = session.scratch_folder(t.spark, "templates") + ".py"
    writers.replace_file(t.spark, path, "question_templates = [{'id': 'a', 'question': 'How many?', 'sql': 'SELECT 1', 'variables': 'x, y'}, {'question': 'Who?', 'query': 'SELECT 2'}]\n")
    return readers.read_templates(t.spark, [path]).select("id", "question", F.size("variables").alias("n_variables"))


@query("SELECT doc_id AS record_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no context' WHEN lang = 'de' THEN 'no question' WHEN quality IS NULL THEN 'no answer' END AS problem FROM documents LEFT JOIN labels USING (doc_id)")
def benchmark_problems(t: Tables) -> DataFrame:
    """What keeps a record out of a benchmark."""
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("record_id"), F.col("text").alias("context"), F.when(F.col("lang") == "de", " ").otherwise("?").alias("question"), F.col("quality").alias("answer"))
    return readers.check_benchmark(rows).select("record_id", "problem")


@query("SELECT event_id, coalesce(nullif(CAST(CASE WHEN event_id % 3 > 0 THEN event_id + 5 END AS VARCHAR), ''), 'r' || CAST(row_number() OVER (ORDER BY event_id) - 1 AS VARCHAR)) AS record_id FROM events")
def record_ids(t: Tables) -> DataFrame:
    """Ids that records have, else their place."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_id") + 5).alias("item_id"))
    return readers.with_record_ids(rows, order="event_id").select("event_id", "record_id")
