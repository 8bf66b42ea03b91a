"""Queries of answer checks, coverage of models and schedules of templates and sources over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answer_checks, schedule, strata, tables
from .catalog import Tables, query

# answers as a careless model gives them: a user's session has products by number, the best five with numeric ids,
# an unrounded mean as total, and categories by first appearance


def _answers(t: Tables) -> DataFrame:
    e = t.events.withColumn("product", F.col("event_id") % 20)
    as_rows = lambda *cells: F.array_sort(F.collect_list(F.struct("at", F.struct(*cells).alias("cells"))))["cells"]
    products = e.groupBy("user_id", "product").agg(F.round(F.sum("value"), 2).alias("sum"))
    kinds = e.groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("revenue"), F.min("event_id").alias("at"))
    named = products.withColumn("at", F.struct((-F.col("sum")).alias("least"), "product"))
    best = named.groupBy("user_id").agg(F.slice(as_rows(F.col("product").alias("product_id"), F.lit("part").alias("name"), F.col("sum").alias("revenue")), 1, 5).alias("rows"))
    ranked = F.transform("rows", lambda r, i: F.struct((i + 1).alias("rank"), r["product_id"].alias("product_id"), r["name"].alias("name"), r["revenue"].alias("revenue")))
    by_number = products.withColumn("at", F.col("product")).groupBy("user_id").agg(as_rows(F.concat(F.lit("P"), F.col("product").cast("string")).alias("product_id"), F.lit("part").alias("name"), F.col("sum").alias("total_revenue")).alias("rows"))
    by_kind = kinds.groupBy("user_id").agg(as_rows(F.col("event_type").alias("category"), "revenue").alias("rows"))
    total = e.groupBy("user_id").agg(F.array(F.struct(F.avg("value").alias("total_revenue"))).alias("rows"))
    made = [("Q2", by_number, F.col("rows")), ("Q5", best, ranked), ("Q7", total, F.col("rows")), ("Q9", by_kind, F.col("rows"))]
    answers = [df.select("user_id", F.lit(q).alias("question"), F.to_json(rows).alias("answer")) for q, df, rows in made]
    return answers[0].unionByName(answers[1]).unionByName(answers[2]).unionByName(answers[3])


_SQL_PROBLEMS = """
WITH p AS (SELECT user_id, event_id % 20 AS product, 'P' || (event_id % 20) AS id FROM events GROUP BY ALL),
k AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL),
r AS (SELECT user_id, least(count(*), 5) AS n FROM p GROUP BY 1),
p2 AS (SELECT *, lag(id) OVER (PARTITION BY user_id ORDER BY product) AS before FROM p),
k2 AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY first_id) AS before FROM k)
SELECT DISTINCT user_id, 'Q2' AS question, -1 AS row, 'product_id' AS "column", 'not in order' AS problem FROM p2 WHERE before > id
UNION ALL SELECT user_id, 'Q5', -1, '', 'expected 5 rows, got ' || n FROM r WHERE n < 5
UNION ALL SELECT user_id, 'Q5', i, 'product_id', 'expected string, got integer' FROM r, (SELECT unnest(range(5)) AS i) WHERE i < n
UNION ALL SELECT user_id, 'Q7', 0, 'total_revenue', 'more than two decimals' FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) WHERE abs(round(v, 2) - v) > 1e-8
UNION ALL SELECT DISTINCT user_id, 'Q9', -1, 'category', 'not in order' FROM k2 WHERE before > event_type
"""


@query(_SQL_PROBLEMS)
def session_answer_problems(t: Tables) -> DataFrame:
    """Everything that is wrong with the answers, one row a problem."""
    found = answer_checks.long_form(answer_checks.check(_answers(t)), ["user_id", "question"])
    return found.select("user_id", "question", F.coalesce("row", F.lit(-1)).cast("bigint").alias("row"), F.coalesce("column", F.lit("")).alias("column"), "problem")


# two models' results: labels and pages of documents, where there are any

_SQL_MODELS = "(SELECT 'a' AS model, d.doc_id, l.quality IS NOT NULL AS answered, l.quality = 1 AS keyed, l.toxic = 0 AS numeric FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT 'b', d.doc_id, p.html IS NOT NULL, p.url LIKE 'https:%', length(p.html) > 2000 FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"
_HAS = {"answered": "answered", "keyed": "keyed", "numeric": "numeric"}


def _models(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    a = docs.join(t.labels, "doc_id", "left").selectExpr("'a' AS model", "doc_id", "quality IS NOT NULL AS answered", "quality = 1 AS keyed", "toxic = 0 AS numeric")
    b = docs.join(t.pages.withColumnRenamed("page_id", "doc_id"), "doc_id", "left").selectExpr("'b' AS model", "doc_id", "html IS NOT NULL AS answered", "url LIKE 'https:%' AS keyed", "length(html) > 2000 AS numeric")
    return a.unionByName(b)


@query(f"SELECT model, count(*) AS samples, {', '.join(f'count(*) FILTER ({c}) AS {c}, count(*) FILTER (NOT coalesce({c}, false)) AS no_{c}' for c in _HAS)} FROM {_SQL_MODELS} GROUP BY model")
def coverage_by_model(t: Tables) -> DataFrame:
    """How many samples each model answers, and how many of them can be scored."""
    return strata.coverage(_models(t), "model", _HAS)


@query(f"WITH s AS (SELECT doc_id, {', '.join(f'count(DISTINCT model) FILTER ({c}) = 2 AS {c}' for c in _HAS)} FROM {_SQL_MODELS} GROUP BY doc_id) SELECT 'samples' AS subset, count(*) AS n FROM s " + " ".join(f"UNION ALL SELECT '{c}', count(*) FILTER ({c}) FROM s" for c in _HAS))
def coverage_of_pairs(t: Tables) -> DataFrame:
    """Samples that both models answer, and that can be scored for both."""
    return strata.paired_coverage(_models(t), "doc_id", "model", ["a", "b"], _HAS)


@query("SELECT o_custkey, coalesce(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus), '') AS columns FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders) WHERE nth <= 3 GROUP BY 1")
def numeric_table_columns(t: Tables) -> DataFrame:
    """Columns that the first rows of a table show as numeric: a customer's prices, a column a status."""
    statuses = ("F", "O", "P")
    row = F.array(F.col("o_orderpriority"), *(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice").cast("string")).otherwise(" ") for s in statuses))
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row"))))["row"].alias("rows"))
    table = F.struct(F.array(F.lit("priority"), *map(F.lit, statuses)).alias("columns"), F.col("rows").alias("rows"))
    return rows.select("o_custkey", F.array_join(tables.numeric_columns(table, 3), ",").alias("columns"))


# a supplier is a template, a customer a source, an order's priority an entity of its customer

_SQL_SCHEDULE = """
t AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS t FROM supplier), s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS s FROM customer),
n AS (SELECT (SELECT count(*) FROM t) AS n, (SELECT count(*) FROM s) AS m),
f AS (SELECT t, (t + u) % m AS s, t // m * 2 + u AS slot, true AS forced FROM t, n, (VALUES (0), (1)) AS x(u)),
c AS (SELECT s.s, unnest(range(1, 3 - count(f.t))) AS nth FROM s LEFT JOIN f ON f.s = s.s GROUP BY 1),
a AS (SELECT * FROM f UNION ALL SELECT ('0x' || substr(md5('7|' || s || '|' || nth), 1, 15))::BIGINT % n, s, 2 * (n // m + 1) + nth, false FROM c, n),
schedule AS (SELECT row_number() OVER (ORDER BY md5('7|' || t || '|' || s || '|' || slot)) - 1 AS turn, s_suppkey, c_custkey, slot, forced FROM a JOIN t USING (t) JOIN s USING (s))
"""


def _schedule(t: Tables) -> DataFrame:
    return schedule.coverage(t.supplier, t.customer, "s_suppkey", "c_custkey", uses=2, source_uses=2, seed=7)


@query(f"WITH {_SQL_SCHEDULE} SELECT turn, s_suppkey, c_custkey, slot, forced FROM schedule")
def coverage_schedule(t: Tables) -> DataFrame:
    """Turns in which every template and every source is used twice or more."""
    return _schedule(t)


@query(f"""WITH {_SQL_SCHEDULE}, e AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) - 1 AS place, count(*) OVER (PARTITION BY o_custkey) AS size FROM orders GROUP BY 1, 2),
z AS (SELECT DISTINCT o_custkey, size, greatest(size // 2, 1) AS half FROM e),
w AS (SELECT turn, s_suppkey, c_custkey, CASE WHEN (slot + 1) * 60 // 100 > slot * 60 // 100 THEN (slot * 60 // 100) % half ELSE size - 1 - (slot - slot * 60 // 100) % half END AS place FROM schedule LEFT JOIN z ON o_custkey = c_custkey)
SELECT turn, s_suppkey, c_custkey, o_orderpriority FROM w LEFT JOIN e ON o_custkey = c_custkey AND e.place = w.place""")
def schedule_entities(t: Tables) -> DataFrame:
    """The turns' entities, from the frequent and the rare half of their sources'."""
    orders = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return schedule.with_entity(_schedule(t), orders, "c_custkey", "o_orderpriority").select("turn", "s_suppkey", "c_custkey", "o_orderpriority")
