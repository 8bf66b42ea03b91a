"""Difficulty and shape of a SQL query, from Catalyst's parsed plan."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from . import guard

AGGREGATES = frozenset("sum count avg mean min max stddev stddev_samp stddev_pop variance var_samp var_pop median percentile first last any_value collect_list collect_set count_if bool_and bool_or string_agg listagg max_by min_by mode".split())
#: Upper score of each label; beyond, expert.
LABELS = ((2, "easy"), (5, "medium"), (9, "hard"))


def features(spark: SparkSession, sql: str) -> dict[str, object]:
    """Counts of clauses and constructs, and the depth of nested queries (1 for a plain query)."""
    counts = dict.fromkeys(("joins", "ctes", "subqueries", "set_ops", "windows", "cases", "aggregates"), 0)
    flags = dict.fromkeys(("where", "group_by", "having", "order_by", "limit", "distinct"), False)
    depth = 1
    for node, d in guard.nodes(guard.parse(spark, sql.strip().rstrip(";"))):
        depth, kind = max(depth, d), guard.kind(node)
        flags["where"] |= kind == "Filter"
        flags["having"] |= kind == "UnresolvedHaving"
        flags["order_by"] |= kind == "Sort"
        flags["limit"] |= kind in ("GlobalLimit", "LocalLimit")
        flags["distinct"] |= kind == "Distinct"
        flags["group_by"] |= kind == "Aggregate" and not node.groupingExpressions().isEmpty()
        counts["joins"] += kind == "Join"
        counts["set_ops"] += kind in ("Union", "Intersect", "Except")
        counts["ctes"] += node.cteRelations().size() if kind == "UnresolvedWith" else 0
        counts["subqueries"] += kind == "SubqueryAlias" and guard.kind(node.child()) not in ("UnresolvedRelation", "UnresolvedInlineTable")
        for e in guard.expressions(node):
            name = guard.kind(e)
            counts["subqueries"] += name in guard.SUBQUERIES and name != "InSubquery"
            counts["windows"] += name in ("WindowExpression", "UnresolvedWindowExpression")
            counts["cases"] += name == "CaseWhen"
            counts["aggregates"] += name == "UnresolvedFunction" and list(guard._sequence(e.nameParts()))[-1].lower() in AGGREGATES
    # CTE bodies are wrapped as derived tables by the parser; they count as CTEs alone
    counts["subqueries"] = max(0, counts["subqueries"] - counts["ctes"])
    return {**flags, **counts, "depth": depth}


def score(f: dict[str, object]) -> int:
    """Points of a query's features (fixed values: weights and their bounds)."""
    flat = f["where"] + f["order_by"] + f["limit"] + 2 * f["group_by"] + 2 * f["having"] + f["distinct"] + (f["aggregates"] > 0)
    many = sum(min(2 * f[k], 6) for k in ("joins", "ctes", "subqueries")) + sum(min(3 * f[k], 6) for k in ("set_ops", "windows")) + min(f["cases"], 4)
    return flat + many + max(0, f["depth"] - 1)


def analyse(spark: SparkSession, sql: str) -> dict[str, object]:
    """Label, score, clause signature and features; label ``unknown`` if the text doesn't parse."""
    try:
        f = features(spark, sql)
    except (Py4JJavaError, PySparkException) as e:
        return {"label": "unknown", "score": None, "signature": "parse_error", "clauses": [], "features": {}, "error": str(e)}
    names = {"aggregate": "aggregates", "case": "cases", "join": "joins", "cte": "ctes", "subquery": "subqueries", "window": "windows", "set_op": "set_ops"}
    clauses = ["select", *(k for k in ("where", "group_by", "having", "order_by", "limit", "distinct") if f[k]), *(k for k, v in names.items() if f[v])]
    points = score(f)
    return {"label": next((n for most, n in LABELS if points <= most), "expert"), "score": points, "signature": "+".join(clauses), "clauses": clauses, "features": f, "error": None}


def output_width(spark: SparkSession, sql: str) -> int:
    """Columns of the result, stars and CTEs resolved by the analyser."""
    return len(spark.sql(sql).columns)
