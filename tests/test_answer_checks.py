"""Answers of the session questions against their schemas."""

import json

import pytest
from pyspark.sql import functions as F
from scorelake.operators import answer_checks

TOP = [{"rank": i, "product_id": f"P{i}", "name": "n", "revenue": 9.25 - i} for i in range(1, 6)]
CASES = [
    ("Q5", TOP, []),
    ("Q5", TOP[:4], [(None, None, "expected 5 rows, got 4")]),
    ("Q5", [TOP[1], TOP[0], *TOP[2:]], [(None, "rank", "ranks don't start at 1"), (None, "rank", "not in order")]),
    ("Q5", [{**TOP[0], "rank": True}, *TOP[1:]], [(0, "rank", "expected integer, got boolean")]),
    ("Q5", [{**TOP[0], "rank": "1"}, *TOP[1:]], [(0, "rank", "expected integer, got string"), (None, "rank", "ranks don't start at 1")]),
    ("Q7", [{"total_revenue": 12.5}], []),
    ("Q7", [{"total_revenue": 12.505}], [(0, "total_revenue", "more than two decimals")]),
    ("Q8", [{"total_qty_all": 12.505}, {"total_qty_all": None}], [(None, None, "expected 1 rows, got 2"), (1, "total_qty_all", "expected number, got void")]),
    ("Q9", [{"category": "b", "revenue": 1}, {"category": "a"}], [(1, "revenue", "missing"), (None, "category", "not in order")]),
    ("Q9", [{"category": 2, "revenue": 1}, {"category": "a", "revenue": 1, "more": []}], [(0, "category", "expected string, got integer")]),
    ("Q10", [], [(None, None, "no rows")]),
    ("Q3", [{"customer_id": "é", "total_qty": 1e300}, {"customer_id": "ü", "total_qty": -1}], []),
    ("Q3", "no JSON", [(None, None, "unreadable")]),
    ("Q3", {"customer_id": "a"}, [(None, None, "unreadable")]),
    ("Q3", [1], [(None, None, "unreadable")]),
    ("Q3", None, [(None, None, "unreadable")]),
    ("Q11", TOP, [(None, None, "unknown question")]),
    (None, TOP, [(None, None, "unknown question")]),
]


@pytest.fixture(scope="module")
def checked(spark):
    rows = [(i, q, a if a is None or isinstance(a, str) else json.dumps(a)) for i, (q, a, _) in enumerate(CASES)]
    return {r["id"]: r for r in answer_checks.check(spark.createDataFrame(rows, "id int, question string, answer string")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_problems(checked, i):
    assert [tuple(p) for p in checked[i]["problems"]] == CASES[i][2] and checked[i]["ok"] == (not CASES[i][2])


def test_empty_answers_may_be_allowed(spark):
    df = spark.createDataFrame([("Q1", "[]"), ("Q7", "[]")], "question string, answer string")
    made = answer_checks.check(df, may_be_empty=True).orderBy("question").collect()
    assert made[0]["ok"] and [p["problem"] for p in made[1]["problems"]] == ["expected 1 rows, got 0"]


def test_nothing_is_shuffled(spark):
    df = spark.createDataFrame([("Q1", "[]")], "question string, answer string")
    plan = answer_checks.long_form(answer_checks.check(df), ["question"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and len(plan) < 40_000
    assert answer_checks.long_form(answer_checks.check(df.filter(F.lit(False))), ["question"]).count() == 0
