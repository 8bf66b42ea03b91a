"""Statements run in unions against the same statements run one by one."""

import datetime as dt
from decimal import Decimal

from scorelake.plans import batch, validate

GOOD = [
    "SELECT * FROM df ORDER BY n DESC, k",
    "SELECT k, count(*) AS n, sum(n) AS n FROM df GROUP BY k ORDER BY 2 DESC, 1",
    "SELECT n, x, d, t, day, flag FROM df WHERE n > 3 ORDER BY n",
    "SELECT avg(x) AS m, max(d) AS d FROM df WHERE x < 1e300",
    "SELECT k FROM df WHERE n < 0",
    "SELECT NULL AS nothing, 'a \"quoted\" ü' AS text, 1e300 * 10 AS big FROM df LIMIT 1",
    "SELECT array(n, n) AS pair FROM df ORDER BY n LIMIT 2",
    "WITH a AS (SELECT k, n FROM df) SELECT l.k, r.n FROM a l JOIN a r ON l.n = r.n ORDER BY 2, 1 LIMIT 5;",
]
BAD = ["SELECT nope FROM df", "SELEC 1", "DROP TABLE df", "SELECT n FROM other", "SELECT 1 / (n - n) AS x FROM df", "SELECT CAST(k AS INT) AS x FROM df"]


def source_of(spark):
    rows = [("ab"[i % 2], i, float("nan") if i == 5 else i / 3, Decimal(i) / 4, dt.datetime(2024, 1, 1, 10, 0, i % 3, 500_000 * (i % 2)), dt.date(2024, 1, 1 + i), i % 2 == 0) for i in range(9)]
    return validate.Source(spark.createDataFrame(rows, "k string, n bigint, x double, d decimal(10,2), t timestamp, day date, flag boolean").repartition(3))


def test_unions_give_what_single_runs_give(spark):
    source, jobs = source_of(spark), []
    found = batch.answers(source, [*GOOD, *BAD, *GOOD], 100, plan_size=5, jobs=jobs)
    assert set(found) == {*GOOD, *BAD}
    for sql in GOOD:
        assert found[sql] == validate.answer_of(source.run(sql)), sql
    assert all(isinstance(found[sql], Exception) for sql in BAD) and isinstance(found["DROP TABLE df"], PermissionError)
    assert "nope" in str(found["SELECT nope FROM df"]) and "DIVIDE_BY_ZERO" in str(found[BAD[4]])
    assert not source.session.table("df").is_cached


def test_number_of_jobs_follows_distinct_statements(spark):
    source, jobs = source_of(spark), []
    statements = [f"SELECT k, n + {i % 10} AS m FROM df WHERE n = {i % 9}" for i in range(90)] * 3
    found = batch.answers(source, statements, 100, plan_size=30, jobs=jobs)
    assert len(found) == 90 and jobs == [30, 30, 30]
    assert found[statements[50]] == {"columns": ["k", "m"], "rows": [["ab"[50 % 9 % 2], 50 % 9 + 50 % 10]]}


def test_long_answers_fail_alone(spark):
    source = source_of(spark)
    found = batch.answers(source, ["SELECT n FROM df", "SELECT n FROM df WHERE n < 3 ORDER BY n"], 3)
    assert isinstance(found["SELECT n FROM df"], ValueError) and found["SELECT n FROM df WHERE n < 3 ORDER BY n"]["rows"] == [[0], [1], [2]]
    assert batch.answers(source, [], 3) == {}
