"""Row lineage of SQL text on a small table: what each clause leaves, and what is refused."""

import pytest
from scorelake.plans import trace

ROWS = [
    (0, 1.1, "A", "X", 2), (1, 5.3, "A", "Y", 4), (2, 7.2, "B", "X", 1), (3, 9.4, "B", "Y", 6), (4, 10.5, "A", "X", 0),
]


@pytest.fixture(scope="module")
def balls(spark):
    return spark.createDataFrame(ROWS, "id bigint, overs double, bowler string, batsman string, runs bigint")


def outputs(balls, sql):
    return trace.describe(balls, "id", sql)


def test_where_and_order(balls):
    out = outputs(balls, "SELECT bowler, runs FROM df WHERE CEIL(overs) <= 6 ORDER BY runs DESC;")
    assert out["provenance_supported"], out["provenance_error"]
    assert out["row_indices_contributing"] == [0, 1] and out["output_row_provenance"] == [[1], [0]]
    assert [s["node_type"] for s in out["provenance_steps"]] == ["scan", "filter_where", "project", "order_by", "query"]
    progression = out["step_row_progression"]
    assert (progression["num_steps"], progression["max_row_count"]) == (3, 2)
    assert progression["steps"][0]["row_indices"] == [0, 1] and progression["steps"][1]["node_type"] == "project"


def test_group_and_having(balls):
    out = outputs(balls, "SELECT bowler, SUM(runs) AS total FROM df WHERE overs <= 11 GROUP BY bowler HAVING SUM(runs) > 6 ORDER BY total DESC")
    assert out["output_row_provenance"] == [[2, 3]] and out["row_indices_contributing"] == [2, 3]
    assert [s["node_type"] for s in out["provenance_steps"]] == ["scan", "filter_where", "group_by", "filter_having", "project", "order_by", "query"]
    assert [s["row_count"] for s in out["step_row_progression"]["steps"]] == [5, 5, 2, 2, 2]


@pytest.mark.parametrize(
    ("sql", "rows"),
    [
        ("SELECT over_no, COUNT(*) AS n FROM (SELECT CEIL(overs) AS over_no FROM df) t GROUP BY over_no ORDER BY over_no LIMIT 2", [[0], [1]]),
        ("SELECT CEIL(overs / 6) AS part, MAX(runs) AS best FROM df GROUP BY part ORDER BY part", [[0, 1], [2, 3, 4]]),
        ("SELECT bowler, COUNT(*) FROM df GROUP BY 1 ORDER BY 1 DESC", [[2, 3], [0, 1, 4]]),
        ("SELECT DISTINCT batsman FROM df ORDER BY batsman", [[0, 2, 4], [1, 3]]),
        ("SELECT * FROM df WHERE runs = (SELECT MAX(runs) FROM df)", [[3]]),
        ("SELECT COUNT(*) AS n FROM df HAVING COUNT(*) > 2", [[0, 1, 2, 3, 4]]),
        ("WITH a AS (SELECT bowler, batsman, SUM(runs) AS r FROM df GROUP BY bowler, batsman), b AS (SELECT bowler, MAX(r) AS top FROM a WHERE r > 1 GROUP BY bowler) SELECT top FROM b ORDER BY top", [[0, 1, 4], [3]]),
        ("SELECT 1 AS one", [[0, 1, 2, 3, 4]]),
    ],
)
def test_shapes(balls, sql, rows):
    out = outputs(balls, sql)
    assert out["provenance_supported"], out["provenance_error"]
    assert out["output_row_provenance"] == rows


def test_global_aggregates_have_no_group_step(balls):
    out = outputs(balls, "SELECT SUM(runs) AS total FROM df WHERE batsman = 'X' AND bowler = 'A'")
    assert [s["node_type"] for s in out["step_row_progression"]["steps"]] == ["filter_where", "project"]
    assert out["output_row_provenance"] == [[0, 4]]


def test_ctes_are_labelled(balls):
    out = outputs(balls, "WITH base AS (SELECT bowler, runs FROM df WHERE overs <= 6) SELECT bowler, SUM(runs) AS r FROM base GROUP BY bowler")
    assert any(s["label"] == "cte:base" for s in out["provenance_steps"]) and out["row_indices_contributing"] == [0, 1]


@pytest.mark.parametrize(
    ("sql", "why"),
    [
        ("SELECT a.bowler FROM df AS a JOIN df AS b ON a.bowler = b.bowler", "joins_not_supported"),
        ("SELECT batsman, ROW_NUMBER() OVER (ORDER BY overs) AS n FROM df", "window_not_supported"),
        ("SELECT bowler FROM df UNION SELECT batsman FROM df", "set_ops_not_supported"),
        ("SELECT bowler, COUNT(*) FROM df GROUP BY CUBE (bowler)", "grouping_sets_not_supported"),
    ],
)
def test_refusals_are_told(balls, sql, why):
    out = outputs(balls, sql)
    assert not out["provenance_supported"] and out["provenance_error"] == why
    assert out["row_indices_contributing"] == [] and out["provenance_steps"] == []


def test_nulls_and_empty_tables(spark, balls):
    with_nulls = spark.createDataFrame([(0, None, 1), (1, None, 2), (2, "null", 3)], "id bigint, k string, v bigint")
    assert sorted(trace.describe(with_nulls, "id", "SELECT k, SUM(v) AS s FROM df GROUP BY k")["output_row_provenance"]) == [[0, 1], [2]]
    assert outputs(balls.filter("false"), "SELECT bowler, COUNT(*) AS n FROM df GROUP BY bowler")["output_row_provenance"] == []
    assert outputs(balls.filter("false"), "SELECT COUNT(*) AS n FROM df")["output_row_provenance"] == [[]]


def test_projection_statistics(spark):
    out = trace.projection(spark, "WITH a AS (SELECT bowler, runs * 2 AS r FROM df) SELECT bowler, SUM(r) AS total, COUNT(*) AS n FROM a GROUP BY bowler", ["overs", "bowler"])
    assert (out["max_derived_column_count"], out["max_stage_column_count"], out["targeted_source_columns"]) == (2, 3, ["bowler", "r", "runs"])
    assert trace.projection(spark, "SELECT * FROM df", ["a", "b", "c"])["max_stage_column_count"] == 3
    assert trace.projection(spark, "SELEC", [])["error"]
