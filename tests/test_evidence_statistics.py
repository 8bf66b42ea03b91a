"""Statistics over long lineage, and what of them a task concerns, on awkward rows."""

from pyspark.sql import functions as F
from scorelake.operators import evidence

BASE = "row bigint, at string, runs string, name string, fours int, extra string"


def test_statistics_of_awkward_rows(spark):
    base = spark.createDataFrame([(1, "0.1", "4", "Ann", 1, "x"), (2, "0.2", None, " ", 0, "x"), (3, "late", "many", None, None, "x"), (4, "2.5", "1.5", "Bob", 0, "x"), (5, None, "0", "Ann", 2, "x")], BASE)
    lineage = spark.createDataFrame([(10, i) for i in (1, 2, 3, 4, 5, 5, 1)] + [(11, 3), (12, 99)], "__out bigint, row_id bigint")
    made = evidence.evidence_statistics(lineage, base, "row", "at", ["runs", "fours"], {"dots": F.expr("coalesce(try_cast(runs AS double), 0) = 0"), "bounds": F.col("fours") > 0}, ["name"])
    found = {r["__out"]: r.asDict() for r in made.collect()}
    assert set(found) == {10, 11}  # a result row without base rows has no statistics
    assert found[10] == {"__out": 10, "num_events": 5, "first_place": 0.1, "last_place": 2.5, "sum_runs": 5.5, "sum_fours": 3.0, "dots": 3, "bounds": 2, "unique_name": ["Ann", "Bob"]}
    assert found[11] == {"__out": 11, "num_events": 1, "first_place": None, "last_place": None, "sum_runs": 0.0, "sum_fours": 0.0, "dots": 1, "bounds": 0, "unique_name": []}


def test_relevant_columns_and_task_statistics(spark):
    rows = spark.createDataFrame([("Dot BALLS of Ann", ["name"], 1.0, 2.0, 3), ("first over", None, 1.0, 2.0, 3), (None, ["runs"], 1.0, 2.0, 3)], "q string, pk array<string>, first_place double, sum_runs double, dots int")
    columns = evidence.relevant_columns(F.col("q"), F.col("pk"), {"runs": ["dot", "Run"], "at": ["over"]}, ["at", "name", "runs"])
    told = evidence.task_statistics(rows.withColumns({"columns": columns, "last_place": F.lit(9.0)}), F.col("q"), F.col("columns"), ["runs"], ["first", "over"], {"dots": (["runs"], ["dot"])}).collect()
    assert [r["columns"] for r in told] == [["name", "runs"], ["at"], ["runs"]]
    assert [(r["first_place"], r["last_place"], r["sum_runs"], r["dots"]) for r in told] == [(None, None, 2.0, 3), (1.0, 9.0, None, None), (None, None, 2.0, None)]
