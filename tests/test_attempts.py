"""Run logs in both layouts, and the files that a filter leaves out."""

import json
import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from scorelake.functions import cells
from scorelake.operators import attempts
from scorelake.plans import catalog

SCHEMA = "sample_id string, valid boolean"


def files_read(df):
    """Files that the scan of a collected plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numFiles").get().value()


def test_files_by_name(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, valid in (("s1_a1", True), ("s1_a2", True), ("deep/s1_a3", False), ("s2_a1", True), ("s2_x", True)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"sample_id": name.split("/")[-1][:2], "valid": valid}, indent=1))
    logs = attempts.read_attempts(spark, str(tmp_path), SCHEMA)
    assert sorted((r.file, r.attempt) for r in logs.collect()) == [("s1_a1.json", 1), ("s1_a2.json", 2), ("s1_a3.json", 3), ("s2_a1.json", 1), ("s2_x.json", 2)]
    assert {tuple(r) for r in attempts.winners(logs, ["sample_id"]).select("sample_id", "attempt").collect()} == {("s1", 2), ("s2", 2)}
    assert logs.filter("file = 's1_a2.json'").count() == 1 and files_read(logs.filter("file = 's1_a2.json'")) == 1 and files_read(logs.filter("attempt = 1")) == 2


def test_folders_of_attempts(spark, tmp_path):
    rows = [("s1", True, 1), ("s1", False, 2), ("s2", True, 2), ("s2", True, 10)]
    folder = str(tmp_path / "run")
    spark.createDataFrame(rows, f"{SCHEMA}, attempt int").repartition(1).write.partitionBy("attempt").json(folder)
    logs = attempts.read_attempts(spark, folder, SCHEMA)
    assert sorted((r.sample_id, r.valid, r.attempt) for r in logs.collect()) == sorted(rows) and files_read(logs.filter("attempt = 10")) == 1
    assert {tuple(r) for r in attempts.winners(logs, ["sample_id"]).select("sample_id", "attempt").collect()} == {("s1", 1), ("s2", 10)}


def test_log_files_at_the_threshold(spark, tmp_path):
    """Means of exactly 40 whose partial sums by files are rounded up: not above 40."""
    files = [[(1, 1, 50.0), (2, 1, 6.96), (6, 1, 12.81), (3, 2, 40.01), (1, 3, float("nan")), (2, 4, None), (3, 5, 1e30)], [(10, 1, 65.94), (14, 1, 74.29), (7, 2, 40.0), (2, 3, 40.0), (2, 4, 41.0), (7, 5, 1.0)]]
    (tmp_path / "events.parquet").mkdir()
    for i, rows in enumerate(files):
        pq.write_table(pa.table(dict(zip(["event_id", "user_id", "value"], map(list, zip(*rows)), strict=True))), tmp_path / "events.parquet" / f"{i}.parquet")
    assert (6.96 + 12.81) + (65.94 + 74.29) > 160 == 6.96 + 12.81 + 65.94 + 74.29
    duck = duckdb.connect(config={"threads": 1})
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = {tuple(r) for r in catalog.queries()["log_files"](spark, str(tmp_path)).collect()}
    assert got == set(duck.execute(catalog.oracle_sql()["log_files"]).fetchall()) == {(1, 1), (2, 3), (3, 1), (4, 2), (5, 3)}


def test_mean_above(spark):
    groups = {"tie": [0.1] * 10, "over": [0.1] * 9 + [0.11], "under": [0.1] * 9 + [0.09], "negative": [-1.1, 1.3], "nan": [0.0, math.nan], "infinite": [math.inf, 0.1], "huge": [1e300, -1.0], "tiny": [0.1, 1e-300], "none": [None, None], "some": [None, 0.2]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    want = {"tie": False, "over": True, "under": False, "negative": False, "nan": True, "infinite": True, "huge": True, "tiny": False, "none": None, "some": True}
    for order in (rows, rows[::-1]):
        made = spark.createDataFrame(order, "k string, v double").repartition(3).groupBy("k").agg(cells.mean_above(F.col("v"), "0.1").alias("above"))
        assert {r["k"]: r["above"] for r in made.collect()} == want
