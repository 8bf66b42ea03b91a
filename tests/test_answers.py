"""Split generation, benchmark preparation and the driver-side helpers of sampling."""

import json
import random

import numpy as np
from pyspark.sql import functions as F
from scorelake.functions import cells
from scorelake.operators import align, resample, sessions, signature, vote
from scorelake.plans import params, validate


def test_split_records_have_lineage(spark):
    balls = spark.createDataFrame([(0, "A", "X", 1), (1, "A", "Y", 2), (2, "B", "X", 3)], "id bigint, bowler string, batsman string, runs bigint")
    templates = [
        {"id": "m0", "question": "List the runs.", "sql": "SELECT batsman, runs FROM df WHERE runs < 3 ORDER BY runs DESC", "variables": [], "primary_key": ["batsman"]},
        {"id": "m1", "question": "Pairs?", "sql": "SELECT a.runs FROM df a JOIN df b ON a.bowler = b.bowler", "variables": []},
    ]
    records, errors = validate.generate_split(templates, {"one": balls}, "id")
    assert [r["template_id"] for r in records] == ["m0"] and [e["error"] for e in errors] == ["joins_not_supported"]
    made = records[0]
    assert made["primary_key"] == ["batsman"] and made["sample_idx"] == 0 and made["output_row_provenance"] == [[1], [0]]
    assert (made["row_indices_scanned_count"], made["row_indices_contributing_count"], made["num_answer_rows"]) == (3, 2, 2)
    assert made["projection"]["targeted_source_columns"] == ["batsman", "runs"] and made["analysis"]["label"] == "easy"


def test_benchmark_preparation():
    answer = {"columns": ["a"], "rows": [[1]]}
    records = [
        {"record_id": "1", "question": "q", "answer": answer, "source_id": "s"}, {"record_id": "1", "question": "q", "answer": answer, "context": "c"},
        {"record_id": "2", "question": "q", "answer": answer, "source_id": "none"}, {"record_id": "3", "question": "q", "answer": answer, "context": "own"},
        {"record_id": "4", "question": "", "answer": answer, "context": "c"},
    ]
    accepted, excluded = validate.prepare_benchmark(records, {"s": "whole"}, {"3": {"columns": ["a"], "rows": [[2]]}, "1": answer})
    assert [(r["record_id"], r["context"]) for r in accepted] == [("1", "whole")]
    assert [r["reason"] for r in excluded] == ["repeated record_id", "no context", "the answer isn't its statement's", "no question"]


def test_buckets_and_strata():
    turns = {}
    assert [params.pick_bucket(random.Random(1), ["a", "b"], turns, "x") for _ in range(3)] == ["a", "b", "a"]
    assert params.pick_bucket(random.Random(1), ["a", "b"], turns, "y") == "a" and params.pick_bucket(random.Random(1), ["a"]) == "a"
    values, strata = [0.0] * 50 + [1.0] * 50, ["l"] * 50 + ["h"] * 50
    assert resample.bootstrap_ci(values, 200, strata=strata) == (0.5, 0.5)
    low, high = resample.bootstrap_ci(values, 200)
    assert low < 0.5 < high and np.isnan(resample.bootstrap_ci([], 10, strata=[])[0])


def test_votes_by_similar_names():
    tables = [
        [{"name": "V. Kohli", "runs": 10}, {"name": "Rohit Sharma", "runs": 4}, {"name": "Ishant Sharma", "runs": 1}],
        [{"name": "Virat Kohli", "runs": 10}, {"name": "R Sharma", "runs": 4}, {"name": "Sharma", "runs": 9}],
        [{"name": "Kohli", "runs": 11}, {"name": "Rohit Sharma", "runs": "4.0"}, {"name": "Other", "runs": 2}],
    ]
    clusters = vote.cluster_rows(tables, ["name"])
    assert [[r["name"] for r in c] for c in clusters] == [["V. Kohli", "Virat Kohli", "Kohli"], ["Rohit Sharma", "R Sharma", "Rohit Sharma"], ["Ishant Sharma"], ["Sharma"], ["Other"]]
    assert [(r["name"], r["runs"]) for r in vote.vote_by_similar_key(tables, ["name"])] == [("V. Kohli", 10), ("Rohit Sharma", 4)]
    assert vote.key_cell_cost(3, "3.0") == 0 and vote.key_cell_cost("3", "4") == 1 and vote.key_cell_cost(None, None) == 0


def test_compatible_results(spark):
    gold, pred = {"columns": ["a", "b"], "rows": [[1, 2]]}, {"columns": ["x", "b", "a"], "rows": [[7, 2, 1]]}
    assert align.compare(gold, pred)["correct_cells"] == 2 and align.compare(gold, pred, compat=True)["correct_cells"] == 1
    assert len(validate.answer_of(spark.range(9), 4, compat=True)["rows"]) == 4
    log = spark.createDataFrame([("place_order", "c", "p", 2.0, 3.0), ("confirm_payment", "c", None, None, 6.0)], "op string, customer_id string, product_id string, qty double, unit_price double").selectExpr("*", "cast(null as double) old_qty", "cast(null as double) new_qty")
    made = sessions.signed(log)
    assert [sessions.by_customer(made, compat=c).first()["revenue"] for c in (True, False)] == [12.0, 6.0]
    assert spark.range(1).select(cells.to_float(F.lit(True)).alias("a"), cells.to_float(F.lit(True), compat=True).alias("b")).first() == (None, 1.0)
    for compat, again in ((False, True), (True, False)):
        known = signature.Registry(compat)
        assert known.add("SELECT 1", "one") and not known.add("select  1", "two") and not known.add("SELECT 2", "One")
        assert known.add("SELECT 2", "other") == again


def test_votes_of_equal_keys_need_no_assignment(monkeypatch):
    def never(cost):
        raise AssertionError("assigned")

    monkeypatch.setattr(vote, "assign", never)
    tables = [[{"k": i, "v": i} for i in range(50) if i % 4], [{"k": f"{i}.0", "v": i + 1} for i in range(49, 0, -1) if i % 4], [{"k": i, "v": i} for i in range(50)], [{"k": i, "v": i} for i in range(40, 60)]]
    made = vote.vote_by_similar_key(tables, ["k"])
    assert [r["v"] for r in made] == [i for i in range(50) if i % 4]
    names = [[{"a": "V. Kohli", "b": i, "v": i} for i in range(3)], [{"a": "v kohli", "b": str(i), "v": i} for i in (2, 0)]]
    assert [r["v"] for r in vote.vote_by_similar_key(names, ["a", "b"])] == [0, 2]


def test_equal_keys_are_matched_as_by_assignment(monkeypatch):
    rng, equal, met = random.Random(5), vote._match_equal, []
    cells = ["V. Kohli", "Virat Kohli", "Kohli", "v kohli", "R Sharma", "Sharma", "!", "?", "", None, "nan", True, "true", 1, "1.0", 2.5, "2.50", [1], -0.0, "0", 3, 4]
    for _ in range(400):
        keys, pool = rng.choice([["a"], ["a", "b"]]), rng.choice([cells, cells[:9], cells[13:]])
        base = [{**{k: rng.choice(pool) for k in keys}, "v": rng.choice([1, 1.0, "1", 2, None, "x", True])} for _ in range(rng.randint(0, 5))]
        tables = [[{**row, "v": rng.choice([row["v"], 2])} for row in rng.sample(base, rng.randint(0, len(base)))] for _ in range(rng.randint(0, 4))]
        monkeypatch.setattr(vote, "_match_equal", lambda *args: met.append(equal(*args)) or met[-1])
        got = repr(vote.vote_by_similar_key(tables, keys, 0.2))
        monkeypatch.setattr(vote, "_match_equal", lambda *args: None)
        assert got == repr(vote.vote_by_similar_key(tables, keys, 0.2)), tables
    assert sum(m is not None for m in met) > 100 and None in met


def test_voted_records(spark):
    table = lambda *rows: json.dumps([dict(zip("kv", r, strict=True)) for r in rows], ensure_ascii=False)
    rows = [
        ("a", 2, ["k"], table((2, "é"), (1, 5))), ("a", 1, ["k"], table((1, 5), (3, 0))), ("a", 3, ["k"], table((1, 6), ("2.0", "é"))),
        ("b", 1, [], table((1, 5))), ("b", 2, [], table((1, 6))), ("b", 3, [], table((2, 6))), (None, 1, ["k"], table()),
    ]
    made = vote.vote_records(spark.createDataFrame(rows, "record_id string, vote int, keys array<string>, rows string").repartition(3))
    assert {r["record_id"]: r["rows"] for r in made.collect()} == {"a": table((1, 5), (2, "é")), "b": table((1, 6)), None: "[]"}
    assert "MapInArrow" in made._jdf.queryExecution().executedPlan().toString()  # batches of records, not a call for each
