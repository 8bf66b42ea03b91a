"""Operators that SQL doesn't express, against brute force and small hand-made cases."""

import itertools
import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from scorelake.functions import cells, text
from scorelake.operators import align, idioms, lineage, resample, sessions, signature, temporal, vote
from scorelake.plans import catalog, difficulty, guard, params, validate
from scorelake.sources import readers, writers
from scorelake.streaming import orders

BALLS = [(1.1, "A", "x", 4.0), (1.2, "A", "y", 0.0), (1.3, "B", "x", 6.0), (2.1, "B", "y", 1.0), (2.1, "B", "x", 4.0)]


@pytest.fixture(scope="module")
def balls(spark):
    return spark.createDataFrame(BALLS, "overs double, bowler string, batsman string, batsman_runs double")


# lineage


@pytest.fixture(scope="module")
def traced(balls):
    return lineage.TracedFrame.scan(lineage.with_row_ids(balls, ["overs", "batsman"], "id"), "id")


def test_row_ids_are_dense(spark):
    df = lineage.with_row_ids(spark.range(1000).repartition(7).select((F.lit(999) - F.col("id")).alias("k")), ["k"])
    assert [(r["k"], r["__row"]) for r in df.orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_lineage_of_where_group_having_and_global(traced):
    def ids(t, *keys):
        return {tuple(r[k] for k in keys): r[lineage.PROV] for r in t.rows().collect()}

    assert sorted(x for v in ids(traced.where("batsman_runs >= 4"), "id").values() for x in v) == [0, 2, 3]
    groups = traced.group(["batsman"], [F.sum("batsman_runs").alias("runs")])
    assert ids(groups, "batsman", "runs") == {("x", 14.0): [0, 2, 3], ("y", 1.0): [1, 4]}
    assert ids(groups.having("runs > 5"), "batsman") == {("x",): [0, 2, 3]}
    assert ids(traced.group([], [F.sum("batsman_runs").alias("runs")]), "runs") == {(15.0,): [0, 1, 2, 3, 4]}
    assert [s["step"] for s in groups.having("runs > 5").progression()] == ["group", "having"]
    assert {r["row_id"] for r in groups.having("runs > 5").contributing().collect()} == {0, 2, 3}
    joined = groups.join(traced.where("overs > 2").select("batsman", "overs"), "batsman")
    assert sorted(map(tuple, (r[lineage.PROV] for r in joined.rows().collect()))) == [(0, 2, 3), (1, 4)]


# signatures and deduplication


def test_answer_signature_is_a_multiset():
    a = {"columns": ["x", "y"], "rows": [[1, "a"], [2.0000000000001, None], [1, "a"]]}
    assert signature.answer_signature(a) == signature.answer_signature({"columns": ["x", "y"], "rows": [[2.0, None], [1, "a"], [1, "a"]]})
    assert signature.answer_signature(a) != signature.answer_signature({"columns": ["x", "y"], "rows": [[2.0, None], [1, "a"]]})
    assert signature.answer_signature(a) != signature.answer_signature({"columns": ["x", "z"], "rows": a["rows"]}) and signature.answer_signature(None) == ""
    assert signature.exact_match({"columns": ["a"], "rows": [["3.0"], [2]]}, {"columns": ["b"], "rows": [[2.001], [3]]})["exact_match"]


def test_frame_signature(spark):
    df = spark.createDataFrame([(1, "a", 0.1), (2, None, float("nan")), (2, None, None)], "i int, s string, d double")
    one = signature.frame_signature(df).first()
    assert one["signature"] == signature.frame_signature(df.repartition(3).toDF("x", "y", "z")).first()["signature"]
    assert one["signature"] != signature.frame_signature(df.union(df.limit(1))).first()["signature"] and one["rows"] == 3
    assert signature.frame_signature(df.filter("false")).first()["rows"] == 0


def test_first_wins_keeps_rows_without_fingerprint(spark):
    df = spark.createDataFrame([(0, "s", "f"), (1, "s", "f"), (2, "t", "f"), (3, "s", ""), (4, "s", None), (5, None, "f"), (6, None, "f")], "i int, src string, fp string")
    assert [r["i"] for r in signature.first_wins(df, ["src"], "fp", "i").filter("kept").orderBy("i").collect()] == [0, 2, 3, 4, 5]


# alignment, metrics and votes


def test_assignment_is_optimal():
    draw = np.random.default_rng(3)
    for n in range(1, 7):
        for _ in range(12):
            cost = np.round(draw.random((n, n)) * 10)
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            pairs = align.assign(cost)
            assert sorted(i for i, _ in pairs) == sorted(j for _, j in pairs) == list(range(n))
            assert math.isclose(sum(cost[i, j] for i, j in pairs), best)


def test_surnames_align_and_metrics_add_up(spark):
    gold = {"columns": ["batsman", "runs"], "rows": [["Ben Duckett", 10], ["Joe Root", 0], ["Zak Crawley", None]]}
    pred = {"columns": ["batsman", "runs"], "rows": [["Crawley", 0], ["Duckett", 12]]}
    m = align.compare(gold, pred, ["batsman"])
    assert m["pairs"] == 2 and m["pk_recall"] == 2 / 3 and m["pk_precision"] == 1.0 and m["correct_cells"] == 1
    assert m["weighted_mae"] == 1.0 and m["tp"] == 1 and m["tn"] == 1
    assert align.compare(gold, gold, ["batsman"])["exact_match"]
    rows = [("a", json.dumps(gold), json.dumps(pred), ["batsman"]), ("b", json.dumps(gold), None, None), ("c", json.dumps(gold), "oops", ["batsman"])]
    got = {r["record_id"]: r for r in align.score_tables(spark.createDataFrame(rows, "record_id string, gold string, pred string, primary_key array<string>")).collect()}
    assert got["a"]["pairs"] == 2 and got["b"]["pairs"] == 0 and got["c"]["pk_recall"] == 0.0


def test_names():
    assert align.token_sort_ratio("Root Joe", "joe root") == 1.0 and align.name_similarity("Root", None) == 0.0
    assert math.isclose(align.token_sort_ratio("abcd", "abxd"), 0.75) and align.name_similarity("abcd", "abxd") == 0.0


def test_votes():
    assert vote.vote_cell([1, "1.0", 2]) == 1 and vote.vote_cell([10, 10.1, 9.9, 3, 3], 0.15) == 10
    assert vote.vote_by_position([[[1]], [[1], [2]], [[1], [3]], [[1], [3.0]]]) == [[1], [3]]
    assert vote.vote_by_key([[{"k": "a", "v": 1}], [{"k": "a", "v": 1}, {"k": "b", "v": 2}], [{"k": "a", "v": 5}]], ["k"]) == [{"k": "a", "v": 1}]


# statistics


def test_resampling_is_seeded_and_sane():
    x = [1.0, 2.0, 3.0, 4.0, math.nan]
    low, high = resample.bootstrap_ci(x, 500)
    assert (low, high) == resample.bootstrap_ci(x, 500) and 1 <= low < 2.5 < high <= 4
    assert all(math.isnan(v) for v in resample.bootstrap_ci([], 10)) and resample.significance(1, 2) == "significant"
    assert resample.sign_flip_pvalue([5.0] * 12, 500) < 0.01 and resample.sign_flip_pvalue([1, -1] * 6, 500) == 1.0
    assert resample.label_permutation_pvalue([1, 2, 3] * 5, [11, 12, 13] * 5, 300) < 0.01


def test_tests_match_known_values():
    d = [1.1, -0.4, 2.0, 0.3, 1.7, -0.2, 0.9, 1.4]
    assert math.isclose(resample.sign_pvalue(d), 2 * (1 + 8 + 28) / 256)
    n = len(d)
    t = np.mean(d) / (np.std(d, ddof=1) / math.sqrt(n))
    grid = np.linspace(abs(t), 2000, 4_000_001)
    density = math.gamma(n / 2) / (math.sqrt((n - 1) * math.pi) * math.gamma((n - 1) / 2)) * (1 + grid**2 / (n - 1)) ** (-n / 2)
    assert math.isclose(resample.paired_t_pvalue(d), 2 * float(np.sum((density[1:] + density[:-1]) / 2) * (grid[1] - grid[0])), rel_tol=1e-4)
    assert resample.mann_whitney_pvalue([1, 2, 3], [1, 2, 3]) == 1.0 and resample.mann_whitney_pvalue(range(20), range(40, 60)) < 1e-6
    assert resample.wilcoxon_pvalue(range(1, 21)) < 1e-3


def test_summaries_by_group(spark):
    rows = [(g, float(i + (g == "b")), float(i)) for g in "ab" for i in range(6)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in resample.by_group(df, ["g"], "n_pairs bigint, mean_delta double", lambda p: {k: v for k, v in resample.paired_summary(p["x"], p["y"]).items() if k in ("n_pairs", "mean_delta")}).collect()}
    assert (got["a"]["mean_delta"], got["b"]["mean_delta"], got["a"]["n_pairs"]) == (0.0, 1.0, 6)


# temporal relations, samplers, templates


def test_temporal_relations_agree_with_their_text(spark, balls):
    for name in temporal.RELATIONS:
        sql, words = temporal.phrase(name, 2.1, 1.2)
        kept = balls.filter(temporal.predicate(name, F.col("overs"), 1.2, 2.1)).count()
        assert kept == balls.filter(sql).count() and words
    assert temporal.phrase(None, 1, 2) == (None, "the entire match")
    with pytest.raises(ValueError):
        temporal.phrase("sideways", 1, 2)
    values = [0.0, 1.05, 1.6, 1.7, 19.95, 3.0]
    want = [0.1, 1.1, 1.6, 2.1, 20.1, 3.1]
    assert [temporal.snap_over_ball(v) for v in values] == want
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(temporal.snap_column(F.col("v"))).collect()] == want


def test_sampling_is_seeded(balls):
    p = params.profile(balls)
    assert p.entities["bowler"] == [("B", 3), ("A", 2)] and p.bounds["x", None] == (1.1, 2.1)
    one = params.sample(p, ["batsman", "bowler", "temporal_predicate"], 4, 7)
    assert one == params.sample(p, ["batsman", "bowler", "temporal_predicate"], 4, 7) and {x["batsman"] for x in one} == {"x", "y"}
    assert all(a != b for a, b in params.spectrum_pairs([("a", 3), ("b", 1)], 3)) and params.sample(p, [], 3, 1) == [{"table_name": "df"}]
    assert len({t["category"] for t in params.diverse([{"category": c} for c in "aaab"], 2)}) == 2


def test_instantiation():
    template = "SELECT * FROM {table_name} WHERE b = '{name}' AND c = {n} AND d = {who} AND {temporal_predicate} AND e = '{gone}'"
    values = {"table_name": "df", "name": "O'Brien", "n": 3, "who": "x", "temporal_predicate": "(overs < 2.1)"}
    sql = text.instantiate(template, values)
    assert sql == "SELECT * FROM df WHERE b = 'O''Brien' AND c = 3 AND d = 'x' AND (overs < 2.1) AND e = '{gone}'"
    assert text.parameters_of("a = '{x}' AND b = {y}", "a = 'Joe Root'  AND b = 5") == {"x": "Joe Root", "y": "5"} and text.parameters_of("a {x}", "b") == {}
    assert text.sql_literal(None) == "NULL" and text.sql_literal(True) == "TRUE" and text.sql_literal("it's") == "'it''s'"
    assert text.first_json('noise {"a": [1, 2,],} tail') == {"a": [1, 2]} and text.first_json("x [1] {", "[") == [1] and text.first_json(None) is None


def test_text_and_cell_columns(spark):
    df = spark.createDataFrame([(" SELECT  1 -- c\n, 'a''b' ",), (None,)], "s string")
    row = df.select(text.canonical_sql("s" and F.col("s")).alias("c"), text.canonical_sql_shape(F.col("s")).alias("d"), text.fingerprint(text.canonical_sql(F.col("s"))).alias("f")).collect()
    assert row[0]["c"] == "select 1 -- c , 'a''b'" and row[0]["d"] == "select <num> , <str>" and row[1]["f"] == ""
    v = spark.createDataFrame([("12.50",), (" -0.0 ",), ("x",), (None,), ("inf",), ("Ben Duckett",)], "v string")
    got = [tuple(r) for r in v.select(cells.to_float(F.col("v")), cells.signature_cell(F.col("v")), cells.is_zeroish(F.col("v")), cells.surname(F.col("v"))).collect()]
    assert got[0][:3] == (12.5, "12.5", False) and got[1][2] and got[2][0] is None and got[3][2] and got[4][0] is None and got[5][3] == "duckett"
    assert [r[0] for r in v.select(cells.plain_number(F.col("v"))).collect()][:3] == ["12.5", "0", None]


def test_idioms_over_edges(spark):
    spans = spark.createDataFrame([("a", 1, 2, 3), ("b", 9, 10, 1)], "e string, first int, last int, rows int")
    assert {r["e"]: r["buckets"] for r in idioms.span_buckets(spans, 0, 10).collect()} == {"a": ["first_half"], "b": ["second_half"]}
    tiers = {r["u"]: r["tier"] for r in idioms.frequency_tiers(spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("z",)], "u string"), "u").collect()}
    assert tiers == {"x": "top", "y": "middle", "z": "bottom"}
    assert idioms.concat_ordered(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "k int, o int, t string"), ["k"], "o", F.col("t"), " ", 2).first()["context"] == "a  ..."
    assert idioms.compress_ranges(spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 7)], "k int, n int"), ["k"], "n").first()["ranges"] == "1-3, 7"


def test_concat_marks_texts_that_end_at_the_limit(spark):
    made = lambda rows, separator, most: {r["k"]: r["context"] for r in idioms.concat_ordered(spark.createDataFrame(rows, "k int, o int, t string"), ["k"], "o", F.col("t"), separator, most).collect()}
    rows = [(1, 1, "abc"), (1, 2, "d"), (2, 1, "abc"), (3, 1, "ab"), (3, 2, "d"), (3, 3, ""), (4, 1, "a"), (4, 2, ""), (5, 1, None), (6, None, "z"), (6, 1, "a"), (6, 2, None)]
    assert made(rows, "", 3) == {1: "abc ...", 2: "abc", 3: "abd", 4: "a", 5: None, 6: "az"}
    assert made(rows, "--", 3) == {1: "abc ...", 2: "abc", 3: "ab- ...", 4: "a--", 5: None, 6: "a-- ..."}
    assert made(rows, "--", None) == {1: "abc--d", 2: "abc", 3: "ab--d--", 4: "a--", 5: None, 6: "a--z"}


@pytest.mark.parametrize("name", ["context_cut", "context_concat"])
def test_contexts_equal_their_sql_at_the_limit(spark, tmp_path, name):
    rows = [(1, 0, "user", "x" * 53), (1, 1, "user", "y"), (2, 0, "user", "x" * 53), (3, 0, "user", "x" * 52), (3, 1, "user", ""), (4, 0, "user", None), (4, 1, None, "x"), (5, 0, "user", "x"), (5, 1, "user", None), (6, None, "user", "z"), (6, 3, "user", "a")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    want = duckdb.sql(catalog.oracle_sql()[name].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)


# guard and difficulty


@pytest.mark.parametrize("sql", ["SELECT 1", "SELECT * FROM df;", "WITH a AS (SELECT batsman FROM df) SELECT count(*) FROM a", "SELECT batsman FROM df WHERE batsman IN (SELECT batsman FROM df) ORDER BY 1 LIMIT 3", "SELECT sum(batsman_runs) OVER (ORDER BY overs) FROM df UNION ALL SELECT 1", "SELECT 'DROP TABLE x; --' AS t FROM df"])
def test_guard_lets_queries_pass(spark, sql):
    assert guard.why_not(spark, sql) is None


@pytest.mark.parametrize("sql", [None, "", "DELETE FROM df", "DROP TABLE df", "CREATE TABLE x AS SELECT 1", "SELECT * FROM other", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM a.df", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT * FROM range(10)", "SELECT 1; SELECT 2", "INSERT INTO df VALUES (1)", "SELECT (SELECT count(*) FROM parquet.`/x`)", "SELEKT 1", "SET a=b", "SELECT * FROM df WHERE EXISTS (SELECT 1 FROM secrets)"])
def test_guard_refuses(spark, sql):
    assert guard.why_not(spark, sql)


def test_difficulty(spark):
    easy = difficulty.analyse(spark, "SELECT batsman FROM df WHERE batsman_runs > 3")
    assert (easy["label"], easy["score"], easy["signature"]) == ("easy", 1, "select+where")
    hard = difficulty.analyse(spark, "WITH a AS (SELECT batsman, SUM(batsman_runs) AS r FROM df GROUP BY batsman HAVING SUM(batsman_runs) > 3) SELECT DISTINCT x.batsman, CASE WHEN r > 5 THEN 1 END, RANK() OVER (ORDER BY r) FROM a x JOIN df y ON x.batsman = y.batsman ORDER BY 1 LIMIT 2")
    f = hard["features"]
    assert hard["label"] == "expert" and (f["joins"], f["ctes"], f["subqueries"], f["windows"], f["cases"], f["depth"]) == (1, 1, 0, 1, 1, 2)
    assert f["having"] and f["group_by"] and f["distinct"] and f["limit"] and f["order_by"] and not f["where"]
    assert difficulty.analyse(spark, "SELECT batsman FROM (SELECT batsman FROM df) t WHERE batsman = (SELECT max(batsman) FROM df)")["features"]["subqueries"] == 2
    assert difficulty.analyse(spark, "SELEKT")["label"] == "unknown"


# validation and generation


def test_validate_and_deduplicate(spark, balls):
    right = {"columns": ["n"], "rows": [[5]]}
    records = [{"record_id": "a", "sql": "SELECT count(*) AS n FROM df", "answer": right}, {"record_id": "b", "query": "SELECT COUNT(1) AS n FROM df", "answer": right}, {"sql": "SELECT count(*) AS n FROM df", "answer": {"columns": ["n"], "rows": [[6]]}}, {"sql": "DELETE FROM df"}, {"sql": ""}, {"sql": "SELECT nope FROM df"}, {"sql": "SELECT 1", "source": None}]
    details = validate.validate(records, lambda r: None if "source" in r else balls)
    assert [d["ok"] for d in details] == [True, True, False, False, False, False, False] and "rejected" in details[3]["error"]
    assert validate.report(details) == {"total_records": 7, "valid_records": 2, "invalid_records": 5}
    kept, removed = validate.deduplicate(records[:3])
    assert len(kept) == 2 and removed[0]["duplicate_of"] == 0


def test_generate_is_deterministic(spark, balls):
    templates = [{"id": 1, "question": "Runs of {batsman}?", "sql": "SELECT SUM(batsman_runs) AS runs FROM {table_name} WHERE batsman = '{batsman}'", "variables": ["batsman"], "primary_key": ["N/A"]}, {"id": 2, "question": "Balls {temporal_predicate}?", "sql": "SELECT count(*) AS n FROM df WHERE {temporal_predicate}", "variables": ["temporal_predicate"]}, {"id": 3, "question": "", "sql": "SELECT nope FROM df", "variables": []}]
    made, errors = validate.generate(templates, {"m": balls}, 2)
    again, _ = validate.generate(templates, {"m": balls}, 2)
    assert [r["record_id"] for r in made] == [r["record_id"] for r in again] and any(e["template_id"] == 3 for e in errors)
    assert all(d["ok"] for d in validate.validate(made, lambda r: balls)) and made[0]["question"] == "Runs of x?"
    assert validate.is_zeroish({"rows": [[0, None, " "]]}) and not validate.is_zeroish({"rows": [["a"]]}) and validate.zero_columns(spark.createDataFrame([(0, 1.0, "x"), (None, 0.0, "0")], "a int, b double, c string")) == ["a", "c"]
    assert validate.cap_zeroish([True, False, True]) == [False, True, False] and validate.coverage_schedule(2, 5) == [(0, 0), (1, 1), (0, 2), (1, 3), (0, 4)]


# sources and sinks


def test_csv_events(spark, tmp_path):
    header = [f.split()[0] for f in readers.BALL_SCHEMA.split(", ")]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one.csv").write_text(",".join(header) + '\n"two\nlines, ""quoted""",0.1,W,1,"c",b,a,1,0,0,1,1,1,0,,1\n')
    df = readers.read_events(spark, str(tmp_path))
    row = df.first()
    assert row["raw_data"] == 'two\nlines, "quoted"' and row["overs"] == 0.1 and row["dismissal"] is None and row["source_id"].endswith("one.csv")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.list_sources(spark, str(tmp_path)).collect()] == ["one.csv"]
    assert "commentary" not in dict(readers.preview(df)[0]) and readers.head_columns(df, ["overs", "nope"], 1).first()["nope"] is None


def test_records_templates_and_files(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"final": [{"id": "a", "sql": "SELECT 1"}, {"id": None, "sql": "x"}], "note": 1}))
    (tmp_path / "r.jsonl").write_text('{"record_id": "q"}\n\n{"record_id": null}\n')
    assert readers.read_records(spark, str(tmp_path / "r.json")).count() == 2 and readers.read_records(spark, str(tmp_path / "r.jsonl")).count() == 2
    named = readers.with_record_ids(readers.read_records(spark, str(tmp_path / "r.json")), order="sql")
    assert sorted(r["record_id"] for r in named.collect()) == ["a", "r1"]
    (tmp_path / "t.py").write_text("question_templates = [{'id': 1, 'question': 'q', 'query': 'SELECT 1', 'exp': 'e', 'variables': \"['a', 'b']\", 'primary_key': 'x, y'}]\nimport os\n")
    t = readers.read_templates(spark, [str(tmp_path / "t.py")]).first()
    assert t["sql"] == "SELECT 1" and t["variables"] == ["a", "b"] and t["primary_key"] == ["x", "y"]
    assert readers.final_nodes({"a": [{"final": 1}], "final": 2}) == [("$.a[0].final", 1), ("$.final", 2)]
    (tmp_path / "q.sql").write_text("-- Query 1\nSELECT 1;\n-- Query 2\nSELECT 2;\n")
    assert [r["sql"] for r in readers.read_sql_file(spark, str(tmp_path / "q.sql")).collect()] == ["SELECT 1;", "SELECT 2;"]
    bench = spark.createDataFrame([("a", "c", "q", "1"), ("a", "c", "q", "1"), ("b", " ", "q", "1"), ("d", "c", "q", "1")], "record_id string, context string, question string, answer string")
    assert sorted(r["problem"] or "" for r in readers.check_benchmark(bench).collect()) == ["", "no context", "repeated record_id", "repeated record_id"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, None) for i in range(10)], "i int, n string")
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 10 and not writers.write_slice(df, "i > 99", str(tmp_path / "none"))
    writers.write_shards(df, "i", 3, str(tmp_path / "shards"))
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "shards")).groupBy("shard").count().collect()) == [3, 3, 4]
    writers.write_manifest(spark, str(tmp_path / "manifest.json"), {"rows": 10})
    writers.write_envelope(df, str(tmp_path / "e.json"), {"note": 1})
    assert json.loads((tmp_path / "manifest.json").read_text())["rows"] == 10 and len(json.loads((tmp_path / "e.json").read_text())["final"]) == 10
    (tmp_path / "files").mkdir()
    for n in "abc":
        (tmp_path / "files" / n).write_text(n)
    listed = writers.checksums(spark, str(tmp_path / "files")).filter("name <> 'c'").union(spark.createDataFrame([("d", "0")], "name string, sha256 string"))
    wrong = listed.withColumn("sha256", F.when(F.col("name") == "a", "0").otherwise(F.col("sha256")))
    assert {(r["name"], r["problem"]) for r in writers.audit(spark, str(tmp_path / "files"), wrong).collect()} == {("a", "changed"), ("c", "not listed"), ("d", "missing")}


# sessions, in batch and as a stream

EVENT = "session_id string, op string, order_id string, customer_id string, product_id string, qty double, unit_price double, old_qty double, new_qty double"
LOG = [("s", "place_order", "o1", "c1", "p1", 2.0, 5.0, None, None), ("s", "add_item", "o1", "c1", "p2", 1.0, 3.0, None, None), ("s", "modify_item", "o1", "c1", "p1", None, 5.0, 2.0, 3.0), ("s", "return_item", "o1", "c1", "p2", 1.0, 3.0, None, None), ("s", "confirm_payment", "o1", "c1", None, 0.0, 15.0, None, None), ("s", "inventory_adjustment", None, None, "p3", 9.0, 1.0, None, None), ("s", "place_order", "o2", "c2", "p3", 4.0, 1.0, None, None)]


def test_ten_analytics(spark):
    catalog = spark.createDataFrame([("p1", "fruit"), ("p2", "fruit")], "product_id string, category string")
    got = {k: [tuple(r) for r in v.collect()] for k, v in sessions.answers(spark.createDataFrame(LOG, EVENT), catalog).items()}
    assert sorted(got["Q1"]) == [("p1", 3.0), ("p3", 4.0)] and sorted(got["Q4"]) == [("c1", 30.0), ("c2", 4.0)]
    assert got["Q5"] == [(1, "p1", 15.0), (2, "p3", 4.0)] and got["Q6"] == [(1, "p3", 4.0), (2, "p1", 3.0)] and got["Q7"] == [(19.0,)] and got["Q8"] == [(7.0,)]
    assert sorted(got["Q9"]) == [("Other", 4.0), ("fruit", 15.0)] and sorted(got["Q10"]) == [("c1", 30.0), ("c2", 4.0)]


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(LOG, EVENT).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    run = orders.running_totals(stream).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = orders.running_totals(spark.createDataFrame(LOG, EVENT))
    assert sorted(map(str, spark.table("totals").collect())) == sorted(map(str, want.collect()))
    twice = spark.createDataFrame([("f", 1), ("f", 2), ("g", 3)], "fp string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert orders.first_seen(twice, "fp", "at", "1 hour").schema.names == ["fp", "s", "at"]


def test_random_streaks_match_brute_force(spark):
    draw = random.Random(1)
    rows = [(k, draw.randrange(40)) for k in range(5) for _ in range(25)]
    got = {r["k"]: r["n"] for r in idioms.streaks(spark.createDataFrame(rows, "k int, d int"), ["k"], "d").groupBy("k").agg(F.max("length").alias("n")).collect()}
    for k in range(5):
        days = sorted({d for i, d in rows if i == k})
        best = run = 1
        for a, b in itertools.pairwise(days):
            run = run + 1 if b == a + 1 else 1
            best = max(best, run)
        assert got[k] == best


def test_pressures(spark):
    from scorelake.operators import pressure

    rows = [
        (2, ["batsman"], "entire", False, None, ["select", "where"], 0.5, 3, 1, 1),
        (7, ["batsman", "bowler"], "first_half", True, "before", ["select", "group_by", "having", "order_by", "limit", "case", "aggregate"], None, 4, 7, 30),
        (None, ["table_name"], None, None, "between", ["select", "aggregate", "group_by", "case", "subquery"], 0.2, None, None, None),
    ]
    df = spark.createDataFrame(rows, "s int, v array<string>, b string, t boolean, r string, c array<string>, f double, k int, x int, y int")
    got = pressure.add_pressures(df, "s", "v", "b", "t", "r", "c", "f", "k", "x", "y")
    assert [r["pressure_profile"] for r in got.collect()] == ["G=medium | L=low | E=low | O=low", "G=high | L=high | E=high | O=high", "G=low | L=low | E=medium | O=medium"]
    assert [r[0] for r in df.select(pressure.sql_class(F.col("c"))).collect()] == ["simple retrieval", "ranked conditional grouped comparison", "conditional grouped aggregation with subquery"]
    assert [r[0] for r in df.select(pressure.difficulty_band(F.col("s"))).collect()] == ["easy", "expert", "missing_num_steps"]
