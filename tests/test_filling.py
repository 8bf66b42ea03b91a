"""Statements and prose filled by column expressions, against the plain functions."""

from pyspark.sql import functions as F
from scorelake.functions import cells, repair, text
from scorelake.operators import vote

TEMPLATES = [
    "SELECT '{s}' FROM {table_name} WHERE a = {s} AND b = {i} AND c = \"{s}\"", "{s}{s}'{i}'", "x'{s}' '{s}\" {nope} '{nope}' {", "", "no hole", "it''s '{b}' {b} {n} '{n}' {d}",
    "{temporal_predicate} '{temporal_predicate}' é{f} '{f}' {s", "{ s } {{s}} '{{s}}' {été}",
]
ROWS = [("a", 1, True, 1.5, "(x < 1)", "é"), ("it's \"q\" {i} $1 \\1", -7, False, 0.25, " (y)", "{s}"), ("", 0, None, None, "z(", "")]


def test_filling_equals_the_plain_functions(spark):
    df = spark.createDataFrame([(t, *r) for t in TEMPLATES for r in ROWS], "template string, s string, i int, b boolean, d double, f string, e string")
    values = {"s": F.col("s"), "i": F.col("i"), "b": F.col("b"), "d": F.col("d"), "f": F.col("f"), "été": F.col("e"), "n": F.lit(None).cast("string"), "table_name": F.lit("df"), "temporal_predicate": F.col("f")}
    for r in df.select("*", text.instantiated(F.col("template"), values).alias("sql"), text.filled(F.col("template"), values).alias("prose")).collect():
        given = {"s": r.s, "i": r.i, "b": r.b, "d": r.d, "f": r.f, "été": r.e, "n": None, "table_name": "df", "temporal_predicate": r.f}
        assert r.sql == text.instantiate(r.template, given), r
        assert r.prose == text.fill(r.template, given), r
    assert spark.range(1).select(text.instantiated(F.lit(None).cast("string"), values={"a": F.lit(1)}).alias("x")).first()["x"] is None


def test_canonical_cells(spark):
    shown = [" 1.500 ", "-0", "0.0", "1e3", "NaN", "-inf", "x y ", "", None, "007", "12345678901234567890.10", "+5", "1.", ".5"]
    got = [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(shown)], "i int, v string").orderBy("i").select(cells.canonical(F.col("v")).alias("x")).collect()]
    assert got == [vote.canonical_cell(v) for v in shown]


def test_repair_of_more_parameters_repeats_no_work(spark):
    df = spark.createDataFrame([("Did Root hit 'team'?", ["And <team>?", "x"], "Root", "7"), ("Which over?", ["over {over}"], None, ""), (None, None, "a", "b"), ("7 runs ", None, "x", "7")], "q string, p array<string>, bowler string, runs string")

    def made(*names):
        values = {n: F.col(n) if n in df.columns else F.lit(None).cast("string") for n in names}
        question, others = repair.repaired(F.col("q"), F.col("p"), values)
        return df.select(question.alias("question"), others.alias("others"))

    names = ("bowler", "team", "runs", "over", "venue")
    assert [tuple(r) for r in made(*names).collect()] == [
        ("Did {bowler} hit {team}? Parameters: {runs}, {over}, {venue}.", ["And {team}?", "x"]),
        ("Which over '{over}'? Parameters: {bowler}, {team}, {runs}, {venue}.", ["over {over}"]),
        (None, []),
        ("{runs} runs Parameters: {bowler}, {team}, {over}, {venue}.", []),
    ]
    two, four = (made(*names[:n])._jdf.queryExecution().analyzed().toString().count("regexp_replace") for n in (2, 4))
    assert two <= 40 and four <= 2 * two
