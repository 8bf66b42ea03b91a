"""Schedules that cover templates and sources, their entities, and columns with numbers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from scorelake.operators import schedule, strata, tables


def turns_of(spark, templates, sources, **settings):
    t = spark.createDataFrame([(f"t{i:03}",) for i in range(templates)], "template string")
    s = spark.createDataFrame([(f"s{i:03}",) for i in range(sources)], "source string")
    return schedule.coverage(t, s, "template", "source", **settings)


@pytest.mark.parametrize("templates,sources,uses,source_uses", [(5, 3, 2, 1), (3, 7, 2, 1), (2, 5, 3, 4), (1, 1, 3, 1), (4, 3, 5, 9)])
def test_covers_all(spark, templates, sources, uses, source_uses):
    made = turns_of(spark, templates, sources, uses=uses, source_uses=source_uses, seed=3).collect()
    forced = [(f"t{i:03}", f"s{(i + u) % sources:03}") for i in range(templates) for u in range(uses)]
    assert sorted((r.template, r.source) for r in made if r.forced) == sorted(forced)
    plain = Counter(s for _, s in forced)
    short = {f"s{i:03}": max(0, source_uses - plain[f"s{i:03}"]) for i in range(sources)}
    assert Counter(r.source for r in made if not r.forced) == Counter({s: n for s, n in short.items() if n})
    assert sorted(r.turn for r in made) == list(range(len(made))) and len({(r.source, r.slot) for r in made}) == len(made)


def test_seed_and_partitions(spark):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(turns_of(spark, 4, 9, seed=1)) == rows(turns_of(spark.newSession(), 4, 9, seed=1)) != rows(turns_of(spark, 4, 9, seed=2))
    t = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "template string").repartition(3)
    assert {r.template for r in schedule.coverage(t, spark.createDataFrame([("s",)], "source string"), "template", "source").collect()} == {"a", "b"}


@pytest.mark.parametrize("templates,sources", [(0, 3), (3, 0), (0, 0)])
def test_nothing_to_schedule(spark, templates, sources):
    made = turns_of(spark, templates, sources)
    assert made.count() == 0 and made.columns == ["turn", "template", "source", "slot", "forced"]


def test_entities(spark):
    events = spark.createDataFrame([("s", e) for e, n in (("a", 9), ("b", 5), ("c", 5), ("d", 1), (None, 3)) for _ in range(n)] + [("one", "x")], "source string, entity string")
    plan = spark.createDataFrame([(s, i) for s in ("s", "one", "none") for i in range(10)], "source string, slot bigint")
    made = {(r.source, r.slot): r.entity for r in schedule.with_entity(plan, events, "source", "entity").collect()}
    assert [made["s", i] for i in range(10)] == ["d", "a", "c", "b", "a", "d", "b", "c", "a", "b"]
    assert {made["one", i] for i in range(10)} == {"x"} and {made["none", i] for i in range(10)} == {None} and len(made) == 30


def test_numeric_columns(spark):
    table = lambda columns, rows: spark.createDataFrame([((columns, rows),)], f"t {tables.TABLE}").select(tables.numeric_columns(F.col("t"), 2).alias("c")).first()["c"]
    assert table(["a", "b", "c", "d"], [["x", " 1.5 ", None, "nan"], ["y"], ["3", "z", "4", "5"]]) == ["b"]
    assert table(["a", "a"], [["1", "x"]]) == [] and table(["a", "a"], [["x", "1"]]) == ["a"] and table([], []) == []


def test_coverage_of_models(spark):
    rows = [("a", 1, True, 1.0), ("a", 1, False, None), ("a", 2, None, 2.0), ("b", 1, True, None), ("b", 2, True, 0.0), ("c", 3, True, 1.0), ("b", None, True, 1.0)]
    df = spark.createDataFrame(rows, "model string, id int, parsed boolean, score double")
    has = {"parsed_n": "parsed", "scored": "score IS NOT NULL"}
    assert {tuple(r) for r in strata.coverage(df, "model", has).collect()} == {("a", 3, 1, 2, 2, 1), ("b", 3, 3, 0, 2, 1), ("c", 1, 1, 0, 1, 0)}
    assert {tuple(r) for r in strata.paired_coverage(df, "id", "model", ["a", "b"], has).collect()} == {("samples", 3), ("parsed_n", 1), ("scored", 1)}
