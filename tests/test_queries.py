"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest
from scorelake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


def plain(frame, columns):
    text = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_columns(spark):
    plan = catalog.queries()["filter_eq_count"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan and "ReadSchema: struct<l_returnflag:string>" in plan
    for name in ("argmax_ties", "join_interval", "corr_count_window", "exists_within_k"):
        assert "CartesianProduct" not in catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_placeholders_of_all_documents(spark):
    ids = {r["doc_id"] for r in catalog.queries()["template_placeholders"](spark, SF).collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()} and max(ids) >= 50


def test_casts_of_all_lineitems(spark):
    assert catalog.queries()["cast_rounds_half_even"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
