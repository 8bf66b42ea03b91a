"""Registry of the queries over the driver tables and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """A table as a stream of its files; the pattern lets a table be one file or a folder of them."""
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(f"{self._dir}/{name}.parque[t]")


def query(sql: str | None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register a function of the tables under its name, with its SQL if it has any."""

    def register(function: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(Tables(spark, sf_dir))

        run.__doc__ = function.__doc__
        _QUERIES[function.__name__] = run
        if sql is not None:
            _SQL[function.__name__] = sql
        return run

    return register


def queries() -> dict[str, Query]:
    from . import columns, coverage, evaluation, predictions, relational, resampling, shapes  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
