"""Attempts from run logs: read, regroup and pick winners.

An attempt row names its sample, perhaps its part (a vote, a row, a stage or a step), its number and
whether its table is valid; other columns ride along.  Winners are found by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .vote import pick_attempt


def read_attempts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Logs below ``folder`` with ``attempt`` and ``file``.

    A folder of files has one JSON document each, and an attempt's number is the last one in its file's name; a
    folder of subfolders ``attempt=N`` has JSON lines.  Filters on ``attempt`` or ``file`` leave out files before they are
    read."""
    nested = spark.read.schema(schema).json(folder)
    if "attempt" in nested.columns:
        return nested.select("*", F.col("_metadata.file_name").alias("file"))
    logs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return logs.select("*", name.alias("file"), F.when(number != "", number.cast("int")).alias("attempt"))


def winners(attempts: DataFrame, keys: Sequence[str], last: bool = True, valid: str = "valid", attempt: str = "attempt") -> DataFrame:
    """The last (or first) valid attempt of each key."""
    return pick_attempt(attempts, list(keys), attempt, F.col(valid), last)


def stitched(attempts: DataFrame, sample: str, row: str, cell: Column, rows: int | None = None) -> DataFrame:
    """Rows answered one by one, each by its last valid attempt, put together in order: ``cells``; with
    ``rows``, only samples that have so many."""
    best = winners(attempts, [sample, row])
    whole = best.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("at"), cell.alias("cell")))).alias("parts"))
    whole = whole if rows is None else whole.filter(F.size("parts") == rows)
    return whole.select(sample, F.col("parts.cell").alias("cells"))


def voted(attempts: DataFrame, sample: str, vote: str, answer: str) -> DataFrame:
    """The most frequent answer among the votes' first valid attempts; the earliest vote breaks ties."""
    from .vote import plurality

    return plurality(winners(attempts, [sample, vote], last=False), [sample], answer, vote)


def staged(attempts: DataFrame, sample: str, stage: str, stages: Sequence[str], columns: Sequence[str], last: bool = True) -> DataFrame:
    """One row for each sample that has a winner in every stage: its columns, named by stage."""
    best = winners(attempts.filter(F.col(stage).isin(*stages)), [sample, stage], last)
    taken = [F.max(F.when(F.col(stage) == s, F.struct(*columns))).alias(s) for s in stages]
    whole = best.groupBy(sample).agg(F.count(F.lit(1)).alias("__n"), *taken).filter(F.col("__n") == len(stages))
    return whole.select(sample, *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in stages for c in columns))


def unbroken_steps(attempts: DataFrame, sample: str, step: str, first: int = 0) -> DataFrame:
    """First valid attempts of the steps that follow each other from ``first``: a step counts only if all
    before it have one."""
    best = winners(attempts, [sample, step], last=False)
    reach = best.groupBy(sample).agg(F.sort_array(F.collect_set(step)).alias("steps"))
    count = F.aggregate("steps", F.lit(first), lambda a, s: F.when(s == a, (a + 1).cast("int")).otherwise(a))
    reach = reach.select(sample, count.alias("__end"))
    return best.join(reach, sample).filter((F.col(step) >= first) & (F.col(step) < F.col("__end"))).drop("__end")


def usage(attempts: DataFrame, sample: str, tokens: Sequence[str]) -> DataFrame:
    """Token sums of each sample over all its attempts, and whether any was valid."""
    return attempts.groupBy(sample).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in tokens), F.coalesce(F.bool_or("valid"), F.lit(False)).alias("success"))


def usage_of_successes(sums: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Mean sums over the samples that succeeded: one row, zeros without any."""
    return sums.agg(*(F.coalesce(F.avg(F.when(F.col("success"), F.col(c))), F.lit(0.0)).alias(c) for c in tokens))


def consumed(requests: DataFrame, outputs: DataFrame, key: str = "custom_id", order: str = "attempt") -> DataFrame:
    """Requests with their latest output; those without any have nulls."""
    best = outputs.groupBy(key).agg(F.max(F.struct(order, *(c for c in outputs.columns if c not in (key, order)))).alias("__best"))
    return requests.join(best, key, "left").select(*requests.columns, "__best.*")


def chosen(results: DataFrame, attempts: str = "attempts", choice: str = "chosen_attempt", number: str = "attempt", by_place: bool = False) -> DataFrame:
    """``results`` with ``chosen``, the attempt that ``choice`` names: by its own number, or by its place in the list
    as older files are read."""
    place = F.try_element_at(F.col(attempts), (F.col(choice) + 1).cast("int"))
    named = F.try_element_at(F.filter(F.col(attempts), lambda a: a[number] == F.col(choice)), F.lit(1))
    return results.withColumn("chosen", F.when(F.col(choice).isNotNull(), place if by_place else named))
