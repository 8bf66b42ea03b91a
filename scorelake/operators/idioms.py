"""Relational idioms of question templates over event tables, as DataFrame operations.

Every ordered operation takes a full order, so results don't depend on ties.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import with_row_ids


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def extreme_with_ties(df: DataFrame, value: str, largest: bool = True) -> DataFrame:
    """Rows whose ``value`` is the largest (or smallest); ties stay, nulls never win.  The extreme is one
    row, broadcast back, so nothing is sorted or shuffled."""
    best = df.agg((F.max if largest else F.min)(value).alias("__best"))
    return df.join(F.broadcast(best), F.col(value) == F.col("__best")).drop("__best")


def conditional_sums(df: DataFrame, keys: Sequence[str], level: str, levels: Sequence[str], value: str | None = None) -> DataFrame:
    """One column for each level: the count of its rows, or the sum of ``value`` over them."""
    held = F.lit(1) if value is None else F.col(value)
    return df.groupBy(*keys).agg(*(F.sum(F.when(F.col(level) == x, held).otherwise(0)).alias(x) for x in levels))


def rate(part: Column, whole: Column, digits: int = 2, scale: float = 1.0) -> Column:
    """Rounded double ratio; null where the denominator is zero or null."""
    return F.round(F.lit(scale) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def moving(value: Column, keys: Sequence[str], order: Sequence[Column], rows: int | None, how=F.avg) -> Column:
    """``how`` over the current row and ``rows - 1`` before it (all before it if None)."""
    first = Window.unboundedPreceding if rows is None else 1 - rows
    return how(value).over(Window.partitionBy(*_cols(keys)).orderBy(*order).rowsBetween(first, 0))


def streaks(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Runs of consecutive integers ``position`` within ``keys``: ``first``, ``last``, ``length``."""
    nth = F.row_number().over(Window.partitionBy(*_cols(keys)).orderBy(position))
    runs = df.select(*keys, position).distinct().withColumn("__run", F.col(position) - nth)
    return runs.groupBy(*keys, "__run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")


def next_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: dict[str, str], ahead: int = 1) -> DataFrame:
    """Columns of the row ``ahead`` places on within ``keys``; ``columns`` maps source to new name."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumns({new: F.lead(old, ahead).over(w) for old, new in columns.items()})


def interval_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, width: int) -> DataFrame:
    """Pairs of equal ``keys`` with ``left_at < right_at <= left_at + width``.

    Both sides are cut into bins of ``width``; a left row goes to its own and the next bin, so the join
    is on equality and a frequent key is spread over its bins.
    """
    bins = F.explode(F.array(F.floor(F.col(left_at) / width), F.floor(F.col(left_at) / width) + 1))
    a = left.withColumn("__bin", bins)
    b = right.withColumn("__bin", F.floor(F.col(right_at) / width))
    return a.join(b, [*keys, "__bin"]).filter((F.col(right_at) > F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + width)).drop("__bin")


def count_ahead(df: DataFrame, keys: Sequence[str], at: str, width: int, counted: Column) -> Column:
    """Rows that meet ``counted`` with ``at`` in [own, own + width], by one range window."""
    w = Window.partitionBy(*_cols(keys)).orderBy(at).rangeBetween(0, width)
    return F.sum(F.when(counted, 1).otherwise(0)).over(w)


def any_within_rows(condition: Column, keys: Sequence[str], order: Sequence[Column], rows: int) -> Column:
    """Whether any of the next ``rows`` rows meets ``condition`` (false past the end)."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order).rowsBetween(1, rows)
    return F.coalesce(F.max(F.when(condition, True).otherwise(False)).over(w), F.lit(False))


def rows_until(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, goal: float) -> DataFrame:
    """For each key the number of ordered rows after which the running total is ``goal`` or more."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    ranked = df.withColumn("__n", F.row_number().over(w)).withColumn("__total", moving(F.col(value), keys, order, None, F.sum))
    return ranked.filter(F.col("__total") >= goal).groupBy(*keys).agg(F.min("__n").cast("bigint").alias("rows_needed"))


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in order."""
    w = Window.partitionBy(*_cols(keys)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def cast_integer(value: Column, kind: str = "bigint") -> Column:
    """Cast of a double that rounds half to even, where a plain cast would cut."""
    return F.rint(value).cast(kind)


def entity_spans(df: DataFrame, entity: str, at: str) -> DataFrame:
    """First and last place and number of rows of each entity."""
    return df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))


def span_buckets(spans: DataFrame, low: float, high: float, least_rows: int = 1, coverage: float = 0.8) -> DataFrame:
    """Spans with ``buckets``: which parts of [low, high] an entity's rows lie in.

    first_half and second_half: wholly on that side of the middle; middle: wholly in the middle third;
    almost_entire: the span covers ``coverage`` of the range or more.  Buckets may overlap.
    """
    width, centre = high - low, (low + high) / 2
    inside = {
        "first_half": F.col("last") <= centre,
        "second_half": F.col("first") >= centre,
        "middle": (F.col("first") >= low + width / 3) & (F.col("last") <= high - width / 3),
        "almost_entire": (F.col("last") - F.col("first")) >= coverage * width,
    }
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in inside.items())))
    return spans.filter(F.col("rows") >= least_rows).withColumn("buckets", named)


def frequency_tiers(df: DataFrame, entity: str) -> DataFrame:
    """Entities by falling frequency (ties by name) with ``place`` and ``tier``: top half, bottom half
    (of whole halves) or middle.

    Places are those of a range-sorted table, so that neither all entities nor those of one frequency, usually
    most of them, meet in a task.
    """
    counts = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(F.count(F.lit(1)).alias("rows"))
    placed = with_row_ids(counts, [F.desc("rows"), entity], "__place")
    total = placed.agg(F.count(F.lit(1)).alias("__all"))  # one row
    half = F.greatest(F.lit(1), F.floor(F.col("__all") / 2))
    tier = F.when(F.col("place") <= half, "top").when(F.col("place") > F.col("__all") - half, "bottom").otherwise("middle")
    return placed.withColumn("place", (F.col("__place") + 1).cast("bigint")).join(F.broadcast(total)).select(entity, "rows", "place", tier.alias("tier"))


def compress_ranges(df: DataFrame, keys: Sequence[str], number: str, alias: str = "ranges") -> DataFrame:
    """Distinct integers of each key as text such as ``1-3, 7``."""
    runs = streaks(df.filter(F.col(number).isNotNull()), keys, number)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    parts = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("first"), text.alias("t")))).alias("p"))
    return parts.select(*keys, F.array_join(F.col("p.t"), ", ").alias(alias))


def concat_ordered(df: DataFrame, keys: Sequence[str], order: str, text: Column, separator: str = "\n", most_chars: int | None = None, alias: str = "context") -> DataFrame:
    """Texts of each key joined in order; longer results are cut to ``most_chars`` and marked `` ...``.

    Null texts are left out, a null place comes last, and a key without texts has null.  With a limit only texts up to
    the one that passes it are gathered, so a key's row is bounded."""
    rows = df.select(*keys, F.isnull(order).alias("__last"), F.col(order).alias("__o"), text.alias("__t"))
    if most_chars is not None:
        before = F.sum(F.length("__t") + len(separator)).over(Window.partitionBy(*_cols(keys)).orderBy("__last", "__o", "__t").rowsBetween(Window.unboundedPreceding, -1))
        reached = F.coalesce(before, F.lit(0)) > most_chars + len(separator)  # what is before, without its last separator, is too long already
        rows = rows.withColumn("__t", F.when(~reached, F.substring("__t", 1, most_chars + 1)))
    part = F.when(F.col("__t").isNotNull(), F.struct(F.col("__last").alias("last"), F.col("__o").alias("o"), F.col("__t").alias("t")))
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("p"))
    joined = F.array_join(F.col("p.t"), separator)
    if most_chars is not None:
        joined = F.when(F.length(joined) > most_chars, F.concat(F.substring(joined, 1, most_chars), F.lit(" ..."))).otherwise(joined)
    return parts.select(*keys, F.when(F.size("p") > 0, joined).alias(alias))


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, columns: dict[str, str]) -> DataFrame:
    """``left`` with columns of the last ``right`` row of its keys at or before its time; null if there is none.

    ``columns`` maps right columns to new names; right rows that tie in time go by these columns, last wins.
    One window over both sides, so that no pair is made; rows of a key share a task."""
    taken = F.struct(*(F.col(c).alias(n) for c, n in columns.items()))
    a = left.withColumns({"__at": F.col(left_at), "__side": F.lit(1), "__taken": F.lit(None).cast(right.select(taken.alias("x")).schema["x"].dataType)})
    b = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), taken.alias("__taken"))
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy(*_cols(keys)).orderBy("__at", "__side", "__taken").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__last", F.last("__taken", ignorenulls=True).over(before)).filter("__side = 1")
    return met.select(*left.columns, *(F.col(f"__last.{n}").alias(n) for n in columns.values()))


def qualify(df: DataFrame, value: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """Rows whose window value meets a condition: QUALIFY, which the parser lacks, as a derived column."""
    return df.withColumn("__q", value).filter(condition(F.col("__q"))).drop("__q")
