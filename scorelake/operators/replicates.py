"""Resampling and rank tests over tables: every replicate is a row of sufficient statistics.

A row's random number in a replicate comes from a counter-based generator keyed by the row's id and the
replicate, so nothing is shuffled to be drawn and results do not depend on partitions.  Bootstrap weights
are Poisson(1) counts and sign flips are bits; both go into one partial aggregation for all replicates.
Draws without replacement and relabellings take the rows of smallest random numbers, found by a band around
the expected threshold: rows below it are summed, only the band's are ranked.  Ranks come from the histogram
of distinct values.  No group is gathered in a Python worker or on the driver.

Scores are rounded to ``digits`` decimals and summed as whole numbers, which is exact, and the same in any
order, up to 2^53 of these units.  Null and NaN scores are left out.  Replicate 0 is the data themselves.  Ids are integers that tell rows apart (rows of one id share their
draws); keys must be given, and null keys are keys like others.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder

MASK = 0xFFFFFFFF
#: Multipliers of the integer mixer; products of 32-bit numbers with them fit a signed long.
MULTIPLIERS = (0x7FEB352D, 0x2C1B3C6D)
SHIFTS = (16, 15, 16)
#: floor(2^32 P(X <= k)) of a Poisson(1) variable for k = 0, 1, ...: a draw's weight is how many of these it reaches.
POISSON = tuple(math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10))
#: Width of the band, in standard deviations of the number of rows below a threshold, and the rows up to
#: which a group is all band.
SIGMAS, SMALL = 6.0, 4096


def _mix(h: int) -> int:
    for shift, multiplier in zip(SHIFTS, (*MULTIPLIERS, 1), strict=True):
        h = ((h ^ h >> shift) * multiplier) & MASK
    return h


def seeds(n: int, seed: int) -> list[tuple[int, int, int]]:
    """(replicate, two 32-bit numbers) of replicates 0 to n."""
    start = _mix(seed & MASK)
    return [(r, _mix(start ^ _mix(2 * r)), _mix(start ^ _mix(2 * r + 1))) for r in range(n + 1)]


def mixing_steps(xor: Callable[[str, str], str]) -> list[tuple[str, str]]:
    """The generator as successive SQL columns over ``id``, ``s1`` and ``s2``, the last named ``u``: 32 bits."""
    steps = [("h0", xor("(id & 4294967295)", "s1"))]
    for half, then in enumerate((xor(xor("h3", "((id >> 32) & 4294967295)"), "s2"), None)):
        for shift, multiplier in zip(SHIFTS, (*MULTIPLIERS, 1), strict=True):
            last = steps[-1][0]
            steps.append((f"h{len(steps)}", f"(({xor(last, f'({last} >> {shift})')}) * {multiplier}) & 4294967295"))
        if then:
            steps.append((f"h{len(steps)}", then))
    return [*steps[:-1], ("u", steps[-1][1])]


def with_draws(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``df`` once for each replicate 0 to ``n``: ``r`` and the row's random number ``u`` (0 to 2^32 - 1), by its
    bigint column ``id``."""
    made = json.dumps([{"r": r, "s1": a, "s2": b} for r, a, b in seeds(n, seed)])
    out = df.select("*", F.inline(F.from_json(F.lit(made), "array<struct<r:int,s1:bigint,s2:bigint>>")))
    for name, step in mixing_steps(lambda a, b: f"({a} ^ {b})"):
        out = out.selectExpr("*", f"{step} AS {name}")
    # filters on u must stay above the steps, each of which names the one before twice: a filter isn't moved
    # below a column that depends on the row's place
    return out.select(*df.columns, "r", "u", F.monotonically_increasing_id().alias("place")).filter("place >= 0").drop("place")


def _inner(keys: Sequence[str]) -> list[str]:
    """Names of the keys while they are worked with, so that they can't clash with the operators' own."""
    return [f"__key{i}" for i in range(len(keys))]


def _outer(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.withColumnsRenamed(dict(zip(_inner(keys), keys, strict=True)))


def _scores(df: DataFrame, id_col: str, value: Column, keys: Sequence[str], digits: int, more: dict[str, Column] | None = None) -> DataFrame:
    """Keys by their inner names, ``id``, ``x`` (whole units) and more columns of rows that have a score."""
    x = F.round(value.cast("double") * 10**digits)
    named = df.select(*(F.col(k).alias(i) for k, i in zip(keys, _inner(keys), strict=True)), F.col(id_col).cast("bigint").alias("id"), x.alias("x"), *(c.alias(k) for k, c in (more or {}).items()))
    return named.filter("x IS NOT NULL AND NOT isnan(x)")


def _poisson() -> Column:
    u = F.col("u")
    reached = sum((F.when(u >= t, 1).otherwise(0) for t in POISSON), F.lit(0))
    return F.when(F.col("r") == 0, 1).otherwise(reached)


def _interval(replicates: DataFrame, keys: Sequence[str], stat: str, alpha: float, *more: Column) -> DataFrame:
    """Percentile interval of the replicates' statistic and that of the data."""
    drawn = F.when(F.col("r") > 0, F.col(stat))
    ends = [F.percentile(drawn, alpha / 2).alias("ci_low"), F.percentile(drawn, 1 - alpha / 2).alias("ci_high")]
    found = replicates.groupBy(*keys).agg(F.max(F.when(F.col("r") == 0, F.col(stat))).alias(stat), *ends, *more)
    label = F.when(F.col("ci_low").isNull(), "NA").when((F.col("ci_low") > 0) | (F.col("ci_high") < 0), "significant").otherwise("not significant")
    return found.withColumn("significance", label)


def bootstrap_sums(df: DataFrame, id_col: str, value: Column, keys: Sequence[str], n: int = 1000, seed: int = 42, weight: Column | None = None, digits: int = 6) -> DataFrame:
    """``keys``, ``r``, ``rows``, ``weight`` and ``total`` (weighted sum of scores in whole units): replicates' sums.

    They add up over disjoint parts of a table, so stored ones can be merged."""
    return _outer(_bootstrap_sums(df, id_col, value, keys, n, seed, weight, digits), keys)


def _bootstrap_sums(df: DataFrame, id_col: str, value: Column, keys: Sequence[str], n: int, seed: int, weight: Column | None, digits: int) -> DataFrame:
    rows = _scores(df, id_col, value, keys, digits, {"w": F.lit(1.0) if weight is None else weight.cast("double")}).filter("w > 0 AND NOT isnan(w)")
    drawn = with_draws(rows, n, seed).withColumn("w", F.col("w") * _poisson())
    return drawn.groupBy(*_inner(keys), "r").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("total"))


def bootstrap_intervals(df: DataFrame, id_col: str, value: Column, keys: Sequence[str], n: int = 1000, alpha: float = 0.05, seed: int = 42, weight: Column | None = None, strata: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """``keys``, ``rows``, ``mean``, ``ci_low``, ``ci_high`` and ``significance`` of the (weighted) mean.

    With ``strata`` each of these is drawn by itself and keeps its share of the weight in all replicates.  A
    replicate that draws no row counts for nothing."""
    sums = _bootstrap_sums(df, id_col, value, [*keys, *strata], n, seed, weight, digits)
    cells = _inner([*keys, *strata])
    own = cells[: len(keys)]
    mean = F.col("total") / F.nullif(F.col("weight"), F.lit(0.0)) / 10**digits
    if strata:
        share = sums.filter("r = 0").select(*cells, F.col("weight").alias("share"))
        each = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in cells]
        joined = sums.alias("a").join(share.alias("b"), each).select("a.*", "share").withColumn("m", mean)
        held = F.sum(F.when(F.col("m").isNotNull(), F.col("share")))
        replicates = joined.groupBy(*own, "r").agg(F.sum("rows").alias("rows"), (F.sum(F.col("m") * F.col("share")) / held).alias("mean"))
    else:
        replicates = sums.select(*own, "r", "rows", mean.alias("mean"))
    return _outer(_interval(replicates, own, "mean", alpha, F.max("rows").alias("rows")), keys)


def bootstrap_differences(df: DataFrame, id_col: str, value: Column, side: Column, first: object, second: object, keys: Sequence[str], n: int = 1000, alpha: float = 0.05, seed: int = 42, digits: int = 6) -> DataFrame:
    """``keys``, ``n_first``, ``n_second``, ``mean_first``, ``mean_second``, ``delta``, its interval and its significance,
    for two independent sides of a table; keys that lack a side are left out."""
    sided = df.withColumn("__side", F.when(side == first, 0).when(side == second, 1)).filter("__side IS NOT NULL")
    sums = _bootstrap_sums(sided, id_col, value, [*keys, "__side"], n, seed, None, digits)
    *names, at = _inner([*keys, "__side"])
    pick = lambda s, c: F.max(F.when(F.col(at) == s, c))
    mean = F.col("total") / F.nullif(F.col("weight"), F.lit(0.0)) / 10**digits
    both = sums.groupBy(*names, "r").agg(*(pick(s, c).alias(f"{k}_{name}") for s, name in enumerate(("first", "second")) for k, c in (("n", F.col("rows")), ("mean", mean))))
    held = both.filter("n_first > 0 AND n_second > 0").withColumn("delta", F.col("mean_first") - F.col("mean_second"))
    own = lambda c: F.max(F.when(F.col("r") == 0, F.col(c))).alias(c)
    return _outer(_interval(held, names, "delta", alpha, *map(own, ("n_first", "n_second", "mean_first", "mean_second"))), keys)


def _pvalue(replicates: DataFrame, keys: Sequence[str], stat: str, observed: str) -> DataFrame:
    """Share of replicates at least as far from 0 as the data, which count themselves."""
    extreme = F.sum(F.when((F.col("r") > 0) & (F.abs(stat) >= F.abs(observed)), 1).otherwise(0))
    drawn = F.sum(F.when(F.col("r") > 0, 1).otherwise(0))
    return replicates.groupBy(*keys).agg(F.max(observed).alias("observed"), extreme.cast("bigint").alias("extreme"), ((extreme + 1) / (drawn + 1)).alias("pvalue"))


def sign_flip_pvalues(df: DataFrame, id_col: str, delta: Column, keys: Sequence[str], n: int = 1000, seed: int = 42, digits: int = 6) -> DataFrame:
    """``keys``, ``rows``, ``observed`` (mean difference), ``extreme`` and ``pvalue``: random signs of paired differences."""
    rows = _scores(df, id_col, delta, keys, digits)
    sign = F.when((F.col("r") == 0) | (F.col("u") % 2 == 0), F.col("x")).otherwise(-F.col("x"))
    names = _inner(keys)
    sums = with_draws(rows, n, seed).groupBy(*names, "r").agg(F.count(F.lit(1)).alias("rows"), F.sum(sign).alias("total"))
    own = Window.partitionBy(*names)  # one row a replicate
    held = sums.withColumn("data", F.max(F.when(F.col("r") == 0, F.col("total"))).over(own))
    found = _pvalue(held, [*names, "rows"], "total", "data")
    return _outer(found.withColumn("observed", F.col("observed") / F.col("rows") / 10**digits), keys)


def bottom_k_sums(rows: DataFrame, keys: Sequence[str], n: int, seed: int, sigmas: float = SIGMAS, small: int = SMALL) -> DataFrame:
    """``keys``, ``r`` (1 to ``n``), ``k`` and ``total``: the sum of ``x`` over the ``k`` rows of each key with the
    smallest random numbers (then ids and scores).  ``rows`` has ``keys``, ``id``, ``x`` and, equal within a key, ``k`` and ``size``.

    A band around the threshold that is expected for ``k`` of ``size`` rows holds it but for one replicate in
    hundreds of millions; replicates it misses are ranked whole."""
    spark = rows.sparkSession
    p = F.col("k") / F.col("size")
    width = sigmas * F.sqrt(p * (1 - p) / F.col("size"))
    low = F.when((F.col("size") <= small) | (p - width <= 0), 0.0).otherwise((p - width) * 2.0**32)
    high = F.when((F.col("size") <= small) | (p + width >= 1), 2.0**32).otherwise((p + width) * 2.0**32)
    drawn = with_draws(rows.withColumns({"low": low, "high": high}), n, seed).filter("r > 0")
    below, inside = F.col("u") < F.col("low"), (F.col("u") >= F.col("low")) & (F.col("u") <= F.col("high"))
    groups = [*keys, "r"]
    certain = drawn.groupBy(*groups).agg(
        F.max("k").alias("k"), F.sum(F.when(below, 1).otherwise(0)).alias("n_below"), F.sum(F.when(inside, 1).otherwise(0)).alias("n_inside"), F.sum(F.when(below, F.col("x")).otherwise(0.0)).alias("s_below")
    )
    uri = scratch_folder(spark, "bottom-k")
    certain.write.parquet(uri)
    certain = spark.read.schema(certain.schema).parquet(uri).withColumn("missed", F.expr("n_below > k OR n_below + n_inside < k"))
    nth = F.row_number().over(Window.partitionBy(*groups).orderBy("u", "id", "x"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]

    def ranked(some: DataFrame, of: DataFrame, need: Column) -> DataFrame:
        placed = some.select(*groups, "u", "id", "x").withColumn("nth", nth)
        met = placed.alias("a").join(of.select(*groups, need.alias("need")).alias("b"), same).filter("nth <= need")
        return met.groupBy(*(F.col(f"a.{g}").alias(g) for g in groups)).agg(F.sum("x").alias("s"))

    found = ranked(drawn.filter(inside), certain.filter("NOT missed"), F.col("k") - F.col("n_below"))
    total = lambda d, more: d.alias("a").join(more.alias("b"), same, "left").select(*(F.col(f"a.{g}").alias(g) for g in groups), "k", "s_below", "s")
    out = total(certain.filter("NOT missed"), found)
    if not certain.filter("missed").isEmpty():
        missed = certain.filter("missed").withColumn("s_below", F.lit(0.0))
        again = drawn.alias("a").join(missed.select(*groups).alias("b"), same, "left_semi")
        out = out.unionByName(total(missed, ranked(again, missed, F.col("k"))))
    return out.select(*groups, "k", (F.col("s_below") + F.coalesce("s", F.lit(0.0))).alias("total"))


def _sided(df: DataFrame, id_col: str, value: Column, side: Column, first: object, second: object, keys: Sequence[str], digits: int) -> tuple[DataFrame, DataFrame]:
    """Rows of two sides (``side``: 0, 1), and each key's numbers and sums of both."""
    rows = _scores(df, id_col, value, keys, digits, {"side": F.when(side == first, 0).when(side == second, 1)}).filter("side IS NOT NULL")
    of = lambda s, c: F.sum(F.when(F.col("side") == s, c).otherwise(0))
    sizes = rows.groupBy(*_inner(keys)).agg(of(0, 1).alias("n_first"), of(1, 1).alias("n_second"), of(0, F.col("x")).alias("s_first"), of(1, F.col("x")).alias("s_second"))
    return rows, sizes.filter("n_first > 0 AND n_second > 0")


def _with_sizes(rows: DataFrame, sizes: DataFrame, keys: Sequence[str], *columns: Column) -> DataFrame:
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return rows.alias("a").join(sizes.select(*keys, *columns).alias("b"), same)


def permutation_pvalues(df: DataFrame, id_col: str, value: Column, side: Column, first: object, second: object, keys: Sequence[str], n: int = 1000, seed: int = 42, digits: int = 6, sigmas: float = SIGMAS, small: int = SMALL) -> DataFrame:
    """``keys``, ``n_first``, ``n_second``, ``observed`` (difference of means), ``extreme`` and ``pvalue`` of relabelled rows.

    A relabelling gives the first label to the ``n_first`` rows of smallest random numbers."""
    rows, sizes = _sided(df, id_col, value, side, first, second, keys, digits)
    names = _inner(keys)
    asked = _with_sizes(rows, sizes, names, F.col("n_first").alias("k"), (F.col("n_first") + F.col("n_second")).alias("size"))
    drawn = bottom_k_sums(asked.select(*(F.col(f"a.{k}").alias(k) for k in names), "id", "x", "k", "size"), names, n, seed, sigmas, small)
    held = _with_sizes(drawn, sizes, names, *(F.col(c) for c in ("n_first", "n_second", "s_first", "s_second")))
    delta = lambda s: s / F.col("n_first") - (F.col("s_first") + F.col("s_second") - s) / F.col("n_second")
    replicates = held.select(*(F.col(f"a.{k}").alias(k) for k in names), "r", "n_first", "n_second", delta(F.col("total")).alias("delta"), delta(F.col("s_first")).alias("data"))
    found = _pvalue(replicates, [*names, "n_first", "n_second"], "delta", "data")
    return _outer(found.withColumn("observed", F.col("observed") / 10**digits), keys)


def balanced_differences(df: DataFrame, id_col: str, value: Column, side: Column, first: object, second: object, keys: Sequence[str], strata: Sequence[str] = (), n: int = 1000, alpha: float = 0.05, seed: int = 42, digits: int = 6, sigmas: float = SIGMAS, small: int = SMALL) -> DataFrame:
    """``keys``, ``n_strata``, ``n_each``, ``mean_delta``, ``ci_low``, ``ci_high`` and ``sign_agreement`` over subsamples of
    equal sizes of both sides, drawn without replacement within each stratum that has both.

    ``sign_agreement`` is the share of replicates whose difference has the sign of their mean."""
    rows, sizes = _sided(df, id_col, value, side, first, second, [*keys, *strata], digits)
    cells = _inner([*keys, *strata])
    names = cells[: len(keys)]
    k = F.least("n_first", "n_second")
    asked = _with_sizes(rows, sizes, cells, k.alias("k"), F.col("n_first"), F.col("n_second"))
    size = F.when(F.col("side") == 0, F.col("n_first")).otherwise(F.col("n_second"))
    drawn = bottom_k_sums(asked.select(*(F.col(f"a.{c}").alias(c) for c in cells), "side", "id", "x", "k", size.alias("size")), [*cells, "side"], n, seed, sigmas, small)
    signed = F.when(F.col("side") == 0, F.col("total")).otherwise(-F.col("total"))
    each = F.sum(F.when(F.col("side") == 0, F.col("k")))
    replicates = drawn.groupBy(*names, "r").agg((F.sum(signed) / each / 10**digits).alias("delta"), each.alias("n_each"), (F.count(F.lit(1)) / 2).cast("bigint").alias("n_strata"))
    mean = F.avg("delta").over(Window.partitionBy(*names))
    agrees = F.when(F.abs("mean") > 1e-12, F.signum("delta") == F.signum("mean")).otherwise(F.abs("delta") <= 1e-12)
    held = replicates.withColumn("mean", mean).withColumn("agrees", agrees.cast("double"))
    ends = (F.percentile("delta", alpha / 2).alias("ci_low"), F.percentile("delta", 1 - alpha / 2).alias("ci_high"))
    return _outer(held.groupBy(*names, "n_strata", "n_each").agg(F.avg("delta").alias("mean_delta"), *ends, F.avg("agrees").alias("sign_agreement")), keys)


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, counts: dict[str, Column]) -> DataFrame:
    """Histogram of each key's values with ``n``, ``counts`` (rows that meet a condition), ``before`` (rows of smaller
    values) and ``rank2``, twice the mean rank of the value's rows.

    Sorted ranges of the histogram are numbered by their own totals and those of the ranges before them: a key
    with many values spans many tasks."""
    spark = df.sparkSession
    hist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in counts.items()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = hist.repartitionByRange(parts, *keys, value).withColumn("part", F.spark_partition_id())
    uri = scratch_folder(spark, "mid-ranks")
    ranged.write.parquet(uri)
    rows = spark.read.schema(ranged.schema).parquet(uri)
    groups = [*keys, "part"]
    inside = F.sum("n").over(Window.partitionBy(*groups).orderBy(value)) - F.col("n")
    earlier = F.sum("here").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*groups).agg(F.sum("n").alias("here")).select(*groups, F.coalesce(earlier, F.lit(0)).alias("offset"))
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    joined = rows.withColumn("inside", inside).alias("a").join(offsets.alias("b"), same)
    before = F.col("inside") + F.col("offset")
    return joined.select(*(F.col(f"a.{k}").alias(k) for k in (*keys, value, "n", *counts)), before.alias("before"), (2 * before + F.col("n") + 1).alias("rank2"))


#: Terms of the error function's series, which serve up to where its complement is below 1e-16.
TERMS, FAR = 160, 8.3


def two_sided(z: Column) -> Column:
    """P(|Z| >= z) of a standard normal variable; absolute error near 1e-15, so 0 from 8.3 on."""
    x = F.abs(z) / 2**0.5
    term = lambda acc, i: F.struct((acc["t"] * x * x / (i + 0.5)).alias("t"), (acc["s"] + acc["t"] * x * x / (i + 0.5)).alias("s"))
    start = F.struct((x * 2 / 3.141592653589793**0.5).alias("t"), (x * 2 / 3.141592653589793**0.5).alias("s"))
    erf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term, lambda acc: acc["s"]) * F.exp(-x * x)
    return F.when(F.abs(z) > FAR, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - erf)))


def _tests(found: DataFrame, u: Column, middle: Column, spread: Column, shift: float) -> DataFrame:
    z = F.greatest(F.lit(0.0), F.abs(u - middle) - shift) / F.sqrt(F.col("spread"))
    named = found.withColumn("spread", spread)
    return named.withColumn("z", F.when(F.col("spread") > 0, z).otherwise(0.0)).withColumn("pvalue", F.when(F.col("spread") > 0, two_sided(F.col("z"))).otherwise(1.0))


def mann_whitney(df: DataFrame, value: Column, side: Column, first: object, second: object, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``n_first``, ``n_second``, ``u``, ``ties`` (sum of t^3 - t), ``z`` and ``pvalue``: two-sided test with tie and
    continuity corrections; keys that lack a side are left out."""
    names = _inner(keys)
    rows = df.select(*(F.col(k).alias(i) for k, i in zip(keys, names, strict=True)), value.cast("double").alias("x"), F.when(side == first, 0).when(side == second, 1).alias("side")).filter("x IS NOT NULL AND NOT isnan(x) AND side IS NOT NULL")
    ranked = mid_ranks(rows, names, "x", {"n_first": F.col("side") == 0})
    n, a = F.col("n").cast("double"), F.col("n_first")
    found = ranked.groupBy(*names).agg(F.sum(a).alias("n_first"), F.sum(F.col("n") - a).alias("n_second"), (F.sum(a.cast("double") * F.col("rank2")) / 2).alias("ranks"), F.sum(n * n * n - n).alias("ties"))
    a, b = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    held = found.filter("n_first > 0 AND n_second > 0").withColumn("u", F.col("ranks") - a * (a + 1) / 2)
    spread = a * b / 12 * (a + b + 1 - F.col("ties") / ((a + b) * (a + b - 1)))
    return _tests(held, F.col("u"), a * b / 2, spread, 0.5).select(*(F.col(i).alias(k) for k, i in zip(keys, names, strict=True)), "n_first", "n_second", "u", "ties", "z", "pvalue")


def wilcoxon(df: DataFrame, delta: Column, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``n`` (differences other than 0), ``w``, ``ties``, ``z`` and ``pvalue``: two-sided signed-rank test with tie
    correction."""
    names = _inner(keys)
    rows = df.select(*(F.col(k).alias(i) for k, i in zip(keys, names, strict=True)), delta.cast("double").alias("d")).filter("d IS NOT NULL AND NOT isnan(d) AND d <> 0").withColumn("x", F.abs("d"))
    ranked = mid_ranks(rows, names, "x", {"up": F.col("d") > 0})
    t = F.col("n").cast("double")
    sums = {k: (F.sum(c.cast("double") * F.col("rank2")) / 2).alias(k) for k, c in (("plus", F.col("up")), ("minus", F.col("n") - F.col("up")))}
    found = ranked.groupBy(*names).agg(F.sum("n").alias("n"), *sums.values(), F.sum(t * t * t - t).alias("ties")).withColumn("w", F.least("plus", "minus"))
    n = F.col("n").cast("double")
    return _tests(found, F.col("w"), n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48, 0.0).select(*(F.col(i).alias(k) for k, i in zip(keys, names, strict=True)), "n", "w", "ties", "z", "pvalue")
