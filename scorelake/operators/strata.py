"""Metrics of predicted against gold tables, and stratified summaries of scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pk_metrics(gold: DataFrame, pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set recall, precision and F1 over key tuples: one row.  An empty gold set has recall 1."""
    sides = gold.select(*keys).distinct().withColumn("g", F.lit(1)).unionByName(pred.select(*keys).distinct().withColumn("p", F.lit(1)), allowMissingColumns=True)
    met = sides.groupBy(*keys).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = met.agg(F.count("g").alias("gold_n"), F.count("p").alias("pred_n"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("both_n"))
    recall = F.when(F.col("gold_n") == 0, 1.0).otherwise(F.col("both_n") / F.nullif("gold_n", F.lit(0)))
    precision = F.when(F.col("pred_n") > 0, F.col("both_n") / F.nullif("pred_n", F.lit(0))).when(F.col("gold_n") == 0, 1.0).otherwise(0.0)
    scored = n.withColumn("pk_recall", recall).withColumn("pk_precision", precision)
    total = F.col("pk_recall") + F.col("pk_precision")
    f1 = F.when(total > 0, 2 * F.col("pk_recall") * F.col("pk_precision") / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    return scored.withColumn("pk_f1", f1).withColumn("pk_exact_set_match", (F.col("gold_n") == F.col("both_n")) & (F.col("pred_n") == F.col("both_n")))


def aligned(gold: DataFrame, pred: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of equal keys with ``g_`` and ``p_`` columns."""
    g = gold.select(*keys, *(F.col(c).alias(f"g_{c}") for c in columns))
    p = pred.select(*keys, *(F.col(c).alias(f"p_{c}") for c in columns))
    return g.join(p, list(keys))


def numeric_metrics(gold: DataFrame, pred: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a column: n, mae, rmse, bias, and how often the prediction is over or under."""
    errors = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), (F.col(f"p_{c}").cast("double") - F.col(f"g_{c}").cast("double")).alias("e")) for c in columns)))
    e = aligned(gold, pred, keys, columns).select(errors.alias("x")).select("x.metric", "x.e").filter("e IS NOT NULL")
    return e.groupBy("metric").agg(F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg("e").alias("bias"), F.count_if(F.col("e") > 0).alias("over_n"), F.count_if(F.col("e") < 0).alias("under_n"))


def macro(metrics: DataFrame) -> DataFrame:
    """Means of mae and rmse over columns, weighted by n."""
    return metrics.agg((F.sum(F.col("mae") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weighted_mae"), (F.sum(F.col("rmse") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weighted_rmse"), F.sum("n").alias("pairs"))


def cell_accuracy(gold: DataFrame, pred: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.2) -> DataFrame:
    """Cells within ``tolerance`` (both null counts) among the cells of aligned rows."""
    right = [F.when(F.col(f"g_{c}").isNull() | F.col(f"p_{c}").isNull(), F.col(f"g_{c}").isNull() & F.col(f"p_{c}").isNull()).otherwise(F.abs(F.col(f"p_{c}") - F.col(f"g_{c}")) <= tolerance) for c in columns]
    hits = sum((x.cast("bigint") for x in right), F.lit(0).cast("bigint"))
    sums = aligned(gold, pred, keys, columns).agg(F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("correct_cells"), (F.count(F.lit(1)) * len(columns)).alias("total_cells"))
    return sums.withColumn("cell_acc", 100.0 * F.col("correct_cells") / F.nullif("total_cells", F.lit(0)))


def zero_null_confusion(gold: DataFrame, pred: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.2) -> DataFrame:
    """Confusion counts of "null or about zero" over the cells of aligned rows."""
    pairs = F.explode(F.array(*(F.struct(*(F.coalesce(F.abs(F.col(f"{s}_{c}")) <= tolerance, F.lit(True)).alias(s) for s in "gp")) for c in columns)))
    z = aligned(gold, pred, keys, columns).select(pairs.alias("x")).select("x.g", "x.p")
    g, p = F.col("g"), F.col("p")
    return z.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))


def smape(a: Column, b: Column) -> Column:
    """Aggregate: mean of |a - b| over the mean magnitude, in percent; 0 where both are 0."""
    size = (F.abs(a) + F.abs(b)) / 2
    return F.avg(F.when(size == 0, 0.0).otherwise(F.abs(a - b) / F.nullif(size, F.lit(0.0)) * 100))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg((a - b) * (a - b)))


def accuracy(a: Column, b: Column) -> Column:
    """Aggregate: share of equal pairs."""
    return F.avg(a.eqNullSafe(b).cast("double"))


def factor_summary(df: DataFrame, factor: str, metric: str) -> DataFrame:
    """n, mean, median and sample deviation by factor; a null factor is a group."""
    return df.groupBy(factor).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.median(metric).alias("median"), F.stddev_samp(metric).alias("std"))


def controlled_pivot(df: DataFrame, factor: str, controls: Sequence[str], metric: str, levels: Sequence[object]) -> DataFrame:
    """Mean of the metric by controls, one column a factor level."""
    return df.groupBy(*controls).agg(*(F.avg(F.when(F.col(factor) == x, F.col(metric))).alias(str(x)) for x in levels))


def matched_deltas(df: DataFrame, factor: str, a: object, b: object, controls: Sequence[str], metric: str) -> DataFrame:
    """Strata that have both levels, with ``delta`` (b minus a) and ``weight`` (the smaller count)."""
    by = df.filter(F.col(metric).isNotNull()).groupBy(*controls).agg(
        *(F.avg(F.when(F.col(factor) == x, F.col(metric))).alias(f"m_{s}") for s, x in (("a", a), ("b", b))),
        *(F.count_if(F.col(factor) == x).alias(f"n_{s}") for s, x in (("a", a), ("b", b))),
    )
    return by.filter("n_a > 0 AND n_b > 0").select(*controls, "m_a", "m_b", (F.col("m_b") - F.col("m_a")).alias("delta"), F.least("n_a", "n_b").alias("weight"))


def weighted_delta(deltas: DataFrame) -> DataFrame:
    return deltas.agg((F.sum(F.col("delta") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0))).alias("weighted_delta"), F.count(F.lit(1)).alias("strata"))


def stacked_means(df: DataFrame, factors: Sequence[str], metric: str) -> DataFrame:
    """Means by each factor in turn, in one pass: ``factor``, ``level``, ``mean``, ``n``."""
    level = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors)))
    return df.select(level.alias("x"), metric).groupBy("x.factor", "x.level").agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n"))


def bucket(value: Column, bins: Sequence[tuple[float, str]], beyond: str, missing: str = "missing") -> Column:
    """Name of the first bin whose upper bound holds the value."""
    out = F.when(value.isNull(), missing)
    for bound, name in bins:
        out = out.when(value <= bound, name)
    return out.otherwise(beyond)


def flag_labels(labels: Mapping[str, Column]) -> Column:
    """Sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in labels.items()))))


def profile(pressures: Mapping[str, str]) -> Column:
    """Text such as ``G=low | L=high`` of the given columns."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{k}="), F.coalesce(F.col(c), F.lit("other"))) for k, c in pressures.items()))


def totals(counters: DataFrame, by: str | Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Counters summed by setting (or several, from the widest) and over all (``by`` null)."""
    return counters.rollup(*([by] if isinstance(by, str) else by)).agg(*(F.sum(c).alias(c) for c in sums))


def guarded_ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of the largest order value of each key: last entry wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def summary(scored: DataFrame) -> DataFrame:
    """Micro and macro means of aligned-table scores (``align.score_tables``): one row."""
    ratio = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("records"), F.count_if("exact_match").alias("exact_matches"), F.count_if("row_match").alias("row_matches"), F.count_if("col_match").alias("col_matches"),
        ratio("pairs", "gold_rows").alias("micro_recall"), ratio("pairs", "pred_rows").alias("micro_precision"), F.avg("pk_recall").alias("macro_recall"), F.avg("pk_precision").alias("macro_precision"),
        (100 * ratio("correct_cells", "total_cells")).alias("micro_cell_acc"), F.avg("cell_acc").alias("macro_cell_acc"), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")),
    )


def question_scores(gold: DataFrame, pred: DataFrame, question: str, keys: Sequence[str], value: str, tolerance: float = 0.4) -> DataFrame:
    """Each question's accuracy (gold rows whose predicted value is within ``tolerance``), the share of its
    predicted rows that are gold ones, and the error over the rows that both have."""
    both = [question, *keys]
    g = gold.select(*both, F.col(value).cast("double").alias("__g")).withColumn("__gold", F.lit(True))
    p = pred.select(*both, F.col(value).cast("double").alias("__p")).withColumn("__pred", F.lit(True))
    met = g.join(p, both, "full_outer")
    near = F.coalesce(F.abs(F.col("__p") - F.col("__g")) <= tolerance, F.lit(False))
    e = F.col("__p") - F.col("__g")
    return met.groupBy(question).agg(
        F.count("__gold").alias("gold_rows"), (F.count_if(near) / F.nullif(F.count("__gold"), F.lit(0))).alias("accuracy"),
        (F.count_if(F.col("__gold").isNotNull() & F.col("__pred").isNotNull()) / F.nullif(F.count("__pred"), F.lit(0))).alias("precision_at_k"), F.sqrt(F.avg(e * e)).alias("rmse"),
    )


def model_suite(df: DataFrame, factors: Sequence[str], metric: str, model: str, a: object, b: object) -> DataFrame:
    """Both models' means by each factor's levels, and their difference (b minus a): ``factor``, ``level``, ``n_a``,
    ``n_b``, ``mean_a``, ``mean_b``, ``delta``.  One pass for all factors."""
    level = F.explode(F.array(*(F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors)))
    of = lambda m: F.when(F.col(model) == m, F.col(metric))
    made = df.select(level.alias("x"), model, metric).groupBy("x.factor", "x.level").agg(F.count(of(a)).alias("n_a"), F.count(of(b)).alias("n_b"), F.avg(of(a)).alias("mean_a"), F.avg(of(b)).alias("mean_b"))
    return made.withColumn("delta", F.col("mean_b") - F.col("mean_a"))


def paired_deltas(df: DataFrame, key: str, factor: str, metric: str, model: str, a: object, b: object) -> DataFrame:
    """Mean difference (b minus a) over the keys that both models have a value for, by factor level."""
    of = lambda m: F.avg(F.when(F.col(model) == m, F.col(metric)))
    paired = df.groupBy(key, factor).agg(of(a).alias("__a"), of(b).alias("__b")).filter("__a IS NOT NULL AND __b IS NOT NULL")
    return paired.groupBy(factor).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("__b") - F.col("__a")).alias("delta"), F.count_if(F.col("__b") > F.col("__a")).alias("wins"), F.count_if(F.col("__b") < F.col("__a")).alias("losses"))


def paired_keys(df: DataFrame, key: str, metric: str, model: str, models: Sequence[object], true_only: bool = False) -> DataFrame:
    """Keys for which every model has a value (or, with ``true_only``, has true)."""
    has = lambda m: F.bool_or((F.col(model) == m) & (F.coalesce(F.col(metric).cast("boolean"), F.lit(False)) if true_only else F.col(metric).isNotNull()))
    return df.groupBy(key).agg(*(has(m).alias(f"__{i}") for i, m in enumerate(models))).filter(" AND ".join(f"__{i}" for i in range(len(models)))).select(key)


def coverage(df: DataFrame, model: str, has: Mapping[str, str]) -> DataFrame:
    """Samples of each model, and those for which each condition of ``has`` (name to SQL) holds and doesn't (``no_``)."""
    holds = lambda c: F.coalesce(F.expr(c), F.lit(False))
    counts = [x for name, c in has.items() for x in (F.count_if(holds(c)).alias(name), F.count_if(~holds(c)).alias(f"no_{name}"))]
    return df.groupBy(model).agg(F.count(F.lit(1)).alias("samples"), *counts)


def paired_coverage(df: DataFrame, key: str, model: str, models: Sequence[object], has: Mapping[str, str]) -> DataFrame:
    """``subset`` and ``n``: all samples (``samples``), and for each condition those for which it holds with every model.
    One aggregation by sample serves all conditions."""
    holds = lambda m, c: F.coalesce(F.bool_or((F.col(model) == F.lit(m)) & F.coalesce(F.expr(c), F.lit(False))), F.lit(False))
    every = [reduce(lambda a, b: a & b, [holds(m, c) for m in models]).alias(name) for name, c in has.items()]
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*every).agg(F.count(F.lit(1)).alias("samples"), *(F.count_if(F.col(name)).alias(name) for name in has))
    return sums.unpivot([], ["samples", *has], "subset", "n")
