"""Seeded resampling and tests over paired or pooled scores.

The statistics are of one comparison's scores; ``by_group`` runs one for each group of a table in
parallel.  Groups here are scores per comparison, which are bounded by the benchmark's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _clean(values: Sequence[float]) -> np.ndarray:
    x = np.asarray(values, dtype=float)
    return x[~np.isnan(x)]


def _places(strata: np.ndarray) -> list[np.ndarray]:
    """Places of each stratum, in order of its name."""
    return [np.flatnonzero(strata == s) for s in sorted(set(strata.tolist()), key=str)]


def bootstrap_ci(values: Sequence[float], n: int = 10_000, alpha: float = 0.05, seed: int = 42, weights: Sequence[float] | None = None, strata: Sequence[object] | None = None) -> tuple[float, float]:
    """Percentile interval of the (weighted) mean; NaN for no values.  With ``strata`` each draw takes as many
    values of a stratum as it has."""
    x = np.asarray(values, dtype=float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, dtype=float)
    keep = ~np.isnan(x) & ~np.isnan(w) & (w > 0)
    groups = None if strata is None else _places(np.asarray(list(strata), dtype=object)[keep])
    x, w = x[keep], w[keep]
    if not len(x):
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    means = np.empty(n)
    for i in range(n):
        at = rng.choice(len(x), size=len(x), replace=True) if groups is None else np.concatenate([rng.choice(g, size=len(g), replace=True) for g in groups])
        means[i] = np.average(x[at], weights=w[at])
    return float(np.percentile(means, 50 * alpha)), float(np.percentile(means, 100 - 50 * alpha))


def sign_flip_pvalue(deltas: Sequence[float], n: int = 5000, seed: int = 42) -> float:
    """Share of random sign flips whose mean is at least as far from 0, counting the observed one."""
    x = _clean(deltas)
    if not len(x):
        return math.nan
    rng = np.random.default_rng(seed)
    extreme = sum(abs((rng.choice([-1.0, 1.0], size=len(x)) * x).mean()) >= abs(x.mean()) for _ in range(n))
    return (int(extreme) + 1) / (n + 1)


def label_permutation_pvalue(x: Sequence[float], y: Sequence[float], n: int = 5000, seed: int = 42) -> float:
    """Share of random relabellings with at least the observed difference of means."""
    a, b = _clean(x), _clean(y)
    if not len(a) or not len(b):
        return math.nan
    both, rng = np.concatenate([a, b]), np.random.default_rng(seed)
    observed, extreme = abs(a.mean() - b.mean()), 0
    for _ in range(n):
        p = rng.permutation(both)
        extreme += abs(p[: len(a)].mean() - p[len(a) :].mean()) >= observed
    return (int(extreme) + 1) / (n + 1)


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    values, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return ((last - counts + 1 + last) / 2)[place] if len(values) else x


def _two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def mann_whitney_pvalue(x: Sequence[float], y: Sequence[float]) -> float:
    """Two-sided U test: normal approximation with tie and continuity corrections."""
    a, b = _clean(x), _clean(y)
    n, m = len(a), len(b)
    if not n or not m:
        return math.nan
    both = np.concatenate([a, b])
    u = _ranks(both)[:n].sum() - n * (n + 1) / 2
    ties = np.unique(both, return_counts=True)[1]
    total = n + m
    spread = n * m / 12 * (total + 1 - (ties**3 - ties).sum() / (total * (total - 1)))
    return 1.0 if spread <= 0 else _two_sided(max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(spread))


def wilcoxon_pvalue(deltas: Sequence[float]) -> float:
    """Two-sided signed-rank test without zeros: normal approximation with tie correction."""
    x = _clean(deltas)
    x = x[x != 0]
    n = len(x)
    if not n:
        return math.nan
    ranks = _ranks(np.abs(x))
    ties = np.unique(np.abs(x), return_counts=True)[1]
    spread = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    w = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    return 1.0 if spread <= 0 else _two_sided((w - n * (n + 1) / 4) / math.sqrt(spread))


def sign_pvalue(deltas: Sequence[float]) -> float:
    """Exact two-sided sign test."""
    x = _clean(deltas)
    n, k = int((x != 0).sum()), int((x > 0).sum())
    if not n:
        return math.nan
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n
    return min(1.0, 2 * tail)


def paired_t_pvalue(deltas: Sequence[float]) -> float:
    """Two-sided paired t test, by the incomplete beta function's continued fraction."""
    x = _clean(deltas)
    n = len(x)
    if n < 2 or x.std(ddof=1) == 0:
        return math.nan
    t = x.mean() / (x.std(ddof=1) / math.sqrt(n))
    return _beta((n - 1) / 2, 0.5, (n - 1) / (n - 1 + t * t))


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):  # modified Lentz
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-12 and i:
            break
    return front * (f - 1)


def significance(low: float, high: float) -> str:
    return "NA" if math.isnan(low) or math.isnan(high) else "significant" if low > 0 or high < 0 else "not significant"


def paired_summary(first: Sequence[float], second: Sequence[float]) -> dict[str, object]:
    """Comparison of two scores of the same items; items without both are left out."""
    a, b = np.asarray(first, dtype=float), np.asarray(second, dtype=float)
    d = _clean(a - b)
    if not len(d):
        return {"n_pairs": 0}
    low, high = bootstrap_ci(d)
    return {
        "n_pairs": len(d), "mean_delta": float(d.mean()), "median_delta": float(np.median(d)), "ci_low": low, "ci_high": high,
        "prop_first_higher": float((d > 0).mean()), "prop_equal": float((d == 0).mean()), "paired_t_pvalue": paired_t_pvalue(d),
        "wilcoxon_pvalue": wilcoxon_pvalue(d), "sign_test_pvalue": sign_pvalue(d), "significance": significance(low, high),
    }


def pooled_summary(x: Sequence[float], y: Sequence[float], n: int = 10_000, seed: int = 42) -> dict[str, object]:
    """Comparison of two independent sets of scores."""
    a, b = _clean(x), _clean(y)
    if not len(a) or not len(b):
        return {"n_first": len(a), "n_second": len(b)}
    rng = np.random.default_rng(seed)
    deltas = [rng.choice(a, len(a)).mean() - rng.choice(b, len(b)).mean() for _ in range(n)]
    low, high = (float(p) for p in np.percentile(deltas, [2.5, 97.5]))
    return {"n_first": len(a), "n_second": len(b), "mean_delta": float(a.mean() - b.mean()), "ci_low": low, "ci_high": high, "mannwhitney_pvalue": mann_whitney_pvalue(a, b), "permutation_pvalue": label_permutation_pvalue(a, b), "significance": significance(low, high)}


def balanced_delta(x: Sequence[float], y: Sequence[float], n: int = 2000, seed: int = 42) -> tuple[float, float, float]:
    """Mean and interval of the difference over subsamples of equal size, drawn without replacement."""
    a, b = _clean(x), _clean(y)
    k, rng = min(len(a), len(b)), np.random.default_rng(seed)
    if not k:
        return math.nan, math.nan, math.nan
    d = [rng.choice(a, k, replace=False).mean() - rng.choice(b, k, replace=False).mean() for _ in range(n)]
    return float(np.mean(d)), *(float(p) for p in np.percentile(d, [2.5, 97.5]))


def by_group(df: DataFrame, keys: Sequence[str], schema: str, summary: Callable[[pd.DataFrame], dict[str, object]]) -> DataFrame:
    """One summary row for each group; ``schema`` is that of the summary without the keys."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([dict(zip(keys, key, strict=True)) | summary(rows)])

    return df.groupBy(*keys).applyInPandas(run, f"{types}, {schema}")
