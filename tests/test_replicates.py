"""Resampling as aggregates against brute force with the same random numbers."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from scorelake.operators import replicates, resample

N, SEED = 20, 7
SEEDS = replicates.seeds(N, SEED)
ROWS = "k string, id bigint, x double, side string, s string, w double, r string, u string"


def draw(id_, r):
    """The generator for one row and replicate."""
    _, s1, s2 = SEEDS[r]
    return replicates._mix(replicates._mix((id_ & replicates.MASK) ^ s1) ^ ((id_ >> 32) & replicates.MASK) ^ s2)


def poisson(id_, r):
    return 1 if r == 0 else sum(draw(id_, r) >= t for t in replicates.POISSON)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for i in range(900):
        key = "hot" if i % 3 else ("cold", None, "lone")[i // 3 % 3]
        value = None if i % 50 == 7 else math.nan if i % 50 == 9 else float(rng.integers(-20, 40)) / 4
        out.append((key, i * 5_000_000_011 - 10**12, value, "a" if key == "lone" or i % 4 else "b", "xyz"[i % 7 % 3], float(i % 4), "r", "u"))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(5)


def kept(rows, *more):
    out = defaultdict(list)
    for k, id_, x, side, s, w, *_ in rows:
        if x is not None and x == x:
            out[(k, *({"side": side, "s": s}[m] for m in more))].append((id_, x, side, w))
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_uniform_and_poisson_draws(spark):
    found = replicates.with_draws(spark.range(4000), N, SEED).select("r", "u").toPandas()
    assert found["u"].between(0, replicates.MASK).all()
    for r, own in found.groupby("r"):
        if r:
            assert abs(own["u"].mean() / 2**32 - 0.5) < 0.03
    wide = found[found["r"] > 0]["u"].to_numpy()
    weights = (wide[:, None] >= np.array(replicates.POISSON)).sum(axis=1)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.05
    per = replicates.with_draws(spark.range(3000), N, SEED).filter("r > 0").groupBy("r").pivot("id", [1, 2]).agg(F.first("u")).toPandas()
    assert abs(np.corrcoef(per["1"], per["2"])[0, 1]) < 0.7


@pytest.mark.parametrize("weighted", [False, True])
def test_bootstrap_equals_brute_force(table, rows, weighted):
    found = {(r["k"], r["r"]): r for r in replicates.bootstrap_sums(table, "id", F.col("x"), ["k"], N, SEED, F.col("w") if weighted else None).collect()}
    groups = {k[0]: [(i, x, w if weighted else 1.0) for i, x, _, w in v if w > 0 or not weighted] for k, v in kept(rows).items()}
    assert len(found) == (N + 1) * len(groups)
    for (k, r), row in found.items():
        weight = [poisson(i, r) * w for i, _, w in groups[k]]
        assert row["weight"] == sum(weight) and row["total"] == sum(w * x * 1e6 for w, (_, x, _) in zip(weight, groups[k], strict=True))
    intervals = {r["k"]: r for r in replicates.bootstrap_intervals(table, "id", F.col("x"), ["k"], N, 0.1, SEED, F.col("w") if weighted else None).collect()}
    for k, own in groups.items():
        means = [found[k, r]["total"] / found[k, r]["weight"] / 1e6 for r in range(N + 1)]
        assert close(intervals[k]["mean"], means[0]) and intervals[k]["rows"] == len(own)
        assert close(intervals[k]["ci_low"], np.percentile(means[1:], 5)) and close(intervals[k]["ci_high"], np.percentile(means[1:], 95))


def test_stratified_bootstrap_keeps_shares(table, rows):
    found = {r["k"]: r for r in replicates.bootstrap_intervals(table, "id", F.col("x"), ["k"], N, 0.1, SEED, strata=["s"]).collect()}
    cells = kept(rows, "s")
    for k, got in found.items():
        own = {s: v for (key, s), v in cells.items() if key == k}
        means = []
        for r in range(1, N + 1):
            each = {s: (np.average([x for _, x, _, _ in v], weights=[poisson(i, r) for i, *_ in v]), len(v)) for s, v in own.items()}
            means.append(sum(m * n for m, n in each.values()) / sum(n for _, n in each.values()))
        assert close(got["ci_low"], np.percentile(means, 5)) and close(got["ci_high"], np.percentile(means, 95))
        assert got["rows"] == sum(map(len, own.values())) and got["significance"] in ("significant", "not significant")


def test_intervals_cover_like_plain_resampling(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, size=2000)
    frame = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, id bigint, x double")
    got = replicates.bootstrap_intervals(frame, "id", F.col("x"), ["k"], 400).first()
    low, high = resample.bootstrap_ci(x, n=2000)
    assert abs(got["ci_low"] - low) < 0.03 and abs(got["ci_high"] - high) < 0.03 and got["significance"] == "significant"


def test_sign_flips_equal_brute_force(table, rows):
    found = {r["k"]: r for r in replicates.sign_flip_pvalues(table, "id", F.col("x") - 2, ["k"], N, SEED).collect()}
    for (k,), own in kept(rows).items():
        totals = [abs(sum((x - 2) * (1 if r == 0 or draw(i, r) % 2 == 0 else -1) for i, x, *_ in own)) for r in range(N + 1)]
        assert found[k]["extreme"] == sum(t >= totals[0] for t in totals[1:]) and close(found[k]["pvalue"], (found[k]["extreme"] + 1) / (N + 1))
        assert close(found[k]["observed"], sum(x - 2 for _, x, *_ in own) / len(own)) and found[k]["rows"] == len(own)


def smallest(own, r, k):
    return [x for _, _, x in sorted((draw(i, r), i, x) for i, x, *_ in own)[:k]]


@pytest.mark.parametrize(("sigmas", "small"), [(6.0, 4096), (6.0, 0), (1.0, 0), (0.0, 0)])
def test_relabelling_equals_brute_force_whatever_the_band(table, rows, sigmas, small):
    found = {r["k"]: r for r in replicates.permutation_pvalues(table, "id", F.col("x"), F.col("side"), "a", "b", ["k"], N, SEED, sigmas=sigmas, small=small).collect()}
    assert set(found) == {"hot", "cold", None}  # "lone" has one side
    for k, got in found.items():
        own = kept(rows)[(k,)]
        a, b = [x for _, x, s, _ in own if s == "a"], [x for _, x, s, _ in own if s == "b"]
        delta = lambda s, n=len(a), m=len(b), t=sum(a) + sum(b): s / n - (t - s) / m
        data = delta(sum(a))
        far = sum(abs(delta(sum(smallest(own, r, len(a))))) >= abs(data) - 1e-12 for r in range(1, N + 1))
        assert (got["n_first"], got["n_second"], got["extreme"]) == (len(a), len(b), far) and close(got["observed"], data)


@pytest.mark.parametrize(("sigmas", "small", "strata"), [(6.0, 4096, []), (0.0, 0, []), (2.0, 0, ["s"])])
def test_balanced_subsamples_equal_brute_force(table, rows, sigmas, small, strata):
    found = {r["k"]: r for r in replicates.balanced_differences(table, "id", F.col("x"), F.col("side"), "a", "b", ["k"], strata, N, 0.1, SEED, sigmas=sigmas, small=small).collect()}
    assert set(found) == {"hot", "cold", None}
    for k, got in found.items():
        cells = [v for key, v in kept(rows, *strata).items() if key[0] == k]
        cells = [([o for o in v if o[2] == "a"], [o for o in v if o[2] == "b"]) for v in cells]
        cells = [(a, b, min(len(a), len(b))) for a, b in cells if a and b]
        each = sum(m for *_, m in cells)
        deltas = [sum(sum(smallest(a, r, m)) - sum(smallest(b, r, m)) for a, b, m in cells) / each for r in range(1, N + 1)]
        assert (got["n_strata"], got["n_each"]) == (len(cells), each) and close(got["mean_delta"], np.mean(deltas))
        assert close(got["ci_low"], np.percentile(deltas, 5)) and close(got["sign_agreement"], np.mean(np.sign(deltas) == np.sign(np.mean(deltas))))


def test_draws_do_not_depend_on_partitions(table):
    one = replicates.balanced_differences(table.coalesce(1), "id", F.col("x"), F.col("side"), "a", "b", ["k"], n=N).collect()
    many = replicates.balanced_differences(table.repartition(9, "x"), "id", F.col("x"), F.col("side"), "a", "b", ["k"], n=N).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_rank_tests_equal_plain_ones(table, rows):
    u = {r["k"]: r for r in replicates.mann_whitney(table, F.col("x"), F.col("side"), "a", "b", ["k"]).collect()}
    w = {r["k"]: r for r in replicates.wilcoxon(table, F.col("x") - 5, ["k"]).collect()}
    assert set(u) == {"hot", "cold", None} and set(w) == {"hot", "cold", None, "lone"}
    for (k,), own in kept(rows).items():
        if k in u:
            want = resample.mann_whitney_pvalue([x for _, x, s, _ in own if s == "a"], [x for _, x, s, _ in own if s == "b"])
            assert abs(u[k]["pvalue"] - want) < 1e-9
        assert abs(w[k]["pvalue"] - resample.wilcoxon_pvalue([x - 5 for _, x, *_ in own])) < 1e-9


def test_mid_ranks_of_a_key_that_spans_partitions(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 500, size=3000)
    frame = spark.createDataFrame([("a" if i % 10 else "b", int(v)) for i, v in enumerate(x)], "k string, x bigint")
    for k, found in replicates.mid_ranks(frame, ["k"], "x", {}).toPandas().groupby("k"):
        own = np.sort([v for i, v in enumerate(x) if (i % 10 > 0) == (k == "a")])
        want = {int(v): 2 * (np.searchsorted(own, v) + 1 + np.searchsorted(own, v, "right")) / 2 for v in own}
        assert dict(zip(found["x"], found["rank2"], strict=True)) == want


def test_tail_of_the_normal_distribution(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.96, 3.0, 5.0, 6.5, 8.0, 9.0, 40.0]
    found = spark.createDataFrame([(v,) for v in z], "z double").select("z", replicates.two_sided(F.col("z")).alias("p")).collect()
    assert all(abs(r["p"] - math.erfc(r["z"] / math.sqrt(2))) < 1e-14 for r in found)


def test_tables_without_scores(spark):
    empty = spark.createDataFrame([("k", 1, None, "a", "x", 1.0, "r", "u")], ROWS)
    assert replicates.bootstrap_intervals(empty, "id", F.col("x"), ["k"], 5).count() == 0
    assert replicates.permutation_pvalues(empty, "id", F.col("x"), F.col("side"), "a", "b", ["k"], 5).count() == 0
    assert replicates.mann_whitney(empty, F.col("x"), F.col("side"), "a", "b", ["k"]).count() == replicates.wilcoxon(empty, F.col("x"), ["k"]).count() == 0
