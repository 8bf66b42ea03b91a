"""Queries of resampled intervals, permutation tests and rank tests over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import replicates
from .catalog import Tables, query

N, SEED = 60, 42


def _draws(rows: str) -> str:
    """SQL of ``rows`` (with ``id``) once a replicate, with the generator's ``u``."""
    made = ", ".join(f"({r}, {a}, {b})" for r, a, b in replicates.seeds(N, SEED))
    sql = f"SELECT * FROM ({rows}) CROSS JOIN (VALUES {made}) AS s(r, s1, s2)"
    for name, step in replicates.mixing_steps(lambda a, b: f"xor({a}, {b})"):
        sql = f"SELECT *, {step} AS {name} FROM ({sql})"
    return sql


_LINE_ID = "(l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey"
_POISSON = "CASE WHEN r = 0 THEN 1 ELSE " + " + ".join(f"(u >= {t})::INT" for t in replicates.POISSON) + " END"


def _sums(rows: str, keys: str) -> str:
    """SQL of the replicates' sums; ``rows`` has ``id``, ``x`` and ``w``."""
    return f"SELECT {keys}, r, count(*) AS n, sum(w * p) AS weight, sum(w * p * x) AS total FROM (SELECT *, {_POISSON} AS p FROM ({_draws(rows)})) GROUP BY {keys}, r"


_ENDS = "round(quantile_cont(CASE WHEN r > 0 THEN m END, 0.025), 9) AS ci_low, round(quantile_cont(CASE WHEN r > 0 THEN m END, 0.975), 9) AS ci_high"
_LABEL = "CASE WHEN ci_low > 0 OR ci_high < 0 THEN 'significant' ELSE 'not significant' END AS significance"


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("id", F.expr(_LINE_ID))


@query(f"SELECT *, {_LABEL} FROM (SELECT l_returnflag, max(n) AS rows, round(max(CASE WHEN r = 0 THEN m END), 9) AS mean, {_ENDS} FROM (SELECT *, total / weight / 100 AS m FROM ({_sums(f'SELECT l_returnflag, {_LINE_ID} AS id, round(l_quantity * 100) AS x, 1.0::DOUBLE AS w FROM lineitem', 'l_returnflag')})) GROUP BY l_returnflag)")
def bootstrap_means(t: Tables) -> DataFrame:
    """Poisson bootstrap of mean quantities."""
    return _rounded(replicates.bootstrap_intervals(_lines(t), "id", F.col("l_quantity"), ["l_returnflag"], N, digits=2), "mean", "ci_low", "ci_high")


@query(f"SELECT *, {_LABEL} FROM (SELECT l_linestatus, max(n) AS rows, round(max(CASE WHEN r = 0 THEN m END), 9) AS mean, {_ENDS} FROM (SELECT *, total / weight / 100 AS m FROM ({_sums(f'SELECT l_linestatus, {_LINE_ID} AS id, round(l_discount * 100) AS x, l_quantity AS w FROM lineitem WHERE l_quantity > 0', 'l_linestatus')})) GROUP BY l_linestatus)")
def bootstrap_weighted_means(t: Tables) -> DataFrame:
    """Poisson bootstrap of mean discounts weighted by quantity."""
    return _rounded(replicates.bootstrap_intervals(_lines(t), "id", F.col("l_discount"), ["l_linestatus"], N, weight=F.col("l_quantity"), digits=2), "mean", "ci_low", "ci_high")


@query(f"""WITH s AS MATERIALIZED ({_sums(f'SELECT l_linestatus, l_returnflag, {_LINE_ID} AS id, round(l_tax * 100) AS x, 1.0::DOUBLE AS w FROM lineitem', 'l_linestatus, l_returnflag')}),
j AS (SELECT s.l_linestatus, s.r, sum(s.n) AS n, sum(s.total / s.weight / 100 * o.weight) / sum(o.weight) AS m FROM s JOIN s o ON o.r = 0 AND o.l_linestatus = s.l_linestatus AND o.l_returnflag = s.l_returnflag GROUP BY s.l_linestatus, s.r)
SELECT *, {_LABEL} FROM (SELECT l_linestatus, CAST(max(n) AS BIGINT) AS rows, round(max(CASE WHEN r = 0 THEN m END), 9) AS mean, {_ENDS} FROM j GROUP BY l_linestatus)""")
def bootstrap_stratified_means(t: Tables) -> DataFrame:
    """Poisson bootstrap of mean taxes, each return flag drawn by itself."""
    return _rounded(replicates.bootstrap_intervals(_lines(t), "id", F.col("l_tax"), ["l_linestatus"], N, strata=["l_returnflag"], digits=2), "mean", "ci_low", "ci_high")


_ORDERS = "SELECT o_orderpriority, o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 END AS side, round(o_totalprice * 100) AS x, 1.0::DOUBLE AS w FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice IS NOT NULL"
_PICK = ", ".join(f"max(CASE WHEN side = {i} THEN n END) AS n_{s}, max(CASE WHEN side = {i} THEN total / weight / 100 END) AS mean_{s}" for i, s in enumerate(("first", "second")))


@query(f"""SELECT *, {_LABEL} FROM (SELECT o_orderpriority, max(n_first) AS n_first, max(n_second) AS n_second, round(max(CASE WHEN r = 0 THEN mean_first END), 9) AS mean_first, round(max(CASE WHEN r = 0 THEN mean_second END), 9) AS mean_second,
round(max(CASE WHEN r = 0 THEN m END), 9) AS delta, {_ENDS} FROM (SELECT *, mean_first - mean_second AS m FROM (SELECT o_orderpriority, r, {_PICK} FROM ({_sums(_ORDERS, 'o_orderpriority, side')}) GROUP BY o_orderpriority, r)) GROUP BY o_orderpriority)""")
def bootstrap_differences(t: Tables) -> DataFrame:
    """Bootstrap of the difference of mean prices between two order states."""
    found = replicates.bootstrap_differences(t.orders, "o_orderkey", F.col("o_totalprice"), F.col("o_orderstatus"), "O", "F", ["o_orderpriority"], N, digits=2)
    return _rounded(found, "mean_first", "mean_second", "delta", "ci_low", "ci_high")


_FLIPS = f"SELECT l_returnflag, r, count(*) AS rows, sum(CASE WHEN r = 0 OR u % 2 = 0 THEN x ELSE -x END) AS total FROM ({_draws(f'SELECT l_returnflag, {_LINE_ID} AS id, round((l_discount - l_tax - 0.01) * 100) AS x FROM lineitem WHERE l_discount - l_tax IS NOT NULL')}) GROUP BY l_returnflag, r"


@query(f"""WITH s AS MATERIALIZED ({_FLIPS}) SELECT s.l_returnflag, s.rows, round(max(o.total) / s.rows / 100, 9) AS observed, count(*) FILTER (s.r > 0 AND abs(s.total) >= abs(o.total)) AS extreme,
round((count(*) FILTER (s.r > 0 AND abs(s.total) >= abs(o.total)) + 1) / {N + 1}, 9) AS pvalue FROM s JOIN s o ON o.r = 0 AND o.l_returnflag = s.l_returnflag GROUP BY s.l_returnflag, s.rows""")
def sign_flip_pvalues(t: Tables) -> DataFrame:
    """Sign-flip test of paired differences."""
    found = replicates.sign_flip_pvalues(_lines(t), "id", F.col("l_discount") - F.col("l_tax") - 0.01, ["l_returnflag"], N, digits=2)
    return _rounded(found, "observed", "pvalue")


@query(f"""WITH o AS ({_ORDERS}), z AS (SELECT o_orderpriority, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, sum(x) FILTER (side = 0) AS sa, sum(x) AS st FROM o GROUP BY o_orderpriority),
d AS (SELECT o_orderpriority, r, x, row_number() OVER (PARTITION BY o_orderpriority, r ORDER BY u, id, x) AS k FROM ({_draws('SELECT * FROM o')}) WHERE r > 0),
s AS (SELECT d.o_orderpriority, d.r, sum(d.x) AS s FROM d JOIN z USING (o_orderpriority) WHERE d.k <= z.a GROUP BY ALL),
m AS (SELECT o_orderpriority, a, b, abs(s / a - (st - s) / b) >= abs(sa / a - (st - sa) / b) AS far, sa / a - (st - sa) / b AS seen FROM s JOIN z USING (o_orderpriority))
SELECT o_orderpriority, a AS n_first, b AS n_second, round(max(seen) / 100, 9) AS observed, count(*) FILTER (far) AS extreme, round((count(*) FILTER (far) + 1) / {N + 1}, 9) AS pvalue FROM m GROUP BY o_orderpriority, a, b""")
def permutation_pvalues(t: Tables) -> DataFrame:
    """Label permutation test of two order states."""
    found = replicates.permutation_pvalues(t.orders, "o_orderkey", F.col("o_totalprice"), F.col("o_orderstatus"), "O", "F", ["o_orderpriority"], N, digits=2)
    return _rounded(found, "observed", "pvalue")


def _balanced(rows: str, keys: str, cells: str, scale: int) -> str:
    """SQL of balanced subsamples; ``rows`` has ``keys``, ``id``, ``x`` and ``side``, and cells hold the keys and strata."""
    return f"""WITH o AS ({rows}), z AS (SELECT {cells}, least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m FROM o GROUP BY {cells}),
d AS (SELECT {cells}, side, r, x, row_number() OVER (PARTITION BY {cells}, side, r ORDER BY u, id, x) AS k FROM ({_draws('SELECT * FROM o')}) WHERE r > 0),
s AS (SELECT {keys}, r, sum(CASE WHEN side = 0 THEN x ELSE -x END) / count(*) FILTER (side = 0) / {scale} AS m, count(*) FILTER (side = 0) AS n_each, count(DISTINCT ({cells})) AS n_strata FROM d JOIN z USING ({cells}) WHERE k <= z.m GROUP BY {keys}, r),
a AS (SELECT {keys}, avg(m) AS mean FROM s GROUP BY {keys})
SELECT {keys}, n_strata, n_each, round(avg(m), 9) AS mean_delta, {_ENDS}, round(avg((sign(m) = sign(mean))::INT), 9) AS sign_agreement FROM s JOIN a USING ({keys}) GROUP BY {keys}, n_strata, n_each"""


@query(_balanced("SELECT event_type, event_id AS id, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS side, round(value * 100) AS x FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL", "event_type", "event_type", 100))
def balanced_differences(t: Tables) -> DataFrame:
    """Differences over subsamples of equal sizes of two groups of users, one of them four times as large."""
    side = F.when(F.col("user_id") % 5 == 0, 0).when(F.col("user_id").isNotNull(), 1)
    found = replicates.balanced_differences(t.events, "event_id", F.col("value"), side, 0, 1, ["event_type"], n=N, digits=2)
    return _rounded(found, "mean_delta", "ci_low", "ci_high", "sign_agreement")


@query(_balanced("SELECT o_orderstatus, month(o_orderdate) AS month, o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 END AS side, round(o_totalprice * 100) AS x FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_totalprice IS NOT NULL", "o_orderstatus", "o_orderstatus, month", 100))
def balanced_stratified_differences(t: Tables) -> DataFrame:
    """Differences between two priorities over subsamples that are of equal sizes in every month."""
    dated = t.orders.withColumn("month", F.month("o_orderdate").cast("bigint"))
    found = replicates.balanced_differences(dated, "o_orderkey", F.col("o_totalprice"), F.col("o_orderpriority"), "1-URGENT", "5-LOW", ["o_orderstatus"], ["month"], N, digits=2)
    return _rounded(found, "mean_delta", "ci_low", "ci_high", "sign_agreement")


def _factors() -> Column:
    """Factors of a line, each with the line's level."""
    levels = {"flag": F.col("l_returnflag"), "number": F.col("l_linenumber").cast("string"), "year": F.year("l_shipdate").cast("string")}
    return F.inline(F.array(*(F.struct(F.lit(k).alias("factor"), v.alias("level")) for k, v in levels.items())))


_FACTORS = " UNION ALL ".join(f"SELECT '{k}' AS factor, CAST({v} AS VARCHAR) AS level, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem" for k, v in (("flag", "l_returnflag"), ("number", "l_linenumber"), ("year", "year(l_shipdate)")))
#: P(|Z| >= z) by the error function's series in closed form.
_TWO_SIDED = "CASE WHEN z > 8.3 THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - exp(-z * z / 2) * list_sum(list_transform(range(0, 161), lambda i: exp((2 * i + 1) * ln(greatest(z, 1e-300) / sqrt(2)) - lgamma(i + 1.5)))))) END"


@query(f"""WITH f AS ({_FACTORS}), h AS (SELECT factor, level, l_quantity AS x, count(*) AS n, count(*) FILTER (l_linestatus = 'O') AS a FROM f WHERE l_linestatus IN ('O', 'F') AND l_quantity IS NOT NULL GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY factor, level ORDER BY x) - n AS below FROM h),
g AS (SELECT factor, level, sum(a) AS a, sum(n - a) AS b, sum(a * (below + (n + 1) / 2)) AS ranks, sum(n * n * n - n)::DOUBLE AS ties FROM k GROUP BY ALL),
u AS (SELECT *, ranks - a * (a + 1) / 2 AS u, a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1))) AS spread FROM g WHERE a > 0 AND b > 0),
z AS (SELECT *, CASE WHEN spread > 0 THEN greatest(0.0, abs(u - a * b / 2) - 0.5) / sqrt(spread) ELSE 0.0 END AS z FROM u)
SELECT factor, level, CAST(a AS BIGINT) AS n_first, CAST(b AS BIGINT) AS n_second, u, ties, round(z, 9) AS z, round(CASE WHEN spread > 0 THEN {_TWO_SIDED} ELSE 1.0 END, 9) AS pvalue FROM z""")
def rank_sum_tests(t: Tables) -> DataFrame:
    """Mann-Whitney tests of quantities between two line states, for every level of three factors."""
    lines = t.lineitem.select("l_linestatus", "l_quantity", _factors())
    return _rounded(replicates.mann_whitney(lines, F.col("l_quantity"), F.col("l_linestatus"), "O", "F", ["factor", "level"]), "z", "pvalue")


@query(f"""WITH f AS (SELECT factor, level, round((l_discount - l_tax - 0.01) * 100) AS d FROM ({_FACTORS})), h AS (SELECT factor, level, abs(d) AS x, count(*) AS n, count(*) FILTER (d > 0) AS a FROM f WHERE d <> 0 GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY factor, level ORDER BY x) - n AS below FROM h),
g AS (SELECT factor, level, sum(n) AS n, least(sum(a * (below + (n + 1) / 2)), sum((n - a) * (below + (n + 1) / 2))) AS w, sum(n * n * n - n)::DOUBLE AS ties FROM k GROUP BY ALL),
u AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - ties / 48 AS spread FROM g), z AS (SELECT *, CASE WHEN spread > 0 THEN abs(w - n * (n + 1) / 4) / sqrt(spread) ELSE 0.0 END AS z FROM u)
SELECT factor, level, CAST(n AS BIGINT) AS n, w, ties, round(z, 9) AS z, round(CASE WHEN spread > 0 THEN {_TWO_SIDED} ELSE 1.0 END, 9) AS pvalue FROM z""")
def signed_rank_tests(t: Tables) -> DataFrame:
    """Wilcoxon tests of paired differences, for every level of three factors."""
    lines = t.lineitem.select("l_discount", "l_tax", _factors())
    return _rounded(replicates.wilcoxon(lines, F.round((F.col("l_discount") - F.col("l_tax") - 0.01) * 100), ["factor", "level"]), "z", "pvalue")
