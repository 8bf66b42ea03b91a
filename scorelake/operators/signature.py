"""Content signatures of tables and first-wins deduplication."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells


def json_value(value: object, digits: int = 12) -> object:
    """Stable JSON form of a cell: NaN and infinities null, floats rounded, other kinds as text."""
    if value is None or isinstance(value, str | bool | int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) or math.isinf(value) else round(value, digits)
    return json_value(value.item(), digits) if hasattr(value, "item") else str(value)


def answer_signature(answer: object) -> str:
    """SHA-256 over column names and the multiset of rows; empty for anything but an answer."""
    if not isinstance(answer, dict):
        return ""
    names = [json_value(c) for c in answer.get("columns") or []]
    rows = sorted(([json_value(c) for c in r] for r in answer.get("rows") or []), key=lambda r: json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
    return hashlib.sha256(json.dumps({"columns": names, "rows": rows}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def eval_cell(value: object, digits: int = 2) -> object:
    """Cell for content comparison: text trimmed, numbers (also in text) rounded, whole ones integers."""
    if isinstance(value, str):
        value = value.strip()
    try:
        number = float(value) if value not in (None, "") else None
    except (TypeError, ValueError):
        return value
    if number is None:
        return value
    if math.isnan(number) or math.isinf(number):
        return value if isinstance(value, str) else None
    number = round(number, digits)
    return int(round(number)) if abs(number - round(number)) < 10**-digits else number


def table_signature(answer: dict, digits: int = 2, nulls_as_zero: bool = False) -> tuple[int, int, list[str]]:
    """Rows, columns and sorted normalised rows of an answer; names don't count."""
    kept = [r for r in answer.get("rows") or [] if isinstance(r, list)]
    cell = (lambda v: eval_cell(0 if v is None else v, digits)) if nulls_as_zero else (lambda v: eval_cell(v, digits))
    return len(answer.get("rows") or []), len(answer.get("columns") or []), sorted(json.dumps([cell(v) for v in r], ensure_ascii=False, sort_keys=True) for r in kept)


def exact_match(gold: dict, pred: dict, **how) -> dict[str, bool]:
    """Row count, column count and content equality, and all three."""
    g, p = table_signature(gold, **how), table_signature(pred, **how)
    out = {f"{name}_match": x == y for name, x, y in zip(("row", "col", "content"), g, p, strict=True)}
    return out | {"exact_match": all(out.values())}


def frame_signature(df: DataFrame, digits: int = 12) -> DataFrame:
    """One row: shape and an order-free digest of all rows; column names don't count.

    The digest is two sums of row hashes, so partial results are combined where rows are and no row
    list is gathered."""
    texts = [F.coalesce(F.round(cells.finite(F.col(n)), digits).cast("string") if t in ("double", "float") else F.col(n).cast("string"), F.lit("\0")) for n, t in df.dtypes]
    row = F.xxhash64(*texts) if texts else F.lit(0).cast("bigint")
    low, high = row.bitwiseAND((1 << 31) - 1), F.shiftright(row, 31)
    made = df.select(low.alias("l"), high.alias("h"), (low * low).cast("decimal(38,0)").alias("q"))
    sums = made.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("l").cast("decimal(38,0)")).alias("l"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum("q").alias("q"))
    return sums.select("rows", F.lit(len(df.columns)).alias("columns"), F.sha2(F.concat_ws("|", "rows", F.lit(len(df.columns)), F.coalesce("l", F.lit(0)), F.coalesce("h", F.lit(0)), F.coalesce("q", F.lit(0))), 256).alias("signature"))


def multiset_signature(df: DataFrame, keys: Sequence[str], row: Column, alias: str = "signature") -> DataFrame:
    """SHA-256 of each key's sorted row texts; duplicates count."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), "|"), 256).alias(alias))


def first_wins(df: DataFrame, scope: Sequence[str], fingerprint: str, order: str) -> DataFrame:
    """``df`` with ``kept`` (first of its scope and fingerprint) and ``first`` (the order value it repeats).

    Rows without a fingerprint are always kept.  Aggregation finds the first of each group, so a large
    group of copies isn't sorted in one task."""
    keyed = df.withColumn("__fp", F.nullif(F.col(fingerprint), F.lit("")))
    firsts = keyed.filter("__fp IS NOT NULL").groupBy(*scope, "__fp").agg(F.min(order).alias("first"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*scope, "__fp"]]
    joined = keyed.alias("l").join(firsts.alias("r"), same, "left").select("l.*", "r.first").drop("__fp")
    return joined.withColumn("kept", F.coalesce(F.col(order) == F.col("first"), F.lit(True)))


def keep_first(df: DataFrame, scope: Sequence[str], fingerprint: Column, order: str) -> DataFrame:
    """``scope`` and ``order`` of the rows that ``first_wins`` keeps, for distinct order values: one scan, one
    partial aggregation, and no join, so that a fingerprint is made once and a hot one is combined where it is."""
    keyed = df.select(*scope, order, F.nullif(fingerprint, F.lit("")).alias("__fp"))
    alone = F.when(F.col("__fp").isNull(), F.col(order))
    return keyed.groupBy(*scope, "__fp", alone.alias("__alone")).agg(F.min(order).alias(order)).select(*scope, order)


def seen_before(df: DataFrame, fingerprint: str, registry: DataFrame) -> DataFrame:
    """Rows whose fingerprint the registry table lacks."""
    return df.join(registry.select(fingerprint).distinct(), fingerprint, "left_anti")


class Registry:
    """Statements and descriptions admitted so far, by canonical text; for a generator's loop on the driver."""

    def __init__(self, compat: bool = False) -> None:
        self.compat = compat
        self.statements: set[str] = set()
        self.descriptions: set[str] = set()

    def add(self, sql: str, description: str = "") -> bool:
        """Whether both are new; then they are taken.  With ``compat`` a statement whose description is known is
        taken all the same, so it can't come again with another."""
        statement, words = (" ".join((s or "").lower().split()) for s in (sql, description))
        known = bool(words) and words in self.descriptions
        if not statement or statement in self.statements or known and not self.compat:
            return False
        self.statements.add(statement)
        if known:
            return False
        self.descriptions.add(words)
        return True


def latest_distinct(df: DataFrame, canonical: str, order: str, n: int) -> DataFrame:
    """The ``n`` distinct canonical texts seen last, in their original order."""
    last = df.groupBy(canonical).agg(F.max(order).alias("at"))
    return last.orderBy(F.desc("at")).limit(n).orderBy("at")
