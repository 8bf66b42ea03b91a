"""Row alignment of predicted to gold tables and the metrics over aligned rows.

A record's two tables are small; records are many.  ``score_tables`` is a map over records: it holds
one record at a time and needs no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .signature import eval_cell, exact_match

#: Cost of leaving a row alone, and of a pair that shares nothing.
UNMATCHED, MISMATCH = 5.0, 10.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost assignment of rows to columns of a square matrix: shortest augmenting paths with
    potentials, one row at a time."""
    n = len(cost)
    if not n:
        return []
    row_of = np.full(n, -1)
    u, v = np.zeros(n), np.zeros(n)
    for start in range(n):
        least, previous = np.full(n, np.inf), np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        row, column, reached = start, -1, 0.0
        while True:
            slack = reached + cost[row] - u[row] - v
            better = ~done & (slack < least)
            least[better], previous[better] = slack[better], column
            column = int(np.argmin(np.where(done, np.inf, least)))
            reached = least[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        u[start] += reached
        for c in np.flatnonzero(done):
            if c != column:
                u[row_of[c]] += reached - least[c]
                v[c] -= reached - least[c]
        while column >= 0:
            before = previous[column]
            row_of[column] = start if before < 0 else row_of[before]
            column = before
    return sorted((int(r), c) for c, r in enumerate(row_of))


def number(value: object) -> float | None:
    """Finite number in a cell or its text, else None."""
    cell = eval_cell(value, 12)
    return float(cell) if isinstance(cell, int | float) else None


def key_part(value: object) -> object:
    """Key cell for comparison: number at two decimals, or the last word of a name."""
    x = number(value)
    if x is not None:
        return eval_cell(x)
    if not isinstance(value, str):
        return value
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in value.strip().lower()).split()
    return words[-1] if words else ""


def key_cost(gold: Sequence[object], pred: Sequence[object]) -> float:
    """Mean over key cells of 0 (equal), 1 - text similarity, or 1."""
    total = 0.0
    for g, p in zip(gold, pred, strict=True):
        if g != p:
            total += 1 - SequenceMatcher(None, g, p).ratio() if isinstance(g, str) and isinstance(p, str) and g and p else 1.0
    return total / max(1, len(gold))


def _records(table: dict) -> list[dict]:
    names = table.get("columns") or []
    return [dict(zip(names, [*row, *[None] * len(names)], strict=False)) for row in table.get("rows") or [] if isinstance(row, list)]


def align_rows(gold: dict, pred: dict, keys: Sequence[str] | None) -> list[tuple[int, int]]:
    """Pairs of row indices: by keys at least cost, or by position without keys."""
    g, p = _records(gold), _records(pred)
    if not keys:
        return [(i, i) for i in range(min(len(g), len(p)))]
    gk, pk = ([tuple(key_part(r.get(k)) for k in keys) for r in rows] for rows in (g, p))
    size = max(len(gk), len(pk))
    cost = np.full((size, size), UNMATCHED)
    for i, a in enumerate(gk):
        for j, b in enumerate(pk):
            c = key_cost(a, b)
            cost[i, j] = c if c < 1 else MISMATCH
    return [(i, j) for i, j in assign(cost) if i < len(gk) and j < len(pk) and cost[i, j] < UNMATCHED]


def compare(gold: dict, pred: dict, keys: Sequence[str] | None = None, tolerance: float = 0.2, compat: bool = False) -> dict[str, object]:
    """All metrics of one pair of tables; nulls count as zero where numbers are compared.

    With ``compat`` predicted cells are read by place among the common columns, as stored scores have it: a
    table with other or permuted columns gives the wrong cells."""
    keys = [k for k in keys or [] if k != "N/A"] or None
    if keys and any(k not in (gold.get("columns") or []) for k in keys):
        keys = None
    g, p = _records(gold), _records(pred)
    pairs = align_rows(gold, pred, keys)
    if compat:
        both = [c for c in gold.get("columns") or [] if c in (pred.get("columns") or [])]
        p = _records({"columns": both, "rows": pred.get("rows")})
    common = [c for c in gold.get("columns") or [] if c in (pred.get("columns") or []) and c not in (keys or [])]
    out: dict[str, object] = {**exact_match(gold, pred, nulls_as_zero=True), "pairs": len(pairs), "gold_rows": len(g), "pred_rows": len(p)}
    if keys:
        recall = len(pairs) / len(g) if g else 1.0
        precision = len(pairs) / len(p) if p else float(not g)
        out |= {"pk_recall": recall, "pk_precision": precision, "pk_f1": 2 * recall * precision / (recall + precision) if recall + precision else 0.0}
    correct = cells = 0
    confusion = dict.fromkeys(("tp", "fp", "fn", "tn"), 0)
    errors: dict[str, list[float]] = {}
    zero = lambda v: v is None or ((x := number(v)) is not None and abs(x) <= tolerance)
    for i, j in pairs:
        for c in common:
            a, b = (0 if r.get(c) is None else r.get(c) for r in (g[i], p[j]))
            x, y = number(a), number(b)
            cells += 1
            if x is not None and y is not None:
                correct += abs(y - x) <= tolerance
                errors.setdefault(c, []).append(y - x)
            else:
                correct += str(a).strip().lower() == str(b).strip().lower()
            confusion["tp" if zero(a) and zero(b) else "fn" if zero(a) else "fp" if zero(b) else "tn"] += 1
    out |= {"correct_cells": correct, "total_cells": cells, "cell_acc": 100.0 * correct / cells if cells else None, **confusion}
    sizes = {c: len(e) for c, e in errors.items()}
    total = sum(sizes.values())
    for name, how in (("mae", lambda e: float(np.mean(np.abs(e)))), ("rmse", lambda e: float(np.sqrt(np.mean(np.square(e)))))):
        out[f"weighted_{name}"] = sum(how(e) * sizes[c] for c, e in errors.items()) / total if total else None
    return out


METRICS = "row_match boolean, col_match boolean, content_match boolean, exact_match boolean, pairs bigint, gold_rows bigint, pred_rows bigint, pk_recall double, pk_precision double, pk_f1 double, correct_cells bigint, total_cells bigint, cell_acc double, tp bigint, fp bigint, fn bigint, tn bigint, weighted_mae double, weighted_rmse double"


def score_tables(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Metrics of every record: ``records`` has ``id_col``, ``gold`` and ``pred`` (JSON text of columns and
    rows; a null or broken prediction is an empty table) and ``primary_key`` (array)."""
    names = [part.split()[0] for part in METRICS.split(", ")]

    def table(text: object) -> dict:
        try:
            found = json.loads(text)
        except (TypeError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [compare(table(g), table(p), None if k is None else list(k)) for g, p, k in zip(batch["gold"], batch["pred"], batch["primary_key"], strict=True)]
            out = pd.DataFrame([{n: m.get(n) for n in names} for m in made], columns=names, index=batch.index)
            out.insert(0, id_col, batch[id_col])
            yield out

    kind = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, "gold", "pred", "primary_key").mapInPandas(run, f"`{id_col}` {kind}, {METRICS}")


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity of two names whatever the order of their words, from 0 to 1."""
    x, y = (" ".join(sorted(s.strip().lower().split())) for s in (a, b))
    return 1.0 if x == y else _indel_ratio(x, y)


def _indel_ratio(x: str, y: str) -> float:
    """2 * longest common subsequence / both lengths."""
    if not x or not y:
        return 0.0
    row = np.zeros(len(y) + 1, dtype=int)
    for c in x:
        diagonal = row[:-1] + np.fromiter((c == d for d in y), dtype=int, count=len(y))
        row[1:] = np.maximum.accumulate(np.maximum(diagonal, row[1:]))
    return 2.0 * int(row[-1]) / (len(x) + len(y))


def name_similarity(a: object, b: object, threshold: float = 0.85) -> float:
    """Token-sort similarity; 0 below the threshold or for missing names."""
    if a is None or b is None:
        return 0.0
    ratio = token_sort_ratio(str(a), str(b))
    return ratio if ratio >= threshold else 0.0
