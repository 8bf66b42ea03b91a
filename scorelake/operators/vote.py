"""Voting over repeated predictions and choice among attempts."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal, InvalidOperation
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import MISMATCH, UNMATCHED, assign


def plurality(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; the one seen first breaks ties.  Two partial aggregations."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first"))
    best = counted.groupBy(*keys).agg(F.max(F.struct("votes", (-F.col("__first")).alias("early"), F.col(value).alias("winner"))).alias("b"))
    return best.select(*keys, "b.winner", "b.votes")


def pick_attempt(df: DataFrame, keys: Sequence[str], attempt: str, valid: Column, last: bool = True) -> DataFrame:
    """The last (or first) valid attempt of each key, whole rows."""
    rest = F.struct(F.col(attempt).alias("__at"), F.struct(*df.columns).alias("row"))
    return df.filter(valid).groupBy(*keys).agg((F.max if last else F.min)(rest).alias("__best")).select("__best.row.*")


def canonical_cell(value: object) -> object:
    """Plain decimal text of numbers (no trailing zeros, no minus zero), other text trimmed."""
    if value is None or isinstance(value, bool):
        return value
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return str(value).strip()
    if not number.is_finite():
        return None
    text = format(number, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def _all_same(values: Sequence[object]) -> bool:
    """Whether plain values are all one and the same, so that any vote gives the first."""
    first = values[0]
    return isinstance(first, str | int | float | None) and all(v == first and type(v) is type(first) for v in values)


def vote_cell(values: Sequence[object], tolerance: float = 0.0) -> object:
    """Winner of a cell: the largest group of equal values or of numbers within ``tolerance`` of one of
    them, whichever is larger; groups of numbers tie by closeness, then by the earlier vote."""
    if values and _all_same(values):
        return values[0]
    cells = [canonical_cell(v) for v in values]
    counts = Counter(cells)
    best = max(counts.items(), key=lambda kv: (kv[1], -cells.index(kv[0])), default=(None, 0))
    numbers = []
    for i, c in enumerate(cells):
        try:
            numbers.append((i, float(c)))
        except (TypeError, ValueError):
            continue
    groups = []
    for i, x in numbers:
        near = [abs(x - y) for _, y in numbers if abs(x - y) <= tolerance]
        groups.append((-len(near), sum(near), i))
    if groups and -min(groups)[0] > best[1]:
        return values[min(groups)[2]]
    return values[cells.index(best[0])] if cells else None


def vote_by_position(tables: Sequence[Sequence[Sequence[object]]], tolerance: float = 0.0) -> list[list[object]]:
    """Rows of the most frequent row count, each cell voted among the tables that have that many."""
    if not tables:
        return []
    sizes = Counter(map(len, tables))
    size = max(sizes, key=lambda n: (sizes[n], -[len(t) for t in tables].index(n)))
    same = [t for t in tables if len(t) == size]
    return [[vote_cell(cells, tolerance) for cells in zip(*(t[i] for t in same), strict=False)] for i in range(size)]


def vote_by_key(tables: Sequence[Sequence[dict]], keys: Sequence[str], tolerance: float = 0.0) -> list[dict]:
    """Rows (by canonical key) that more than half of the tables have, each other cell voted."""
    rows: dict[tuple, list[dict]] = {}
    for table in tables:
        for key, row in {tuple(canonical_cell(r.get(k)) for k in keys): r for r in table}.items():
            rows.setdefault(key, []).append(row)
    kept = [group for group in rows.values() if len(group) >= len(tables) // 2 + 1]
    return [{c: group[0].get(c) if c in keys else vote_cell([r.get(c) for r in group], tolerance) for c in dict.fromkeys(c for r in group for c in r)} for group in kept]


# Costs of two different names with one surname: one's words are all in the other's, the
# first letters are equal, one is the surname alone; and the least ratio at which other names are close.
NAME_PART, NAME_INITIAL, NAME_ALONE, NAME_CLOSE = 0.2, 0.25, 0.35, 0.95


def _key_words(value: object) -> tuple[str, ...]:
    return tuple("".join(c if c.isalnum() else " " for c in str(value).lower()).split())


def key_cell_cost(a: object, b: object) -> float:
    """Distance of two key cells from 0 (equal) to 1: numbers and missing cells are equal or not, names may
    share a surname or be close in spelling."""
    x, y = canonical_cell(a), canonical_cell(b)
    if x is None or y is None or _is_number(x) or _is_number(y):
        return float(x != y)
    v, w = _key_words(x), _key_words(y)
    if v == w:
        return 0.0
    if v and w and v[-1] == w[-1]:
        if set(v) <= set(w) or set(w) <= set(v):
            return NAME_PART
        if v[0][0] == w[0][0]:
            return NAME_INITIAL
        if len(v) == 1 or len(w) == 1:
            return NAME_ALONE
    ratio = SequenceMatcher(None, " ".join(v), " ".join(w)).ratio()
    return 1 - ratio if ratio >= NAME_CLOSE else 1.0


def _is_number(cell: object) -> bool:
    try:
        return Decimal(str(cell)).is_finite()
    except InvalidOperation:
        return False


def cluster_rows(tables: Sequence[Sequence[dict]], keys: Sequence[str]) -> list[list[dict]]:
    """Rows of several tables that are about the same thing: each table's rows are matched at least cost to
    the clusters so far, those that match none begin their own.

    A row that has only a surname joins no cluster of another name if several clusters share it."""
    clusters: list[list[dict]] = []
    places: dict[tuple, int] | None = {}  # of clusters by key, while each has one key of its own
    for table in tables:
        if places is not None:
            places = _match_equal(table, keys, clusters, places)
            if places is not None:
                continue
        size = max(len(table), len(clusters))
        cost = np.full((size, size), UNMATCHED)
        shared = [Counter(w[-1] for c in clusters if (w := _words_of(c[0].get(k)))) for k in keys]
        for i, row in enumerate(table):
            for j, cluster in enumerate(clusters):
                apart = min(sum(key_cell_cost(row.get(k), member.get(k)) for k in keys) / max(1, len(keys)) for member in cluster)
                unclear = any(len(own := _words_of(row.get(k))) == 1 and (known := _words_of(cluster[0].get(k))) and known != own and known[-1] == own[-1] and shared[n][own[-1]] > 1 for n, k in enumerate(keys))
                cost[i, j] = apart if apart < 1 and not unclear else MISMATCH
        matched = {i: j for i, j in assign(cost) if i < len(table) and j < len(clusters) and cost[i, j] < UNMATCHED}
        for i, row in enumerate(table):
            if i in matched:
                clusters[matched[i]].append(row)
            else:
                clusters.append([row])
    return clusters


def _match_equal(table: Sequence[dict], keys: Sequence[str], clusters: list[list[dict]], places: dict[tuple, int]) -> dict[tuple, int] | None:
    """Adds a table's rows to the clusters of equal keys if no assignment costs as little; else changes nothing and
    returns None.

    That is so if the rows have different keys and all rows or all clusters find an equal: each pair then costs
    nothing, and any other pair something.  A lone key of numbers is equal or not, so there the rest stays alone too."""
    own = [tuple(_key_form(row.get(k)) for k in keys) for row in table]
    distinct = set(own)
    if len(distinct) < len(own):
        return None
    found = len(distinct & places.keys())
    if found < min(len(own), len(places)) and not (len(keys) == 1 and (_no_words(own) or _no_words(places))):
        return None
    for form, row in zip(own, table, strict=True):
        if form in places:
            clusters[places[form]].append(row)
        else:
            places[form] = len(clusters)
            clusters.append([row])
    return places


def _key_form(value: object) -> str | tuple[str, ...] | None:
    """Key cells are equal, at no distance, just if these are: a number's text, the words of other text, or None."""
    cell = canonical_cell(value)
    return cell if cell is None or _is_number(cell) else _key_words(cell)


def _no_words(forms: Iterable[tuple]) -> bool:
    return all(not isinstance(form[0], tuple) for form in forms)


def _words_of(value: object) -> tuple[str, ...]:
    cell = canonical_cell(value)
    return () if cell is None or _is_number(cell) else _key_words(cell)


def vote_by_similar_key(tables: Sequence[Sequence[dict]], keys: Sequence[str], tolerance: float = 0.0) -> list[dict]:
    """Rows that more than half of the tables have, matched by similar keys, every cell voted."""
    need = len(tables) // 2 + 1
    return [{c: vote_cell([r.get(c) for r in rows], tolerance) for c in dict.fromkeys(c for r in rows for c in r)} for rows in cluster_rows(tables, keys) if len(rows) >= need]


def vote_records(votes: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``record_id`` and the voted ``rows`` (JSON objects) of ``votes``: record_id, vote, keys (array) and rows (JSON text
    of a list of objects).  A record's votes, a handful, meet in one row; a task holds one batch of records."""
    kind = votes.schema["record_id"].dataType.simpleString()
    vote = F.struct(F.isnull("vote").alias("last"), F.col("vote"), F.col("keys"), F.col("rows"))
    records = votes.groupBy("record_id").agg(F.array_sort(F.collect_list(vote)).alias("v"))

    def voted(keys: Sequence[str], texts: Sequence[str]) -> str:
        tables = [json.loads(r) for r in texts]
        made = vote_by_similar_key(tables, keys, tolerance) if keys else vote_by_position_of(tables, tolerance)
        return json.dumps(made, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(map(voted, batch.column("keys").to_pylist(), batch.column("rows").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(rows, pa.string())], names=["record_id", "rows"])

    first = F.element_at("v", 1)
    return records.select("record_id", first["keys"].alias("keys"), F.col("v.rows").alias("rows")).mapInArrow(run, f"record_id {kind}, rows string")


def vote_by_position_of(tables: Sequence[Sequence[dict]], tolerance: float = 0.0) -> list[dict]:
    """``vote_by_position`` over tables of objects, with the columns of the first that has any."""
    names = next((list(t[0]) for t in tables if t), [])
    return [dict(zip(names, row, strict=True)) for row in vote_by_position([[[r.get(n) for n in names] for r in t] for t in tables], tolerance)]
