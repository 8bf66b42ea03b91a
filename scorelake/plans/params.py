"""Seeded parameter sampling for templates, from frequency tables that Spark has aggregated.

The driver sees distinct entities with counts and bounds, never event rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal

#: Share of picks from the more frequent half.
TOP_SHARE = 0.6


@dataclass
class Profile:
    """What sampling needs of one source: entities by falling frequency, pairs, and bounds of the field."""

    entities: dict[str, list[tuple[str, int]]]
    pairs: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    bounds: dict[tuple, tuple[float, float]] = field(default_factory=dict)


def profile(df: DataFrame, first: str = "batsman", second: str = "bowler", at: str = "overs") -> Profile:
    """Frequencies of two entity columns, of the second given the first, and the field's bounds."""
    sets = df.groupingSets([[first, second], [first], [second], []], first, second) if hasattr(df, "groupingSets") else df.cube(first, second)
    rows = sets.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"), F.grouping(first).alias("g1"), F.grouping(second).alias("g2")).collect()
    out = Profile({first: [], second: []})
    for r in sorted(rows, key=lambda r: (-r["n"], str(r[first]), str(r[second]))):
        a, b = (None if r["g1"] else r[first]), (None if r["g2"] else r[second])
        if r["low"] is not None and r["low"] < r["high"]:
            out.bounds[a, b] = (r["low"], r["high"])
        if r["g2"] and a is not None:
            out.entities[first].append((a, r["n"]))
        elif r["g1"] and b is not None:
            out.entities[second].append((b, r["n"]))
        elif a is not None and b is not None:
            out.pairs.setdefault(a, []).append((b, r["n"]))
    return out


def tiers(counts: Sequence[tuple[str, int]]) -> tuple[list[str], list[str], list[str]]:
    """Top half, bottom half (rarest first) and middle of entities given by falling frequency."""
    names = [n for n, _ in counts]
    half = max(1, len(names) // 2) if names else 0
    top, bottom = names[:half], names[::-1][:half]
    return top, bottom, [n for n in names if n not in {*top, *bottom}]


def spectrum(counts: Sequence[tuple[str, int]], k: int, share: float = TOP_SHARE) -> list[str]:
    """``k`` entities, a share from the top tier and the rest from the bottom; tiers are cycled once
    every member has been taken."""
    top, bottom, middle = tiers(counts)
    need = math.ceil(k * share)
    out = [pool[i % len(pool)] for pool, n in ((top, need), (bottom, k - need)) if pool for i in range(n)]
    out += middle[: k - len(out)]
    return (out + [n for n, _ in counts])[:k]


def spectrum_pairs(counts: Sequence[tuple[str, int]], k: int, share: float = TOP_SHARE) -> list[tuple[str, str]]:
    """Pairs of different entities wherever there are two."""
    single = spectrum(counts, 2 * k, share)
    out = []
    for i in range(0, len(single) - 1, 2):
        j = next((j for j in range(i + 1, len(single)) if single[j] != single[i]), None)
        if j is not None:
            single[i + 1], single[j] = single[j], single[i + 1]
        other = single[i + 1] if single[i + 1] != single[i] else next((n for n, _ in counts if n != single[i]), single[i])
        out.append((single[i], other))
    return out


def sample(p: Profile, variables: Sequence[str], n: int, seed: int, first: str = "batsman", second: str = "bowler") -> list[dict[str, object]]:
    """``n`` parameter sets for a template's variables; the same seed gives the same sets."""
    if not variables or n <= 0:
        return [{"table_name": "df"}]
    rng, out = random.Random(seed), []
    singles = {c: spectrum(p.entities[c], n) for c in (first, second)}
    doubles = {c: spectrum_pairs(p.entities[c], n) for c in (first, second)}
    for i in range(n):
        params: dict[str, object] = {"table_name": "df"}
        for c in (first, second):
            if f"{c}1" in variables and f"{c}2" in variables and doubles[c]:
                params[f"{c}1"], params[f"{c}2"] = doubles[c][i % len(doubles[c])]
            elif c in variables and singles[c]:
                params[c] = singles[c][i % len(singles[c])]
        if first in params and second in params and (met := p.pairs.get(params[first])):
            given = spectrum(met, n)
            params[second] = given[i % len(given)]
        if "temporal_predicate" in variables or {"x1", "x2"} <= set(variables):
            params |= temporal_parameters(p.bounds.get((params.get(first), params.get(second))), rng, "CEIL(overs)" if "ceil" in variables else "t.overs" if "t" in variables else "overs")
        out.append(params)
    return out


def temporal_parameters(bounds: tuple[float, float] | None, rng: random.Random, field_name: str = "overs") -> dict[str, str]:
    """Predicate, wording and name of a random relation between two legal points within ``bounds``."""
    if bounds is None:
        return {"temporal_predicate": "(1=1)", "temporal_phrase": "the entire match", "temporal_relation": "none"}
    relation = rng.choice(sorted(temporal.RELATIONS))
    a, b = sorted(temporal.snap_over_ball(rng.uniform(*bounds)) for _ in range(2))
    if a == b:
        a, b = sorted((a, temporal.snap_over_ball(rng.uniform(*bounds))))
    sql, words = temporal.phrase(relation, a, b, field_name)
    return {"temporal_predicate": sql, "temporal_phrase": words, "temporal_relation": relation}


def pick_bucket(rng: random.Random, buckets: Sequence[str], turns: dict[str, int] | None = None, key: str = "") -> str:
    """A random bucket, or with ``turns`` the next one of ``key``'s round."""
    if turns is None:
        return rng.choice(list(buckets))
    turns[key] = turns.get(key, -1) + 1
    return buckets[turns[key] % len(buckets)]


def diverse(bank: Sequence[Mapping[str, object]], k: int, avoid: Sequence[str] = (), seed: int = 0, category: str = "category") -> list[Mapping[str, object]]:
    """``k`` templates, of as many categories as possible, avoided ones last."""
    rng = random.Random(seed)
    by: dict[object, list] = {}
    for t in rng.sample(list(bank), len(bank)):
        by.setdefault(t.get(category), []).append(t)
    order = sorted(by, key=lambda c: (c in avoid, rng.random()))
    rounds = max(map(len, by.values()), default=0)
    return [by[c][r] for r in range(rounds) for c in order if r < len(by[c])][:k]
