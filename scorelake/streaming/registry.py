"""First-wins registry of fingerprints over a stream, with bounded state.

Each scope keeps its latest distinct fingerprints in the order they came in, as a checkpointed state of the
query: a stream that is stopped and started again goes on as one that never stopped.  Beyond the capacity
the oldest fingerprint is forgotten, so state doesn't grow with the stream; one that was forgotten counts as
new when it comes again.

Scopes are split by a hash of the fingerprint into ``shards`` registries of their own, so that a scope that
holds most rows spans tasks; equal fingerprints meet in one shard.  The capacity is that of a shard.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "prints array<string>, places array<bigint>, seen bigint"


class Recent:
    """The latest distinct fingerprints, oldest first, each with the place at which it came in."""

    def __init__(self, capacity: int, prints: Sequence[str] = (), places: Sequence[int] = (), seen: int = 0) -> None:
        self.capacity, self.seen = capacity, seen
        self.held = dict(zip(prints, places, strict=True))

    def add(self, fingerprint: str | None) -> tuple[bool, int | None]:
        """Whether it is new, and the place of the one it repeats; without a fingerprint it is always new."""
        place, self.seen = self.seen, self.seen + 1
        if not fingerprint:
            return True, None
        if fingerprint in self.held:
            return False, self.held[fingerprint]
        self.held[fingerprint] = place
        if len(self.held) > self.capacity:
            del self.held[next(iter(self.held))]
        return True, None

    def state(self) -> tuple[list[str], list[int], int]:
        return list(self.held), list(self.held.values()), self.seen


def admit(records: DataFrame, scope: Sequence[str], fingerprint: str, order: str, capacity: int = 10_000, shards: int = 1) -> DataFrame:
    """``scope``, ``shard``, ``order``, ``fingerprint``, ``kept`` and ``repeats`` (the place, within its shard, of the row it
    repeats) of every row of a stream; write in append mode.

    Rows of one batch are taken by ``order``, then fingerprint; earlier batches come first.  Rows whose fingerprint
    is null or empty are kept.  A null scope or order value is a value like others, the latter before the rest."""
    kinds = dict(records.dtypes)
    keyed = records.select(*scope, F.pmod(F.xxhash64(fingerprint), F.lit(shards)).cast("int").alias("shard"), order, fingerprint)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in scope) + f", shard int, `{order}` {kinds[order]}, `{fingerprint}` string, kept boolean, repeats bigint"

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = Recent(capacity, *state.get) if state.exists else Recent(capacity)
        rows = pd.concat(list(batches), ignore_index=True).sort_values([order, fingerprint], na_position="first", kind="stable")
        found = [recent.add(None if pd.isna(p) else p) for p in rows[fingerprint]]
        state.update(recent.state())
        yield rows.assign(kept=[k for k, _ in found], repeats=pd.array([r for _, r in found], dtype="Int64"))

    return keyed.groupBy(*scope, "shard").applyInPandasWithState(take, schema, STATE, "append", GroupStateTimeout.NoTimeout)
