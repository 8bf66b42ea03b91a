"""Row lineage carried through a plan: every output row knows the base rows it came from.

``TracedFrame`` wraps a DataFrame with an array column of base-row ids.  Filters keep it, groups merge the
ids of their rows, joins unite both sides', so one execution yields both answer and lineage.  Id
lists of groups grow with the group; ``long_form`` gives one row an id instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder

#: Name of the lineage column.
PROV = "__prov"


def with_row_ids(df: DataFrame, order: Sequence[str | Column], name: str = "__row") -> DataFrame:
    """Dense ids from 0 in the given full order.

    Rows are range-sorted; a row's id is its place in its partition plus the rows of earlier ones, so no
    single task numbers them all."""
    place = F.monotonically_increasing_id()
    ranked = df.sort(*order).select("*", F.shiftright(place, 33).alias("__part"), place.bitwiseAND((1 << 33) - 1).alias("__nth"))
    folder = scratch_folder(df.sparkSession, "row-ids")
    ranked.write.parquet(folder)  # rows that tie keep their ids whatever is lost later
    marked = df.sparkSession.read.schema(ranked.schema).parquet(folder)
    counts = sorted((r["__part"], r["n"]) for r in marked.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, before = [], 0
    for part, n in counts:
        offsets.append((part, before))
        before += n
    shifts = df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    return marked.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__nth") + F.col("__before")).drop("__part", "__nth", "__before")


def long_group(rows: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """The lineage of groups, one base row a row: group columns and ``row_id``.  No group is gathered, so
    its size doesn't matter; it joins with the groups' results on their columns."""
    return rows.select(*group, F.col(key).alias("row_id"))


@dataclass
class Step:
    """One node of a traced query: its kind, what it did and the frame it left."""

    kind: str
    detail: str
    frame: DataFrame


@dataclass
class TracedFrame:
    frame: DataFrame
    steps: list[Step] = field(default_factory=list)

    @classmethod
    def scan(cls, df: DataFrame, key: str) -> TracedFrame:
        """Base rows, each its own source under ``key``."""
        frame = df.withColumn(PROV, F.array(F.col(key)))
        return cls(frame, [Step("scan", key, frame)])

    def _then(self, kind: str, detail: str, frame: DataFrame) -> TracedFrame:
        return TracedFrame(frame, [*self.steps, Step(kind, detail, frame)])

    def where(self, condition: str | Column) -> TracedFrame:
        return self._then("where", str(condition), self.frame.filter(condition))

    def select(self, *columns: str | Column) -> TracedFrame:
        return self._then("project", ", ".join(map(str, columns)), self.frame.select(*columns, PROV))

    def group(self, keys: Sequence[str], aggregates: Sequence[Column]) -> TracedFrame:
        """Groups with the sorted distinct ids of their rows; without keys one row, even if empty."""
        ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(PROV)))).alias(PROV)
        return self._then("group", ", ".join(keys), self.frame.groupBy(*keys).agg(*aggregates, ids))

    def having(self, condition: str | Column) -> TracedFrame:
        return self._then("having", str(condition), self.frame.filter(condition))

    def order(self, *by: str | Column, limit: int | None = None) -> TracedFrame:
        ordered = self.frame.orderBy(*by)
        return self._then("order", ", ".join(map(str, by)), ordered if limit is None else ordered.limit(limit))

    def join(self, other: TracedFrame, on: str | Sequence[str], how: str = "inner") -> TracedFrame:
        """Rows of both sides with the ids of both."""
        right = other.frame.withColumnRenamed(PROV, "__right")
        none = F.array().cast(self.frame.schema[PROV].dataType)
        both = F.array_union(F.coalesce(PROV, none), F.coalesce("__right", none))
        joined = self.frame.join(right, on, how).withColumn(PROV, F.array_sort(both)).drop("__right")
        return self._then("join", how, joined)

    def window(self, name: str, value: Column) -> TracedFrame:
        """A window column; rows keep their own lineage."""
        return self._then("window", name, self.frame.withColumn(name, value))

    def rows(self) -> DataFrame:
        """Output rows with their ids in ``PROV``."""
        return self.frame

    def answer(self) -> DataFrame:
        return self.frame.drop(PROV)

    def contributing(self) -> DataFrame:
        """Distinct base ids of all output rows, one a row (``row_id``)."""
        return self.frame.select(F.explode(PROV).alias("row_id")).distinct()

    def scanned(self) -> DataFrame:
        """Base ids that the scan read."""
        return self.steps[0].frame.select(F.explode(PROV).alias("row_id"))

    def long_form(self, keys: Sequence[str]) -> DataFrame:
        return self.frame.select(*keys, F.explode(PROV).alias("row_id"))

    def progression(self) -> list[dict[str, object]]:
        """Steps that change rows, with how many they left; counted in one job each."""
        shown = [s for s in self.steps if s.kind != "scan" and not (s.kind == "group" and not s.detail)]
        return [{"step": s.kind, "detail": s.detail, "rows": s.frame.count()} for s in shown]
