"""Structured Streaming over event logs: running order totals and bounded deduplication.

These are extensions of the batch operators: the same signed amounts, kept up to date as events
arrive, and first-wins deduplication whose state a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sessions


def running_totals(events: DataFrame, keys: tuple[str, ...] = ("session_id", "product_id")) -> DataFrame:
    """Quantity and revenue so far by ``keys``; write in complete or update mode."""
    return sessions.signed(events).groupBy(*keys).agg(F.round(F.sum("signed_qty"), 2).alias("quantity"), F.round(F.sum("amount"), 2).alias("revenue"))


def windowed_totals(events: DataFrame, at: str, width: str, late: str, keys: tuple[str, ...] = ("product_id",)) -> DataFrame:
    """Revenue by time window; events later than ``late`` behind the newest are dropped by the watermark."""
    stream = sessions.signed(events).withWatermark(at, late)
    totals = stream.groupBy(F.window(at, width), *keys).agg(F.sum("amount").alias("revenue"), F.count(F.lit(1)).alias("events"))
    return totals.select(F.col("window.start").alias("window_start"), *keys, "revenue", "events")


def first_seen(records: DataFrame, fingerprint: str, at: str, keep: str) -> DataFrame:
    """First record of each fingerprint within ``keep`` of event time; state is dropped after that."""
    return records.withWatermark(at, keep).dropDuplicatesWithinWatermark([fingerprint])
