"""Which template is asked of which source: a schedule that covers both, as a table, and entities for its turns.

Templates and sources are numbered from range-sorted places.  The ``use``-th turn of template ``i`` goes to source
``i + use`` (modulo the sources), so how often a source is used follows from its place alone, and the sources
that come short get further turns with drawn templates.  Everything else is an equi-join.

Defined cases: without templates or without sources there is no turn; ids are distinct (repeated ones and nulls count
once and not at all); a source without entities leaves its turns' entity null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import with_row_ids

#: Percentage of a source's turns that ask for its more frequent half of entities.
TOP_PERCENT = 60


def draw(parts: list[Column], below: Column) -> Column:
    """A number from 0 on, below ``below``, that depends on ``parts`` alone (60 bits of their MD5)."""
    digest = F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % below


def _numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    return with_row_ids(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], name)


def coverage(templates: DataFrame, sources: DataFrame, template: str, source: str, uses: int = 2, source_uses: int = 1, seed: int = 0) -> DataFrame:
    """``turn`` (from 0, in a drawn order), ``template``, ``source``, ``slot`` (number of the turn among its source's, not
    gapless) and ``forced`` (false for turns that only the source needs): every template in ``uses`` turns at
    least, every source in ``source_uses``."""
    uses, source_uses = max(1, uses), max(1, source_uses)
    t, s = _numbered(templates, template, "__t"), _numbered(sources, source, "__s")
    n, m = t.count(), s.count()
    if not n or not m:
        return t.select(F.lit(0).cast("bigint").alias("turn"), template).join(s.select(source), F.lit(False)).withColumns({"slot": F.lit(0).cast("bigint"), "forced": F.lit(True)})
    use, nth = F.col("__use").cast("bigint"), F.col("__nth").cast("bigint")
    forced = t.withColumn("__use", F.explode(F.sequence(F.lit(0), F.lit(uses - 1)))).withColumn("__s", (F.col("__t") + use) % m)
    forced = forced.select(template, "__t", "__s", (F.floor(F.col("__t") / m) * uses + use).alias("slot"), F.lit(True).alias("forced"))
    # templates i with (i + use) % m = s are r, r + m, r + 2m, ... below n, where r = (s - use) mod m
    used = sum((F.greatest(F.floor((n - 1 - F.pmod(F.col("__s") - u, F.lit(m))) / m) + 1, F.lit(0)) for u in range(uses)), F.lit(0))
    short = s.withColumn("__nth", F.explode(F.when(used < source_uses, F.sequence(F.lit(1).cast("bigint"), source_uses - used))))
    short = short.select(source, "__s", draw([F.lit(seed), F.col("__s"), F.col("__nth")], F.lit(n)).alias("__t"), (uses * (n // m + 1) + nth).alias("slot"), F.lit(False).alias("forced"))
    columns = [template, source, "__t", "__s", "slot", "forced"]
    turns = forced.join(s, "__s").select(*columns).unionByName(short.join(t, "__t").select(*columns))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in ("__t", "__s", "slot"))))
    return with_row_ids(turns.withColumn("__order", order), ["__order", "__t", "__s", "slot"], "turn").select("turn", template, source, "slot", "forced")


def with_entity(schedule: DataFrame, events: DataFrame, source: str, entity: str, top_percent: int = TOP_PERCENT) -> DataFrame:
    """``schedule`` with an ``entity`` of its source: ``top_percent`` of any run of slots take the more frequent half in
    turn (ties by name), the others the less frequent half, rarest first."""
    counts = events.filter(F.col(entity).isNotNull() & F.col(source).isNotNull()).groupBy(source, entity).agg(F.count(F.lit(1)).alias("__n"))
    placed = with_row_ids(counts, [F.col(source), F.col("__n").desc(), F.col(entity)], "__place").select(source, entity, "__place")
    spans = placed.groupBy(source).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__size"))
    slot, size = F.col("slot"), F.col("__size")
    before = F.floor(slot * top_percent / 100)
    is_top = F.floor((slot + 1) * top_percent / 100) > before
    half = F.greatest(F.floor(size / 2), F.lit(1))
    chosen = F.when(is_top, before % half).otherwise(size - 1 - (slot - before) % half)
    asked = schedule.join(spans, source, "left").withColumn("__place", F.col("__first") + chosen).drop("__first", "__size")
    return asked.join(placed.select("__place", entity), "__place", "left").drop("__place")
