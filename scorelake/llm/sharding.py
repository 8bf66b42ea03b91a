"""Sharding: minimax contiguous partition of atomic groups.

Equal texts form a group, groups are ordered by content digest, and each shard takes a contiguous
run of groups.  The shard capacity is the smallest for which a greedy fill needs no more than the
given number of shards, found by binary search.  A group larger than the mean shard has one to itself, and
the groups on either side of it are partitioned in the same way among the other shards.

The driver never holds all groups.  It works on blocks of the digest order (sum and largest group of
each): a fill that may cut anywhere in a block and one that may not cut in it bound both the
capacity and each cut, and only blocks in which a cut can still fall are split into finer ones, until
they are single groups.

Defined cases: null text is a group with the empty text (0 bytes, size 1); repeated rows and null
ids are rows like others, ordered by id with nulls first; an empty table gives an empty result; shards
stay empty only where there are fewer groups to part; other columns are ignored.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Hex digits of the digest that make the first blocks, and those that split a block further.
FIRST_DIGITS, MORE_DIGITS = 3, 2


@dataclass
class Block:
    """Groups whose digests start with ``prefix``: their number, total and largest size."""

    prefix: str
    groups: int
    total: int
    largest: int


def fill(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of a greedy fill over ordered sizes with prefix sums ``sums`` (sums[0] = 0),
    None if ``shards`` shards of ``capacity`` don't hold them."""
    cuts, at, n = [], 0, len(sums) - 1
    while at < n:
        end = bisect.bisect_right(sums, sums[at] + capacity, lo=at) - 1
        if end == at or len(cuts) == shards:
            return None
        cuts.append(end)
        at = end
    return cuts


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least capacity for which ``fill`` succeeds, by binary search."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    low, high = max(max(sizes, default=0), -(-sums[-1] // shards)), sums[-1]
    while low < high:
        middle = (low + high) // 2
        if fill(sums, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _open_blocks(blocks: list[Block], shards: int) -> list[int]:
    """Indices of blocks of several groups in which a cut of the best fill may fall.

    The best capacity lies between ``low`` (no capacity below it is feasible) and ``high`` (feasible
    without cutting a block), and each cut moves one way with the capacity: ``floor`` fills ``low``
    and gives up as much as a group of the block it ends in, ``ceiling`` fills ``high`` exactly.
    """
    sums = [0]
    for b in blocks:
        sums.append(sums[-1] + b.total)
    total = sums[-1]
    low, high = max(max((b.largest for b in blocks), default=0), -(-total // shards)), smallest_capacity([b.total for b in blocks], shards)
    found: set[int] = set()
    floor = ceiling = 0
    while floor < total:
        reach = bisect.bisect_right(sums, floor + low) - 1
        floor = total if reach == len(blocks) else max(sums[reach], floor + low - blocks[reach].largest + 1 if blocks[reach].groups > 1 else 0)
        last = bisect.bisect_right(sums, ceiling + high) - 1
        ceiling = total if last == len(blocks) else ceiling + high if blocks[last].groups > 1 else sums[last]
        found.update(range(bisect.bisect_right(sums, floor) - 1, min(bisect.bisect_left(sums, ceiling), len(blocks))))
    return sorted(i for i in found if blocks[i].groups > 1)


def _one_capacity(blocks: list[Block], shards: int) -> tuple[int, list[int], set[int]]:
    """``_solve`` with one capacity for all shards."""
    sizes = [b.total for b in blocks]
    capacity, sums = smallest_capacity(sizes, shards), [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    return capacity, (fill(sums, capacity, shards) or [])[:-1], set(_open_blocks(blocks, shards))


def _solve(blocks: list[Block], shards: int) -> tuple[int, list[int], set[int]]:
    """Largest shard, the indices at which shards but the first start, and the blocks that must be split into
    finer ones before these are certain.

    A group larger than the mean of the shards that are left binds the capacity, which says nothing about the
    rest: it gets a shard of its own.  The runs between such groups share the other shards, the next always
    going to the run of the largest mean, and each run has its own least capacity.  Where there are too few
    shards for that, or the largest shard would grow, one capacity is used for all."""
    if not blocks:
        return 0, [], set()
    hot: list[int] = []
    for i in sorted(range(len(blocks)), key=lambda i: -blocks[i].largest):
        left = sum(b.total for b in blocks) - sum(blocks[h].largest for h in hot)
        if len(hot) + 1 >= shards or blocks[i].largest * (shards - len(hot)) <= left:
            break
        hot.append(i)
    plain = _one_capacity(blocks, shards)
    if not hot:
        return plain
    if coarse := {i for i in hot if blocks[i].groups > 1}:
        return plain[0], plain[1], coarse
    hot.sort()
    runs = [(a, b) for a, b in zip([0, *(h + 1 for h in hot)], [*hot, len(blocks)], strict=True) if a < b]
    totals = [sum(b.total for b in blocks[a:b]) for a, b in runs]
    given = [1] * len(runs)
    if len(hot) + len(runs) > shards:
        return plain
    while runs and len(hot) + sum(given) < shards:
        given[max(range(len(runs)), key=lambda i: totals[i] / given[i])] += 1
    solved = [_one_capacity(blocks[a:b], n) for (a, b), n in zip(runs, given, strict=True)]
    biggest = max(blocks[h].total for h in hot)
    largest = max([biggest, *(s[0] for s in solved)])
    needed = {a + i for (a, _), s in zip(runs, solved, strict=True) for i in s[2]}
    if not needed and largest > biggest and (plain[2] or largest > plain[0]):
        return plain  # one capacity may be lower; that is certain once its blocks are fine
    starts = set(hot) | {a for a, _ in runs} | {a + c for (a, _), s in zip(runs, solved, strict=True) for c in s[1]}
    return largest, sorted(starts - {0}), needed


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """Largest shard and, for each shard but the first, the digest prefix at which it starts.

    ``groups`` has one row a group: ``digest`` and ``size``.  The blocks collected depend on the
    number of shards, not on that of groups: a cut's range spans few blocks at every level.
    """

    def blocks_of(rows: DataFrame, digits: int) -> list[Block]:
        made = rows.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.max("size").alias("largest"))
        return [Block(*r) for r in made.collect()]

    blocks = sorted(blocks_of(groups, FIRST_DIGITS), key=lambda b: b.prefix)
    while open_ := _solve(blocks, shards)[2]:
        prefixes = {blocks[i].prefix for i in open_}
        finer = []
        for n in sorted({len(p) for p in prefixes}):
            own = [p for p in prefixes if len(p) == n]
            finer += blocks_of(groups.filter(F.substring("digest", 1, n).isin(own)), n + MORE_DIGITS)
        blocks = sorted([b for b in blocks if b.prefix not in prefixes] + finer, key=lambda b: b.prefix)
    largest, cuts, _ = _solve(blocks, shards)
    return largest, [blocks[c].prefix for c in cuts]


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``digest``, ``shard`` and ``slot``
    (gapless from 0 within a shard) for every row of ``docs``.

    Texts stay in the scan; narrow rows are range-sorted by (digest, id), which splits hot groups, and
    a row's slot is its place in its partition plus what earlier partitions hold of its shard.
    """
    spark = docs.sparkSession
    parts = store.default_parallelism(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col), F.md5(text.cast("binary")).alias("digest"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    place = F.monotonically_increasing_id()
    ranked = narrow.repartitionByRange(parts, "digest", id_col, place).sortWithinPartitions("digest", id_col)
    rows, _ = store.write_table(ranked.withColumn("part", F.shiftright(place, 33).cast("int")).withColumn("nth", place.bitwiseAND((1 << 33) - 1)), "shard-rows")

    groups, groups_uri = store.write_table(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    _, starts = plan_cuts(groups, shards)
    store.drop(spark, groups_uri)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("digest") >= start).cast("int")
    rows = rows.withColumn("shard", shard)

    # one row for each partition and shard that meet: at most partitions + shards
    met = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = met.select("shard", "part", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(F.broadcast(offsets), ["shard", "part"]).select(id_col, "size", "text_crc32", "digest", "shard", (F.col("nth") + F.col("shift")).alias("slot"))
