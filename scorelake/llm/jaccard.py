"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct word shingles, ordered rare first.  Documents that link share at
least ``m`` tokens of their ``m``-prefixes (the first ``n - ceil(t n) + m`` tokens), for every ``m``.  Each document
chooses its ``m``: it lengthens its prefix where its tokens' estimated frequencies promise many
candidates, and a pair must share as many prefix tokens as the smaller choice of the two before it
is verified.  Frequencies, counted over all distinct sets, only order tokens and price prefixes, so
rounding them can't lose a link.

Equal sets form a class and are joined once.  Within a class graph only connectivity is asked for,
so no group is expanded into all its pairs: in each round the documents of a prefix token are
compared with a few hubs, what links is contracted, and only pairs of different components go on;
then those are listed and verified all.  No candidate is left out.

Defined cases: null and wordless texts have the empty set and link with nothing; a text of fewer
words than a shingle is one shingle; repeated rows and equal sets share a component; null ids never name a
component while it has another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import components, store, textbuf

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 4, 85
#: Longest multi-match a document may choose, and what verifying a candidate costs in prefix tokens.
MOST_MATCHES, VERIFY_COST = 4, 8
#: Tokens of a counting bucket, about, and of a task's block of them.
BUCKET_TOKENS, BLOCK_TOKENS = 1 << 21, 1 << 20
#: Cells of the table of frequency levels (a byte each, broadcast): as powers of two, least and most, and
#: how many cells a token in it has.  Tokens of at least 2 ** LEAST_LEVEL sets get into it; if the cells
#: don't do for them, those of the highest levels.
LEAST_CELLS, MOST_CELLS, SPARSE, LEAST_LEVEL = 16, 25, 8, 2
#: Rows of a frequent token that share a salt.
SALTED = 4096
#: Hub rounds at most before all remaining pairs are listed; listed earlier if the prefix tokens' pairs
#: are no more than this many for each prefix token.
ROUNDS, LIST_RATIO = 2, 16
#: Hubs of a token in a round, and of them how many a document is verified against.
HUBS, VERIFIED = 4, 3
#: Names that clash, at most; about a thousand are expected in 5 * 10^10 sets.
MOST_CLASHES = 20_000
#: Most keys that are broadcast; beyond it the same join is shuffled.
BROADCAST_KEYS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def shingle_sets(offsets: np.ndarray, raw: np.ndarray, size: int = SHINGLE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each row: their 64-bit tokens, sorted, and a second hash of each."""
    starts, ends, first = textbuf.words(offsets, raw)
    lowered = _LOWER[raw]
    h = [textbuf.word_hashes(lowered, starts, ends, which) for which in (0, 1)]
    full = [textbuf.window_hashes(h[which], size, which) for which in (0, 1)]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            tokens, where = np.unique(full[0][a : b - size + 1], return_index=True)
            out.append((tokens, full[1][a + where]))
        elif b > a:  # the whole sequence; its length keeps it apart from longer ones
            out.append(tuple(textbuf.mix(textbuf.window_hashes(h[which][a:b], int(b - a), which) + np.uint64(b - a)) for which in (0, 1)))
        else:
            out.append((np.empty(0, dtype=np.uint64),) * 2)
    return out


def _least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def choose_prefix(counts: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(matches, prefix length) of a document of ``n`` tokens with estimated frequencies ``counts`` in
    order: the cheapest of the lengthened prefixes, by tokens listed plus candidates to verify."""
    need = _least_overlap(n, percent)
    base = n - need
    best = None
    for m in range(1, min(MOST_MATCHES, need) + 1):
        cost = base + m + VERIFY_COST * float(np.maximum(counts[: base + m] - 1, 0).sum()) / m
        if best is None or cost < best[0]:
            best = (cost, m)
    return best[1], base + best[1]


def similar(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sets of shingles; equal are those of which
    both hashes are."""
    n, k = len(x[0]), len(y[0])
    if 100 * min(n, k) < percent * max(n, k) or not n:
        return False
    _, at, to = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    both = int((x[1][at] == y[1][to]).sum())
    return 100 * both >= percent * (n + k - both)


def text_key(id_: Column, text: Column) -> tuple[Column, Column]:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), F.coalesce(id_.cast("string"), F.lit("")).alias("row")


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _profile(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """One row a document: set size and digest."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, raw in textbuf.slices(batch.column(3)):
                sets = shingle_sets(offsets, raw, size)
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), pa.array([len(s[0]) for s in sets], pa.int64()), pa.array([_set_digest(s) for s in sets], pa.string())], [id_col, "digest", "row", "n", "set"])

    digest, row = text_key(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col), digest, row, F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, digest string, row string, n bigint, set string")


def _set_digest(tokens: tuple[np.ndarray, np.ndarray]) -> str:
    return hashlib.md5(tokens[0].tobytes() + tokens[1].tobytes()).hexdigest()


@dataclass(frozen=True)
class Levels:
    """Binary orders of magnitude of tokens' frequencies, in cells that tokens are hashed to.

    A rare token may share a cell with a frequent one; the order of tokens stays the same for all sets.
    """

    cells: np.ndarray
    kept_bits: int

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        return np.int64(1) << self.cells[_cell(tokens >> np.uint64(64 - self.kept_bits), len(self.cells))].astype(np.int64)


def _cell(kept: np.ndarray, cells: int) -> np.ndarray:
    return (textbuf.mix(kept) & np.uint64(cells - 1)).astype(np.int64)


def _summed(low: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([*low, np.empty(0, dtype=low[0].dtype)]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate(times), minlength=len(keys)).astype(np.int64)


def count_levels(texts: DataFrame, tokens: int, size: int) -> Levels:
    """Frequency levels over the sets of ``texts`` (column text), which hold about ``tokens`` tokens.

    Every token is counted.  Tasks sum blocks of tokens and deal them out to buckets by the first bits,
    with the 32 bits that follow; a bucket is counted in one task and has about ``BUCKET_TOKENS`` tokens.
    The driver gets no more than what fills the table.
    """
    spark = texts.sparkSession
    parts = store.default_parallelism(spark)
    bits = min(32, max((tokens // BUCKET_TOKENS).bit_length() + 1, (4 * parts).bit_length()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[np.ndarray]) -> pa.RecordBatch:
            every, k = np.unique(np.concatenate(held), return_counts=True)
            bucket = (every >> np.uint64(64 - bits)).astype(np.int64)
            low = (every >> np.uint64(32 - bits)).astype(np.uint32)
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            out: list[list] = [[], [], []]
            for a, b in zip(edges, np.append(edges[1:], len(every)), strict=True):
                often = k[a:b] > 1
                for column, x in zip(out, (low[a:b][~often], low[a:b][often], k[a:b][often].astype(np.uint32)), strict=True):
                    column.append(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges]), *(pa.array(x, pa.binary()) for x in out)], ["bucket", "once", "more", "times"])

        held, n = [], 0
        for batch in batches:
            for _, _, offsets, raw in textbuf.slices(batch.column(0)):
                held += (own := [s[0] for s in shingle_sets(offsets, raw, size)])
                n += sum(map(len, own))
                if n >= BLOCK_TOKENS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(bucket: int, low: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
            often = k >= 1 << LEAST_LEVEL
            kept = np.uint64(bucket) << np.uint64(32) | low[often].astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64)), pa.array(np.log2(k[often]).astype(np.int8))], ["kept", "level"])

        last, low, times = None, [], []
        for batch in batches:
            for bucket, *blobs in zip(batch.column(0).to_pylist(), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                once, more, k = (np.frombuffer(x, np.uint32) for x in blobs)
                if bucket != last and low:
                    yield counted(last, *_summed(low, times))
                    low, times = [], []
                last = bucket
                low += [once, more]
                times += [np.ones(len(once), dtype=np.int64), k.astype(np.int64)]
                if sum(map(len, low)) > 4 * BUCKET_TOKENS and len(low) > 2:  # a hot bucket's blocks are summed as they come
                    low, times = ([x] for x in _summed(low, times))
        if low:
            yield counted(last, *_summed(low, times))

    dealt = texts.mapInArrow(deal, "bucket bigint, once binary, more binary, times binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    often, uri = store.write_table(dealt.mapInArrow(count, "kept bigint, level tinyint"), "jaccard-levels")
    room, least, need = (1 << MOST_CELLS) // SPARSE, LEAST_LEVEL, 0
    for level, k in sorted(((r.level, r.k) for r in often.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True):
        if need + k > room:
            least = level + 1
            break
        need += k
    table = np.zeros(1 << min(MOST_CELLS, max(LEAST_CELLS, (SPARSE * need).bit_length())), dtype=np.int8)
    size_of = len(table)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = _cell(batch.column(0).to_numpy().view(np.uint64), size_of).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (cell, batch.column(1).to_numpy())], ["cells", "levels"])

    for r in often.filter(F.col("level") >= least).mapInArrow(pack, "cells binary, levels binary").collect():
        np.maximum.at(table, np.frombuffer(r.cells, np.int32), np.frombuffer(r.levels, np.int8))
    store.drop(spark, uri)
    return Levels(table, 32 + bits)


def _node(digest: str, moved: dict[str, int]) -> int:
    """64-bit name of a set; the few sets whose names would clash have others in ``moved``."""
    return moved.get(digest) if digest in moved else int(digest[:15], 16)


def _prefixes(texts: DataFrame, sent: Broadcast[Levels], moved: dict[str, int], size: int, percent: int) -> DataFrame:
    """Prefix tokens of ``texts`` (column text): token, salt, node, n, most (matches chosen), place (in
    the document's order; the prefix for m matches ends at ``n - least overlap + m``), even and odd (parities
    of the numbers of the set's tokens that fall to each of 2 * 64 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            for _, _, offsets, raw in textbuf.slices(batch.column(0)):
                out: list[list[np.ndarray]] = [[] for _ in range(8)]
                for both in shingle_sets(offsets, raw, size):
                    tokens = both[0]
                    n = len(tokens)
                    if not n:
                        continue
                    node = _node(_set_digest(both), moved)
                    counts = levels.counts(tokens)
                    order = np.argsort(counts, kind="stable")  # tokens are sorted: ties go by hash
                    m, length = choose_prefix(counts[order], n, percent)
                    chosen = order[:length]
                    bits, half = np.uint64(1) << (both[1] >> np.uint64(1) & np.uint64(63)), both[1] & np.uint64(1) == 1
                    even, odd = (np.bitwise_xor.reduce(bits[own], initial=np.uint64(0)).view(np.int64) for own in (~half, half))
                    salts = counts[chosen] // SALTED + 1
                    for column, value in zip(out, (tokens[chosen].view(np.int64), (np.uint64(node & 0x7FFFFFFF) % salts.astype(np.uint64)).astype(np.int32) + (salts > 1), np.full(length, node), np.full(length, n, dtype=np.int32), np.full(length, m, dtype=np.int8), np.arange(length, dtype=np.int32), np.full(length, even), np.full(length, odd)), strict=True):
                        column.append(value)
                if out[0]:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int8(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(out, kinds, strict=True)], ["token", "salt", "node", "n", "most", "place", "even", "odd"])

    return texts.mapInArrow(run, "token bigint, salt int, node bigint, n int, most tinyint, place int, even bigint, odd bigint")


def _shared_only(prefixes: DataFrame) -> DataFrame:
    """Rows of tokens that more than one row has; those of salted tokens pass.  One shuffle, streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # the last token so far; its row if that is its only one
        for batch in batches:
            token, salt = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            keep = (salt > 0) | np.append(token[0] == last, same) | np.append(same, False)
            if held is not None and token[0] == last:
                yield held
            alone = not keep[-1]
            last, held = token[-1], batch.slice(len(token) - 1) if alone else None
            yield batch.filter(pa.array(keep))

    parts = store.default_parallelism(prefixes.sparkSession)
    return prefixes.repartition(parts, "token", "salt").sortWithinPartitions("token").mapInArrow(run, prefixes.schema)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by their whole texts."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("b_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            names = [batch.column(i).to_numpy() for i in (0, 1)]
            good = []
            for a, b, offsets, raw in textbuf.slices(batch.column(3)):
                for i, own in enumerate(shingle_sets(offsets, raw, size), a):
                    if names[0][i] != hub:
                        (_, _, o, r), = textbuf.slices(batch.column(2)[i : i + 1])
                        hub, hub_set = names[0][i], shingle_sets(o, r, size)[0]
                    if similar(hub_set, own, percent):
                        good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return pairs.join(two, "b").join(one, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def _matching(percent: int) -> Column:
    """Condition on a shared token's row of both documents.

    Both are in the prefixes for m matches, and the first m shared tokens of similar documents
    leave room for the overlap that the two sizes need: at most m - 1 before and what follows.  Tokens
    that only one of them has are no fewer than the bits in which their parities differ.
    """
    m = "least(a_most, b_most)"
    prefixes = " AND ".join(f"{s}_place < {s}_n - ceil({percent} * {s}_n / 100) + {m}" for s in "ab")
    needed = f"ceil({percent} * (a_n + b_n) / {100 + percent})"
    return F.expr(f"{prefixes} AND least({m} - 1, a_place, b_place) + least(a_n - a_place, b_n - b_place) >= {needed} AND bit_count(a_even ^ b_even) + bit_count(a_odd ^ b_odd) <= a_n + b_n - 2 * {needed}")


def _counted(rows: DataFrame) -> DataFrame:
    """Pairs with the number of matching tokens they share and the number they need."""
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("a_most", "b_most")).alias("m"))


def _side(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("token", *(F.col(c).alias(name if c == "node" else f"{name}_{c}") for c in ("node", "n", "most", "place", "even", "odd", "comp")))


def _links(prefixes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Labels (node, comp) of the components of ``prefixes``' nodes with any link."""
    spark = prefixes.sparkSession
    matching = _matching(percent)
    found, labels = None, None
    links, old = [], []  # tables that end with the last round, and with the next
    rows = prefixes.withColumn("comp", F.col("node"))
    for number in range(ROUNDS + 1):
        if labels is not None:
            rows = prefixes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        spread = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
        spread = spread.groupBy("token").agg(F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("within"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
        open_, open_uri = store.write_table(spread.select("token", ((F.col("all") * F.col("all") - F.col("within")) / 2).cast("double").alias("pairs"), "all"), "jaccard-open")
        total = open_.agg(F.sum("pairs"), F.sum("all")).first()
        if total[0] is None:
            break
        rows, rows_uri = store.write_table(rows.join(open_.select("token"), "token"), "jaccard-rows")
        listing = number == ROUNDS or (number > 0 and total[0] <= LIST_RATIO * total[1])
        if listing:
            two = _side(rows, "b").withColumnRenamed("token", "other")
            same = (F.col("token") == F.col("other")) & (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & matching
            pairs = _counted(_side(rows, "a").join(two, same)).filter("shared >= m").select("a", "b")
        else:
            # the documents of each token with the fewest rarer ones, which is what a group has in common
            central = Window.partitionBy("token").orderBy("place", F.xxhash64("node", F.lit(number)))
            hubs = rows.withColumn("nth", F.row_number().over(central)).filter(F.col("nth") <= HUBS)
            hubs = _side(hubs, "a").withColumnRenamed("token", "other")
            same = (F.col("token") == F.col("other")) & (F.col("a_comp") != F.col("b_comp")) & matching
            pairs = _counted(_side(rows, "b").join(hubs, same)).filter("a <> b")
            # the hubs with which a document shares most; others have their turn in later rounds
            best = Window.partitionBy("b").orderBy(F.desc("shared"), F.xxhash64("a", "b"))
            pairs = pairs.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= VERIFIED).select("a", "b")
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs, pairs_uri = store.write_table(pairs, "jaccard-pairs")
        good, good_uri = store.write_table(_verified(pairs, texts, size, percent), "jaccard-links")
        found = good if found is None else found.union(good)
        labels, labels_uri = store.write_table(components.connected_components(found), "jaccard-labels")
        store.drop(spark, open_uri, rows_uri, pairs_uri, *old)
        links, old = [*links, good_uri], [labels_uri]
        if listing:
            break
    store.drop(spark, *links)
    return labels if labels is not None else spark.createDataFrame([], "node bigint, comp bigint")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, mark_first: bool = False) -> DataFrame:
    """For every row of ``docs``: ``id_col``, ``n_shingles`` and ``component_id``, the smallest id among the
    documents that links reach from it, itself included.

    With ``mark_first`` also ``digest`` and ``row`` (of text and id, as strings) and ``first``: whether the row has
    its component's smallest id, nulls last, and of that id's texts in it the one of the smallest
    digest.  Only equal rows are first together; a row without words always is."""
    spark = docs.sparkSession
    store.bounded_batches(spark)
    rows, rows_uri = store.write_table(_profile(docs, id_col, text_col, size), "jaccard-profile")

    # a class for each distinct set: its 64-bit node, and the row whose text stands for it
    classes = rows.filter("n > 0").groupBy("set").agg(F.min(id_col).alias("least"), F.max("n").alias("n"), F.min(F.struct("digest", "row")).alias("owner"), *([F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "digest")).alias("first")] if mark_first else []))
    firsts = ["first"] if mark_first else []
    node = F.conv(F.substring("set", 1, 15), 16, 10).cast("bigint")
    classes, classes_uri = store.write_table(classes.select(node.alias("node"), "set", "least", "owner.digest", "owner.row", "n", *firsts), "jaccard-classes")
    clashes = classes.groupBy("node").agg(F.collect_list("set").alias("sets"), F.count(F.lit(1)).alias("k")).filter("k > 1").limit(MOST_CLASHES).collect()
    if len(clashes) == MOST_CLASHES:
        raise ValueError("too many sets for 60-bit names")
    moved = {digest: -1 - i for i, digest in enumerate(sorted(d for c in clashes for d in c.sets))}
    if moved:
        names = spark.createDataFrame(list(moved.items()), "set string, other bigint")
        classes = classes.join(F.broadcast(names), "set", "left").withColumn("node", F.coalesce("other", "node")).drop("other")

    digest, row = text_key(F.col(id_col), F.col(text_col))
    source = docs.select(digest, row, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    idle, idle_uri = store.write_table(rows.join(classes.select("digest", "row"), ["digest", "row"], "left_anti").select("digest", "row").distinct(), "jaccard-idle")
    owners = source.join(_bounded(idle), ["digest", "row"], "left_anti").select("text")
    tokens = classes.agg(F.sum("n")).first()[0] or 0
    sent = spark.sparkContext.broadcast(count_levels(owners, tokens, size))
    shared = _shared_only(_prefixes(owners, sent, moved, size, percent))
    prefixes, prefixes_uri = store.write_table(shared.dropDuplicates(["token", "node"]), "jaccard-prefixes")
    sent.destroy()

    wanted, wanted_uri = store.write_table(classes.join(prefixes.select("node").distinct(), "node", "left_semi").select("node", "digest", "row"), "jaccard-wanted")
    texts, texts_uri = store.write_table(source.join(_bounded(wanted), ["digest", "row"]).select("node", "text").dropDuplicates(["node"]), "jaccard-texts")
    labels = _links(prefixes, texts, size, percent)
    store.drop(spark, prefixes_uri, texts_uri, idle_uri, wanted_uri)

    named = classes.select("node", "set", "least", *firsts).join(labels, "node")
    named, _ = store.write_table(named.select("set", "comp", "least", *firsts), "jaccard-named")
    lowest = named.groupBy("comp").agg(F.min("least").alias("component_id"), *(F.min(c).alias(f"comp_{c}") for c in firsts))
    joined = named.join(lowest, "comp").select("set", "component_id", *(f"comp_{c}" for c in firsts))
    of_set = classes.select("set", "least", *firsts).join(joined, "set", "left").select("set", F.coalesce("component_id", "least").alias("component_id"), *(F.coalesce(f"comp_{c}", c).alias(c) for c in firsts))
    marks = [F.col("digest"), F.col("row")] if mark_first else []
    own = [(F.col(id_col).eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))).alias("first")] if mark_first else []
    every = [F.lit(True).alias("first")] if mark_first else []
    alone = rows.filter("n = 0").select(id_col, F.col("n").alias("n_shingles"), F.col(id_col).alias("component_id"), *marks, *every)
    return rows.filter("n > 0").join(of_set, "set").select(id_col, F.col("n").alias("n_shingles"), "component_id", *marks, *own).unionByName(alone)
