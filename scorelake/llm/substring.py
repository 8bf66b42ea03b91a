"""Substring dedup by level-wise doubling: only windows that repeat at one length are extended to
(at most) twice that length, until none is left or the wanted length is reached.

The first level takes windows of a fraction of the wanted length (9, 18 and 35 words are the levels
of 35), at sampled places: of each full-length window the short one with the smallest hash.  A window
that repeats is extended, inside its full-length window, to the one of the next length around it
with the smallest hash.  Equal full windows have equal short ones at each level, so a full window
whose short one occurs nowhere else can't repeat.  Each level reads only the texts and windows that the
last one left.  All places of all texts are judged; at the last level windows are told apart by
128-bit BLAKE2b digests of their words.

Texts with exact copies need no places of their own: all their windows repeat.  One copy stands for
them when other texts are judged.

Words are runs of anything but ASCII white space, taken unchanged.

Defined cases: null text has no words; a text shorter than a window loses nothing; repeated rows are
copies of each other; null ids stay; an empty table gives an empty result; overlapping repeats
within one text count; other columns are ignored unless asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textbuf

#: Words of a window, and of the shortest that a first level starts with unless the window is short.
WINDOW, LEAST = 35, 8
#: Most 128-bit keys that are broadcast; beyond it the same join is shuffled.
BROADCAST_KEYS = 1_000_000


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def _row(digest: Column, id_: Column) -> Column:
    """128-bit key of a text and its row's id; rows that share it are equal."""
    return F.unhex(F.md5(F.concat(digest, F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")), F.when(id_.isNull(), "-").otherwise("")).cast("binary")))


def level_lengths(window: int) -> list[int]:
    """Lengths of the levels: halves of halves, up to ``window``; two at least."""
    lengths = [(window + 1) // 2, window]
    while lengths[0] >= 2 * LEAST:
        lengths.insert(0, (lengths[0] + 1) // 2)
    return lengths


def _anchors(h: np.ndarray, first: np.ndarray, lengths: list[int], level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all full windows, the place of each one's window of ``level``, and that one's hash."""
    window, length = lengths[-1], lengths[0]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(h))  # words to the end of the row
    starts = np.flatnonzero(left >= window)
    if not len(starts):
        return starts, starts, np.empty(0, dtype=np.uint64)
    hashes = textbuf.window_hashes(h, length)
    at = np.empty(len(starts), dtype=np.int64)
    view = sliding_window_view(hashes, window - length + 1)
    for a in range(0, len(starts), 1 << 16):
        at[a : a + (1 << 16)] = starts[a : a + (1 << 16)] + view[starts[a : a + (1 << 16)]].argmin(axis=1)
    for k in range(1, level + 1):
        before, length = length, lengths[k]
        hashes = textbuf.window_hashes(h, length)
        steps = np.arange(length - before + 1)
        for a in range(0, len(starts), 1 << 16):
            d = slice(a, a + (1 << 16))
            low, high = np.maximum(starts[d], at[d] + before - length), np.minimum(at[d], starts[d] + window - length)
            around = low[:, None] + steps
            values = hashes[np.minimum(around, len(hashes) - 1)]
            values[around > high[:, None]] = np.iinfo(np.uint64).max
            at[d] = low + np.minimum(values.argmin(axis=1), high - low)
    return starts, at, hashes[at]


def _runs(at: np.ndarray) -> np.ndarray:
    """Where a new place begins."""
    return np.append(True, at[1:] != at[:-1]) if len(at) else np.empty(0, dtype=bool)


def _seed(docs: DataFrame, id_col: str, text_col: str, lengths: list[int]) -> DataFrame:
    """Level one: a stored row for each row of ``docs`` with the sampled short windows."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3)
            for a, b, offsets, raw in textbuf.slices(text):
                starts, ends, first = textbuf.words(offsets, raw)
                _, at, hashes = _anchors(textbuf.word_hashes(raw, starts, ends), first, lengths, 0)
                new = _runs(at)
                bounds = np.searchsorted(at[new], first).astype(np.int32)
                seeds = pa.ListArray.from_arrays(bounds, pa.array(hashes[new].view(np.int64), pa.int64()))
                kept = [hashlib.sha256(b" ".join((t.as_py() or "").encode().split())).hexdigest() for t in text[a:b]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(3)), pa.array(np.diff(first), pa.int64()), pa.array(kept, pa.string()), seeds], [id_col, "row", "digest", "n_words", "kept_sha256", "seeds"])

    digest = _digest(F.col(text_col))
    keyed = docs.select(F.col(id_col), _row(digest, F.col(id_col)).alias("row"), digest.alias("digest"), F.col(text_col))
    return keyed.mapInArrow(run, f"`{id_col}` {id_type}, row binary, digest string, n_words bigint, kept_sha256 string, seeds array<bigint>")


def _bounded(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


class _Levels:
    """The written tables of all levels over one input."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, window: int, keep: tuple[str, ...]) -> None:
        spark = docs.sparkSession
        store.bounded_batches(spark)
        self.lengths = level_lengths(window)
        self.rows, self.rows_uri = store.write_table(_seed(docs, id_col, text_col, self.lengths), "substring-rows")
        copies = self.rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("owner")).filter("n > 1")
        self.copies, self.copies_uri = store.write_table(copies, "substring-copies")

        # level one: sampled short windows that occur more than once, and the texts that hold them
        owner = self.copies.select("digest", "owner")
        held, held_uri = self._repeated(self.rows.select("row", "digest", F.lit(1).alias("weight"), "seeds"), ("row", "digest"))
        live = held.join(owner, "digest", "left").filter("owner IS NULL OR owner = row").select("row", "live", F.col("owner").isNotNull().alias("copied"))
        live, self.live_uri = store.write_table(live, "substring-live")
        digest = _digest(F.col(text_col))
        source = docs.select(F.col(id_col), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__keep_{c}") for c in keep), digest.alias("__digest"), _row(digest, F.col(id_col)).alias("__row"))
        texts, self.texts_uri = store.write_table(source.join(live.select(F.col("row").alias("__row"), "copied"), "__row"), "substring-texts")
        store.drop(spark, held_uri)

        self.levels = 1
        with_live = lambda: texts.join(live.select(F.col("row").alias("__row"), "live"), "__row")
        for level in range(1, len(self.lengths) - 1):  # longer windows around those that repeat, while there are any
            if live.isEmpty():
                break
            longer, longer_uri = store.write_table(_extended(with_live(), self.lengths, level), "substring-longer")
            found, uri = self._repeated(longer, ("row",))
            store.drop(spark, longer_uri, self.live_uri)
            live, self.live_uri, self.levels = found, uri, level + 1
        self.live, self.window_level = with_live(), self.levels - 1

        # last level: full windows around the live ones that occur once after all
        single = _windows(self.live, self.lengths, self.window_level).groupBy("h1", "h2").agg(F.sum("weight").alias("n"), F.min("row").alias("row"), F.min("start").alias("start")).filter("n = 1")
        single = single.groupBy(F.col("row").alias("__row")).agg(F.collect_list("start").alias("single"))
        self.single, self.single_uri = store.write_table(single, "substring-single")

    @staticmethod
    def _repeated(windows: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, str]:
        """The ``seeds`` of a level that occur more than once, by the rows that hold them (``live``)."""
        seeds = windows.select(*keys, "weight", F.explode("seeds").alias("seed"))
        repeated, uri = store.write_table(seeds.groupBy("seed").agg(F.sum("weight").alias("n")).filter("n > 1").select("seed"), "substring-seeds")
        found = store.write_table(seeds.join(repeated, "seed", "left_semi").groupBy(*keys).agg(F.collect_set("seed").alias("live")), "substring-held")
        store.drop(windows.sparkSession, uri)
        return found

    def drop(self, spark: SparkSession) -> None:
        """Delete the tables that only this object reads."""
        store.drop(spark, self.live_uri, self.texts_uri, self.single_uri)


def _live_windows(h: np.ndarray, first: np.ndarray, live: pa.Array, lengths: list[int], level: int) -> np.ndarray:
    """Starts of the full windows whose window of ``level`` is among their row's live ones."""
    starts, _, hashes = _anchors(h, first, lengths, level)
    keep = np.zeros(len(starts), dtype=bool)
    bounds = np.searchsorted(starts, first)
    for i, own in enumerate(live):
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            keep[a:b] = np.isin(hashes[a:b].view(np.int64), own.values.to_numpy())
    return starts[keep]


def _extended(live: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """Each text's windows of ``level`` around those of the level before that repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, raw in textbuf.slices(batch.column(3)):
                starts, ends, first = textbuf.words(offsets, raw)
                h = textbuf.word_hashes(raw, starts, ends)
                stays = _live_windows(h, first, batch.column(2)[a:b], lengths, level - 1)
                every, at, hashes = _anchors(h, first, lengths, level)
                kept = np.searchsorted(every, stays)
                at, hashes, row = at[kept], hashes[kept], np.searchsorted(first, stays, side="right")
                new = np.unique(at, return_index=True)[1]  # rows come in order, and so do their places
                bounds = np.searchsorted(row[new], np.arange(1, b - a + 2)).astype(np.int32)
                seeds = pa.ListArray.from_arrays(bounds, pa.array(hashes[new].view(np.int64), pa.int64()))
                weight = np.where(batch.column(1)[a:b].to_numpy(zero_copy_only=False), 2, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(weight, pa.int32()), seeds], ["row", "weight", "seeds"])

    return live.select("__row", "copied", "live", "__text").mapInArrow(run, "row binary, weight int, seeds array<bigint>")


def _windows(live: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """Digests of the full windows whose window of ``level`` repeats."""
    window = lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3)
            for a, b, offsets, raw in textbuf.slices(text):
                starts, ends, first = textbuf.words(offsets, raw)
                places = _live_windows(textbuf.word_hashes(raw, starts, ends), first, batch.column(2)[a:b], lengths, level)
                edges = np.searchsorted(places, first)
                for i in range(b - a):
                    own = (places[edges[i] : edges[i + 1]] - first[i]).tolist()
                    if not own:
                        continue
                    words = (text[a + i].as_py() or "").encode().split()
                    begin = list(accumulate((len(w) + 1 for w in words), initial=0))
                    joined = b" ".join(words)
                    weight = 2 if batch.column(1)[a + i].as_py() else 1
                    for c in range(0, len(own), 1 << 16):
                        some = own[c : c + (1 << 16)]
                        digests = np.frombuffer(b"".join([hashlib.blake2b(joined[begin[x] : begin[x + window] - 1], digest_size=16).digest() for x in some]), "<i8")
                        n = len(some)
                        yield pa.RecordBatch.from_arrays([pa.array(digests[::2]), pa.array(digests[1::2]), pa.array([batch.column(0)[a + i].as_py()] * n, pa.binary()), pa.array(some, pa.int32()), pa.array([weight] * n, pa.int32())], ["h1", "h2", "row", "start", "weight"])

    return live.select("__row", "copied", "live", "__text").mapInArrow(run, "h1 bigint, h2 bigint, row binary, start int, weight int")


def _covered(levels: _Levels, id_col: str, keep: tuple[tuple[str, str], ...], id_type: str) -> DataFrame:
    """What is left of the texts with live windows and no exact copy."""
    names = [id_col, "__row", *(n for n, _ in keep), "__removed", "__kept"]
    lengths, level = levels.lengths, levels.window_level
    window = lengths[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n = batch.column(batch.num_columns - 3), batch.num_columns - 3
            for a, b, offsets, raw in textbuf.slices(text):
                starts, ends, first = textbuf.words(offsets, raw)
                places = _live_windows(textbuf.word_hashes(raw, starts, ends), first, batch.column(n + 1)[a:b], lengths, level)
                edges = np.searchsorted(places, first)
                removed, kept = [], []
                for i in range(b - a):
                    words = (text[a + i].as_py() or "").encode().split()
                    own = places[edges[i] : edges[i + 1]] - first[i]
                    single = batch.column(n + 2)[a + i]
                    if single.is_valid:
                        own = own[~np.isin(own, single.values.to_numpy())]
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, own, 1)
                    np.subtract.at(depth, own + window, 1)
                    stays = np.cumsum(depth[:-1]) == 0
                    removed.append(len(words) - int(stays.sum()))
                    kept.append(b" ".join(compress(words, stays)).decode())
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(n)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names)

    rows = levels.live.filter("NOT copied").join(levels.single, "__row", "left").select(id_col, "__row", *(f"__keep_{n}" for n, _ in keep), "__text", "live", "single")
    fields = "".join(f", `{n}` {t}" for n, t in keep)
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, __row binary{fields}, __removed bigint, __kept string")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For every row of ``docs``: ``id_col``, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept
    words joined by blanks)."""
    levels = _Levels(docs, id_col, text_col, window, ())
    left = _covered(levels, id_col, (), docs.schema[id_col].dataType.simpleString()).filter("__removed > 0")
    left, _ = store.write_table(left.select(F.col("__row").alias("row"), "__removed", F.sha2(F.col("__kept").cast("binary"), 256).alias("__sha")).distinct(), "substring-left")
    levels.drop(docs.sparkSession)
    gone = (F.col("__copies") > 1) & (F.col("n_words") >= window)
    copies = levels.copies.select("digest", F.col("n").alias("__copies"))
    return levels.rows.join(copies, "digest", "left").join(left, "row", "left").select(
        id_col, "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("__removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("__sha", "kept_sha256")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text_col``.

    A text that loses words becomes its kept words joined by blanks (empty if none is kept); others
    stay as they are, white space included.  Rows and columns stay the same.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in docs.columns if c not in (id_col, text_col))
    types = tuple((f"{c}", docs.schema[c].dataType.simpleString()) for c in keep)
    levels = _Levels(docs, id_col, text_col, window, keep)
    id_type = docs.schema[id_col].dataType.simpleString()
    changed, _ = store.write_table(_covered(levels, id_col, types, id_type).filter("__removed > 0"), "substring-changed")
    gone = levels.rows.filter(F.col("n_words") >= window).join(levels.copies.select("digest"), "digest", "left_semi").select(F.col("row").alias("__r")).distinct()
    gone, _ = store.write_table(gone, "substring-gone")
    keys, _ = store.write_table(changed.select(F.col("__row").alias("__r")).unionByName(gone).distinct(), "substring-keys")
    levels.drop(spark)
    store.drop(spark, levels.rows_uri, levels.copies_uri)
    keyed = docs.withColumn("__row", _row(_digest(F.col(text_col)), F.col(id_col)))
    same = F.col("__row") == F.col("__r")
    stays = keyed.join(_bounded(keys), same, "left_anti").select(*docs.columns)
    empty = keyed.join(_bounded(gone), same, "left_semi").withColumn(text_col, F.lit("")).select(*docs.columns)
    cut = changed.withColumn(text_col, F.col("__kept")).select(*docs.columns)
    return stays.unionByName(empty).unionByName(cut)
