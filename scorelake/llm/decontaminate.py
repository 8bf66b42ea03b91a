"""Benchmark decontamination over a distributed positional inverted index (DataFrame operations only).

``build_index`` stores training token postings (term, row key, position) of all words, for any number of
benchmarks.  A phrase search takes each phrase's rarest terms by corpus frequency, shifts their postings
back by the terms' offsets in the phrase, and intersects the shifted lists; what is left is compared
with the digest of the words that stand there, so matches are exact.  A text is split once for that,
into a written table.  ``proximity_matches`` returns rows in which all terms of a phrase stand within a span.

The index is partitioned by document: postings are written where their rows were read, so that
neither texts nor full posting lists are shuffled; a search reads the terms' column of all.  What the
intersection leaves is as large as the matches, and carries numbers and digests, not words.

Words are runs of ASCII digits and letters (A-Z lower-cased) and all non-ASCII characters.

Defined cases: null text has no words and hits nothing; items without words or without id have no
window; items with the same id are one item; repeated rows each get their row's result; null ids
stay; an empty table gives an empty result and an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: How many of a window's rarest terms have their lists intersected.
RAREST = 2
#: Most bytes of a table that is broadcast; beyond it the same join is shuffled.
BROADCAST_BYTES = 48 << 20

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; a leading or trailing separator leaves an empty string at that end."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS)


def row_key(id_: Column, text: Column) -> Column:
    """128-bit key of a row by its id and text; equal rows share it and have equal results."""
    return F.unhex(F.md5(F.concat(F.md5(F.coalesce(text, F.lit(""))), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))))


def _bounded(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows (with their bytes given) are small enough."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)).alias("n")).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


@dataclass
class PositionalIndex:
    """Stored postings of all words: ``term`` (hash of the word), ``key`` (row), ``pos``."""

    postings: DataFrame
    uri: str


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Store the postings of all words of ``docs``.  Terms are 64-bit hashes, which finding places may
    confuse; comparing them doesn't."""
    terms = F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w))
    tokens = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), terms.alias("w")).select("key", F.posexplode("w").alias("pos", "term"))
    return PositionalIndex(*store.write_table(tokens.select("term", "key", "pos"), "index-postings"))


def _with_frequency(index: PositionalIndex, spelled: DataFrame) -> DataFrame:
    """``spelled`` (with ``word``) with each word's ``term`` and ``df``, the length of its list: what reading it costs."""
    wanted, _ = store.write_table(spelled.select(F.xxhash64("word").alias("term")).distinct(), "index-wanted")
    frequency = index.postings.select("term").join(_bounded(wanted, 32), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return spelled.withColumn("term", F.xxhash64("word")).join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: ``item`` (id as string), ``win`` (array of words)."""
    w = F.filter(words(F.col(text_col)), lambda x: x != "")
    cut = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), w.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return cut.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), F.lit(window)).alias("win")).distinct()


def shifted_postings(index: PositionalIndex, windows: DataFrame) -> DataFrame:
    """Postings of each window's rarest terms, shifted back by the terms' offsets: ``key``, ``window``, ``n``,
    ``lists`` (how many terms), ``nth`` (which) and ``start``; ``windows`` has ``window`` (its digest) and ``win``.
    A window with a term that never occurs has none."""
    spelled = _with_frequency(index, windows.select("window", F.size("win").alias("n"), F.posexplode("win").alias("off", "word")))
    rarest = spelled.withColumn("nth", F.row_number().over(Window.partitionBy("window").orderBy("df", "off"))).filter(F.col("nth") <= RAREST)
    whole = Window.partitionBy("window")
    anchors = rarest.select("term", "window", "n", "off", "nth", F.min("df").over(whole).alias("least"), F.count(F.lit(1)).over(whole).alias("lists")).filter("least > 0").drop("least")
    anchors, _ = store.write_table(anchors, "index-anchors")
    return index.postings.join(_bounded(anchors, 80), "term").select("key", "window", "n", "lists", (F.col("pos") - F.col("off")).alias("start"), "nth").filter("start >= 0")


def phrase_candidates(shifted: DataFrame) -> DataFrame:
    """Places at which all the rarest terms of a window stand as the window has them: ``key``, ``window``, ``n``,
    ``start``."""
    met = shifted.groupBy("key", "window", "n", "lists", "start").agg(F.bit_or(F.expr("shiftleft(1, nth)")).alias("which")).filter("bit_count(which) = lists")
    return store.write_table(met.select("key", "window", "n", "start"), "index-candidates")[0]


def near_windows(shifted: DataFrame, slack: int) -> DataFrame:
    """``key`` and ``n_near``, the windows of which the rarest terms stand as far from each other as in the
    window but for ``slack`` words more or less."""
    order = Window.partitionBy("key", "window").orderBy("start", "nth")
    # of starts in order, those of different terms that are nearest are neighbours
    gap = F.when(F.lag("nth").over(order) != F.col("nth"), F.col("start") - F.lag("start").over(order))
    near = shifted.withColumn("gap", gap).filter((F.col("gap") <= slack) | (F.col("lists") == 1))
    return near.select("key", "window").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_near"))


def phrase_matches(candidates: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` and its ``hits`` (start, n, window), for the rows with any: the candidates at which the words of
    the window stand.  Each row's text is split once."""
    spark = docs.sparkSession
    keys, keys_uri = store.write_table(candidates.select("key").distinct(), "index-keys")
    texts = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text")).join(_bounded(keys, 64), "key", "left_semi")
    split, split_uri = store.write_table(texts.groupBy("key").agg(F.first("text").alias("text")).select("key", words(F.col("text")).alias("w")), "index-texts")
    places = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "n", "window")).alias("places"))
    there = lambda p: F.unhex(F.md5(F.array_join(F.slice("w", p["start"] + 1, p["n"]), " "))) == p["window"]
    hits, _ = store.write_table(split.join(places, "key").select("key", F.filter("places", there).alias("hits")).filter("size(hits) > 0"), "index-hits")
    store.drop(spark, keys_uri, split_uri)
    return hits


def _covered(hits: Column) -> Column:
    """Number of words inside the spans of ``hits``."""
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].cast("bigint").alias("start"), (h["start"] + h["n"]).cast("bigint").alias("end"))))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    more = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["end"]))).cast("bigint").alias("n"), F.greatest(a["end"], s["end"]).alias("end"))
    return F.aggregate(spans, none, more, lambda a: a["n"])


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: tuple[str, ...] = (), index: PositionalIndex | None = None, near: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, the columns ``keep``, ``n_words``, ``n_hit`` (words inside occurrences of
    item windows) and ``items`` (sorted ids, as strings, of items with occurring windows).

    ``index`` is one that ``build_index`` made of the same ``docs``; without it one is made and deleted.  With
    ``near`` also ``n_near``: the windows whose rarest terms stand in their places but for so many words."""
    spark = docs.sparkSession
    digest = F.unhex(F.md5(F.array_join("win", " ")))
    cut, cut_uri = store.write_table(item_windows(items, item_id_col, item_text_col, window).withColumn("window", digest), "item-windows")
    of = index or build_index(docs, id_col, text_col)
    shifted = shifted_postings(of, cut.select("window", "win").dropDuplicates(["window"]))
    candidates = phrase_candidates(shifted)
    close = None if near is None else store.write_table(near_windows(shifted, near).withColumnRenamed("key", "__key"), "index-near")[0]
    if index is None:
        store.drop(spark, of.uri)
    hits = phrase_matches(candidates, docs, id_col, text_col)
    owned = hits.select("key", F.explode(F.array_distinct(F.transform("hits", lambda h: h["window"]))).alias("window")).join(cut.select("window", "item"), "window")
    owned = owned.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found, _ = store.write_table(hits.select("key", _covered(F.col("hits")).alias("n_hit")).join(owned, "key"), "index-found")
    store.drop(spark, cut_uri)

    count = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), _SEPARATORS_ANY_CASE), lambda x: x != "")).cast("bigint")
    source = docs.select(F.col(id_col), *(F.col(c) for c in keep), count.alias("__n_words"), row_key(F.col(id_col), F.col(text_col)).alias("__key"))
    found = _bounded(found.select(F.col("key").alias("__key"), F.col("n_hit").alias("__n_hit"), F.col("items").alias("__items")), 64 + F.expr("aggregate(__items, 0, (n, i) -> n + 16 + length(i))"))
    joined = source.join(found, "__key", "left")
    if close is not None:
        joined = joined.join(_bounded(close, 48), "__key", "left")
    return joined.select(
        id_col,
        *keep,
        F.col("__n_words").alias("n_words"),
        F.coalesce("__n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"),
        *([] if close is None else [F.coalesce("n_near", F.lit(0)).alias("n_near")]),
    )


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int, id_col: str = "doc_id", text_col: str = "text", index: PositionalIndex | None = None) -> DataFrame:
    """Rows in which every distinct word of a phrase stands within ``span`` consecutive words.

    ``phrases`` has ``phrase`` (id) and ``text``; returns ``id_col``, ``phrase``, ``n_spans`` (places at
    which such a span starts with one of the words).  The rarest term's list picks the rows first.
    """
    cut = phrases.select("phrase", F.array_distinct(F.filter(words(F.col("text")), lambda x: x != "")).alias("w")).filter(F.size("w") > 0)
    cut, _ = store.write_table(cut, "proximity-phrases")
    index = index or build_index(docs, id_col, text_col)
    spelled, _ = store.write_table(_with_frequency(index, cut.select("phrase", F.size("w").alias("n"), F.explode("w").alias("word"))), "proximity-words")
    first = spelled.withColumn("nth", F.row_number().over(Window.partitionBy("phrase").orderBy("df", "word"))).filter("nth = 1 AND df > 0")
    rows = index.postings.join(_bounded(store.write_table(first.select("term", "phrase"), "proximity-first")[0], 128), "term").select("key", "phrase").distinct()
    near = index.postings.join(_bounded(spelled.select("term", "phrase", "n"), 128), "term").join(rows, ["key", "phrase"])
    ahead = Window.partitionBy("key", "phrase").orderBy("pos").rangeBetween(0, span - 1)
    spans = near.withColumn("held", F.size(F.collect_set("term").over(ahead))).filter("held = n").groupBy("key", "phrase").agg(F.count_distinct("pos").alias("n_spans"))
    keys = docs.select(F.col(id_col), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    return keys.join(spans, "key").select(id_col, "phrase", "n_spans")
