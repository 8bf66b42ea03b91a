"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (unchanged, split at spaces, tabs and line ends); with
fewer words the whole sequence is the one shingle.  The sketch keeps every shingle whose 64-bit hash
lies below a fixed fraction of the hash space, and at least the smallest one.  Sketches of one fraction
are samples by the same rule whatever the texts' lengths, so they merge by union and tell how much of a
short text lies in a long one or in a whole collection.

All of it is DataFrame functions: no Python worker runs.  ``compare_with_next`` shuffles each text once;
the hashes of an edited text are those of its two parts, but for the shingles at the seams.

Defined cases: null text is the empty text, whose fingerprint is the empty string; likeness and
containment of two empty sketches is 1, of an empty and another one 0; null ids come last, rows of one id
follow each other by their texts; a single row is its own next; repeated rows stay; an empty table gives
an empty result; other columns are ignored, whatever their names.  Ids must be integers.  Rows of one id
meet in one task, as ids are keys of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

#: Words of a shingle.
SHINGLE = 5
#: One in so many hashes is kept: those below this signed number.
ONE_IN = 8
LIMIT = -(1 << 63) + (1 << 64) // ONE_IN
#: Shingles hashed at once, which bounds what a very long text holds beside its words.
CHUNK = 1024
_SPACE = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE + "+"), lambda w: w != "")


def _hash_at(words: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)))  # places beyond the end are null and left out


def _last(words: Column) -> Column:
    """Place of the last shingle."""
    return F.greatest(F.size(words) - SHINGLE, F.lit(0))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used and wherever the optimizer moves
    the expression: inside functions of array elements it would else be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _low(words: Column) -> Column:
    """Places and hashes (``p``, ``h``) of the shingles below the fraction, in order."""

    def of(w: Column) -> Column:
        at = lambda s: F.transform(F.sequence(s, F.least(s + CHUNK - 1, _last(w))), lambda i: F.struct(i.alias("p"), _hash_at(w, i).alias("h")))
        low = F.flatten(F.transform(F.sequence(F.lit(0), _last(w), F.lit(CHUNK)), lambda s: F.filter(at(s), lambda x: x["h"] < LIMIT)))
        return F.when(F.size(w) > 0, low).otherwise(F.array().cast("array<struct<p:int,h:bigint>>"))

    return _let(words, of)


def _least(words: Column) -> Column:
    """The smallest hash alone; nothing without words."""
    least = lambda w: F.array(F.array_min(F.transform(F.sequence(F.lit(0), _last(w)), lambda i: _hash_at(w, i))))
    return _let(words, lambda w: F.when(F.size(w) > 0, least(w)).otherwise(F.array().cast("array<bigint>")))


def _hashes(low: Column) -> Column:
    return F.transform(low, lambda x: x["h"])


def _sketch(hashes: Column, words: Column) -> Column:
    return _let(hashes, lambda h: F.when(F.size(h) > 0, F.sort_array(F.array_distinct(h))).otherwise(_least(words)))


def sketch(text: Column) -> Column:
    """The sketch of a text: ascending distinct hashes."""
    return _let(words(text), lambda w: _sketch(_hashes(_low(w)), w))


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its hashes, hexadecimal and comma-joined."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity of two texts' shingles, 0 to 1."""
    total = F.size(F.array_union(one, other))
    return F.when(total == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(one, other)).cast("double") / total)


def containment(one: Column, other: Column) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1."""
    size = F.size(one)
    return F.when((size == 0) & (F.size(other) == 0), F.lit(1.0)).when(size == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(one, other)).cast("double") / size)


def sketch_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``sketch`` and ``fingerprint`` of every row."""
    made = docs.select(F.col(id_col).alias("id"), sketch(F.col(text_col)).alias("sketch"))
    return made.select(F.col("id").alias(id_col), "sketch", fingerprint(F.col("sketch")).alias("fingerprint"))


def merge(sketches: DataFrame) -> DataFrame:
    """Sketch of all texts of ``sketches`` together: its distinct hashes as rows (``hash``).

    A collection's sketch grows with it, so it stays a table; that of two collections is the union of
    theirs.  Hashes of the least-one rule above the fraction stay as members."""
    return sketches.select(F.explode("sketch").alias("hash")).distinct()


def contained_in(sketches: DataFrame, collection: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_hashes`` and ``contained``, the estimated share of a text's shingles that a merged
    collection has, for every row of ``sketches``; null for an empty sketch.

    Distinct texts' hashes meet the collection's once a fingerprint, so copies cost nothing more; hot hashes
    are split by the join of two written tables."""
    spark = sketches.sparkSession
    rows, rows_uri = store.write_table(sketches.select(F.col(id_col).alias("id"), F.md5("fingerprint").alias("key"), "sketch"), "sketch-rows")
    firsts = rows.groupBy("key").agg(F.first("sketch").alias("sketch"))
    exploded, hashes_uri = store.write_table(firsts.select("key", F.explode("sketch").alias("hash")), "sketch-hashes")
    known, known_uri = store.write_table(collection.select("hash").distinct(), "sketch-known")
    found, found_uri = store.write_table(exploded.join(known, "hash", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sketch-found")
    store.drop(spark, hashes_uri, known_uri)
    size = F.size("sketch")
    joined = rows.join(found, "key", "left").select(F.col("id").alias(id_col), size.cast("bigint").alias("n_hashes"), F.when(size > 0, F.coalesce("n", F.lit(0)).cast("double") / size).alias("contained"))
    result, _ = store.write_table(joined, "sketch-contained")
    store.drop(spark, rows_uri, found_uri)
    return result


def _literal(values: list[int | None], kind: str) -> Column:
    """A constant array, passed as one string."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").cast(f"array<{kind}>") if None not in values else F.transform(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ","), lambda v: F.when(v != "", v.cast(kind)))


def _deal(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` (``id``, ``text``) with ``part`` and ``guest``: ranges of ids of about equal numbers of rows,
    numbered by rising ids.  The first row of a range, by falling ids, is also a guest of the range before it
    (that of the last range for the highest ids), so that every own row has its next row beside it.

    The driver gets one cut and one id a range."""
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx("id", shares, max(10_000, 20 * parts)).alias("c")).first()["c"] or [])) if shares else []
    powers = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    part = F.lit(0)
    if cuts:  # number of cuts up to the id, by halving
        held = _literal(cuts, "bigint")
        part = F.coalesce(F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda at, step: F.when(F.get(held, at + step - 1) <= F.col("id"), at + step).otherwise(at)), F.lit(0))
    firsts = {r["part"]: r["first"] for r in docs.groupBy(part.alias("part")).agg(F.max("id").alias("first")).collect()}
    if not firsts:
        return docs.withColumns({"part": F.lit(0), "guest": F.lit(False)})
    there = sorted(firsts)
    above = dict(zip(there, [*there[1:], there[0]], strict=True))
    first, host = (F.get(_literal([of.get(p) for p in range(there[-1] + 1)], kind), F.col("own")) for of, kind in ((firsts, "bigint"), (above, "int")))
    own, visit = F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")), F.struct(host.alias("part"), F.lit(True).alias("guest"))
    places = F.when(F.col("id").eqNullSafe(first), F.array(own, visit)).otherwise(F.array(own))
    return docs.withColumn("own", part).select("id", "text", F.inline(places))


def _joined(one: Column, other: Column, glued: Column) -> Column:
    """Words of two neighbouring passages; ``glued`` if the last word of one and the first of the other are one."""
    seam = F.array(F.concat(F.get(one, F.size(one) - 1), F.get(other, F.lit(0))))
    return F.when(glued, F.concat(F.slice(one, 1, F.size(one) - 1), seam, F.slice(other, 2, F.size(other)))).otherwise(F.concat(one, other))


def _glued(before: Column, after: Column) -> Column:
    """Whether a word goes on from the text ``before`` into the text ``after``."""
    return F.right(before, F.lit(1)).rlike(r"[^\x20\x09-\x0D]") & F.left(after, F.lit(1)).rlike(r"[^\x20\x09-\x0D]")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Every row with its fingerprint, that of its edited text, and its likeness to that and to its next row.

    Rows follow each other by falling ids, the first after the last.  The edited text has the last
    floor(n_chars / 3) code points replaced by the first as many (or all) of the next text.  Columns:
    ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``, ``inside_next`` (containment in the next text)."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"{id_col} must be an integer")
    parts = parts or store.default_parallelism(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = _deal(rows, parts).repartitionById(parts, F.col("part"))

    # the text's two parts, and the shingles of the whole
    cut = dealt.withColumn("n_chars", F.char_length("text")).withColumn("stays", F.expr("n_chars - n_chars div 3").cast("int"))
    split = cut.withColumns({"kept": F.expr("substring(text, 1, stays)"), "rest": F.expr("substring(text, stays + 1)")})
    split = split.withColumns({"kept_words": words(F.col("kept")), "rest_words": words(F.col("rest"))})
    whole = split.withColumn("words", _joined(F.col("kept_words"), F.col("rest_words"), _glued(F.col("kept"), F.col("rest")))).withColumn("low", _low(F.col("words")))
    tail = F.slice("kept_words", F.greatest(F.size("kept_words") - SHINGLE + 1, F.lit(1)), F.lit(SHINGLE))
    own = whole.select("id", "part", "guest", "text", "n_chars", "kept", F.size("kept_words").alias("n_kept"), tail.alias("tail"), "low", _sketch(_hashes(F.col("low")), F.col("words")).alias("sketch"))

    falling = Window.partitionBy("part").orderBy("guest", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")
    pairs = own.withColumns({f"next_{c}": F.lead(c).over(falling) for c in ("text", "low", "sketch")}).filter("NOT guest")

    # the edited text: what stays of both texts' shingles, and those with a word at the seam or the end
    new = pairs.withColumn("new", F.expr("substring(next_text, 1, n_chars div 3)")).withColumn("new_words", words(F.col("new"))).withColumn("n_new", F.size("new_words"))
    seam = new.withColumns({"seam": _joined(F.col("tail"), F.slice("new_words", 1, SHINGLE), _glued(F.col("kept"), F.col("new"))), "end": F.slice("new_words", F.greatest(F.col("n_new") - SHINGLE + 1, F.lit(1)), F.lit(SHINGLE))})
    stay = F.filter("low", lambda x: x["p"] < F.col("n_kept") - SHINGLE)
    come = _let(F.col("n_new"), lambda n: F.filter("next_low", lambda x: (x["p"] > 0) & (x["p"] < n - SHINGLE)))
    end = _let(F.col("end"), lambda w: F.when(F.size("new_words") > SHINGLE, F.filter(F.array(_hash_at(w, F.lit(0))), lambda h: h < LIMIT)).otherwise(F.array().cast("array<bigint>")))
    low = F.concat(_hashes(stay), _hashes(come), _hashes(_low(F.col("seam"))), end)
    edited = seam.withColumns({"edited": F.concat("kept", "new"), "edited_low": low})
    edited = edited.withColumn("edited_words", F.when(F.size("edited_low") == 0, words(F.col("edited")))).withColumn("edited_sketch", _sketch(F.col("edited_low"), F.col("edited_words")))
    sketch = F.col("sketch")
    return edited.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n_chars").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(sketch).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(sketch, F.col("edited_sketch")).alias("near_edited"), likeness(sketch, F.col("next_sketch")).alias("near_next"),
        containment(sketch, F.col("next_sketch")).alias("inside_next"),
    )
