"""Evidence of answers: ledger lines of base rows, positions, plan summaries, and training records."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_folder


def ledger_line(place: str, entities: Sequence[str], attributes: Sequence[str], blank_is_none: Sequence[str] = ()) -> Column:
    """One base row as text: its place (``?`` without one), then ``name=value`` of entities that aren't blank
    and of attributes that aren't null (nor blank, for ``blank_is_none``)."""
    named = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    some = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    parts = [F.when(some(c), named(c)) for c in entities]
    parts += [F.when(some(c) if c in blank_is_none else F.col(c).isNotNull(), named(c)) for c in attributes]
    return F.concat_ws(" | ", F.coalesce(F.col(place).cast("string"), F.lit("?")), *parts)


def relative_position(place: Column, rows: Column) -> Column:
    """Place from 0 to 1 among ``rows`` rows; 0 in a table of one."""
    return F.when(rows > 1, place / (rows - 1)).otherwise(F.lit(0.0))


def plan_summary(steps: Sequence[Mapping[str, object]]) -> list[dict[str, object]]:
    """A traced statement's steps with the row counts before and after each."""
    plan, before = [], None
    for s in steps:
        rows = s.get("row_count")
        plan.append({"node_type": s.get("node_type"), "label": s.get("label"), "input_row_count": rows if before is None else before, "output_row_count": rows})
        before = rows
    return plan


def with_evidence(result: DataFrame, lineage: DataFrame, base: DataFrame, key: str, line: Column, name: str = "__out", most: int | None = None) -> DataFrame:
    """``result`` with ``evidence``, the lines of the base rows behind each row, in order of ``key``, and
    ``evidence_rows``, how many there are.  With ``most`` only the first lines of a row are gathered."""
    lines = lineage.join(base.select(F.col(key).alias("row_id"), line.alias("__line")), "row_id")
    counts = lines.groupBy(name).agg(F.count(F.lit(1)).alias("evidence_rows"))
    if most is not None:
        place = F.row_number().over(Window.partitionBy(name).orderBy("row_id"))
        lines = lines.withColumn("__nth", place).filter(F.col("__nth") <= most)
    told = lines.groupBy(name).agg(F.array_sort(F.collect_list(F.struct("row_id", "__line"))).alias("__told"))
    none = F.array().cast("array<string>")
    return result.join(told, name, "left").join(counts, name, "left").withColumn("evidence", F.coalesce(F.col("__told.__line"), none)).withColumn("evidence_rows", F.coalesce("evidence_rows", F.lit(0))).drop("__told")


def question_similarity(a: object, b: object) -> float:
    """Similarity of two questions, blanks around them and case aside; 1 for two empty ones, 0 for one."""
    x, y = (str(s or "").strip().lower() for s in (a, b))
    return SequenceMatcher(None, x, y).ratio() if x and y else float(x == y)


def evidence_statistics(lineage: DataFrame, base: DataFrame, key: str, place: str, sums: Sequence[str], counts: Mapping[str, Column], distinct: Sequence[str], name: str = "__out") -> DataFrame:
    """One row for each result row that has lineage: ``name``, ``num_events``, ``first_place`` and ``last_place``, a
    ``sum_`` of each of ``sums`` (nulls and text count as 0), how many base rows meet each of ``counts``, and a sorted
    ``unique_`` array for each of ``distinct``.

    Numbers come from one partial aggregation over the long lineage; names are made distinct before they are
    gathered, so an array holds a result row's entities, not its rows."""
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)")
    rows = lineage.select(name, "row_id").distinct().join(base.withColumnRenamed(key, "row_id"), "row_id")
    made = rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("num_events"), F.min(number(place)).alias("first_place"), F.max(number(place)).alias("last_place"),
        *(F.sum(F.coalesce(number(c), F.lit(0.0))).alias(f"sum_{c}") for c in sums), *(F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counts.items()),
    )
    for c in distinct:
        text = F.col(c).cast("string")
        names = rows.filter(F.trim(text) != "").select(name, text.alias("t")).distinct().groupBy(name).agg(F.array_sort(F.collect_list("t")).alias(f"unique_{c}"))
        made = made.join(names, name, "left").withColumn(f"unique_{c}", F.coalesce(f"unique_{c}", F.array().cast("array<string>")))
    return made


def relevant_columns(signals: Column, always: Column, tokens: Mapping[str, Sequence[str]], order: Sequence[str]) -> Column:
    """Columns of ``order`` that a task concerns: those in the array ``always``, and those one of whose ``tokens`` stands in
    the task's text ``signals``, cases aside."""
    text = F.lower(F.coalesce(signals, F.lit("")))

    def told(column: str) -> Column:
        found = F.coalesce(F.array_contains(always, column), F.lit(False))
        for token in tokens.get(column, ()):
            found = found | F.contains(text, F.lit(token.lower()))
        return F.when(found, F.lit(column))

    return F.array_compact(F.array(*map(told, order)))


def task_statistics(stats: DataFrame, signals: Column, relevant: Column, sums: Sequence[str], places: Sequence[str], counts: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """``stats`` cut down to what a task concerns; the rest is null.

    A sum stays if its column is among the ``relevant``; the first and last place if one of the tokens ``places`` is in
    ``signals``; a count if one of its columns is relevant and one of its tokens, if it has any, is in ``signals``."""
    text = F.lower(F.coalesce(signals, F.lit("")))
    any_of = lambda tests: reduce(or_, tests, F.lit(False))
    has = lambda columns: any_of(F.array_contains(relevant, c) for c in columns)
    asked = lambda tokens: any_of(F.contains(text, F.lit(t)) for t in tokens)
    masks = {f"sum_{c}": has([c]) for c in sums} | {c: asked(places) for c in ("first_place", "last_place")}
    masks |= {n: has(columns) & (asked(tokens) if tokens else F.lit(True)) for n, (columns, tokens) in counts.items()}
    return stats.withColumns({n: F.when(m, F.col(n)) for n, m in masks.items()})


#: Letters counted one by one for the bound; all others count as one.
LETTERS = " abcdefghijklmnopqrstuvwxyz0123456789"
#: Ratios of lengths up to which templates are compared, round by round.
LENGTH_RATIOS = (1.25, math.inf)


def _profiled(df: DataFrame, question: str, *keys: str) -> DataFrame:
    """``keys`` with the question as it is compared (``q``), its length and its letter counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [str(q or "").strip().lower() for q in batch.column(len(keys)).to_pylist()]
            counts = [[c[x] for x in LETTERS] + [len(t) - sum(c[x] for x in LETTERS)] for t in texts for c in (Counter(t),)]
            made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int32()), pa.array(counts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), *made], [*keys, "q", "n", "letters"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, question).mapInArrow(run, f"{kinds}, q string, n int, letters array<int>")


def _ratios(pairs: DataFrame, kinds: str) -> DataFrame:
    """``item``, ``asked`` and ``idx`` of ``pairs`` (these, and ``known``) with the similarity of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.float64())], ["item", "asked", "idx", "similarity"])

    return pairs.select("item", "asked", "idx", "known").mapInArrow(run, f"{kinds}, similarity double")


def best_template(records: DataFrame, templates: DataFrame, item: str = "item_id", idx: str = "idx", compared: list[int] | None = None) -> DataFrame:
    """Each record (``record_id``, ``item``, ``question``) with the ``idx`` of the most similar template of its item,
    the lowest of equals, and the similarity.  Records whose item has no template are left out.

    Equal questions meet by equality.  The rest are compared with templates of ever more different lengths, as
    long as these can still be as similar as the best so far, and only where the letters both texts have in
    common allow it; ``compared`` gets the number of pairs compared in each round."""
    spark = records.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        uri = scratch_folder(spark, name)
        df.write.parquet(uri)
        return spark.read.schema(df.schema).parquet(uri)

    asks = written(_profiled(records, "question", "record_id", item).withColumnRenamed(item, "item"), "asked")
    known = written(_profiled(templates, "question", item, idx).withColumnsRenamed({item: "item", idx: "idx", "q": "known", "n": "m", "letters": "counts"}), "known")
    kinds = f"item {known.schema['item'].dataType.simpleString()}, asked string, idx {known.schema['idx'].dataType.simpleString()}"
    firsts = known.groupBy("item").agg(F.min("idx").alias("first"))
    equal = known.groupBy("item", F.col("known").alias("asked")).agg(F.min("idx").alias("equal"))
    texts = asks.groupBy("item", F.col("q").alias("asked")).agg(F.first("n").alias("n"), F.first("letters").alias("letters"))
    best = texts.join(firsts, "item").join(equal, ["item", "asked"], "left")
    best = written(best.select("item", "asked", "n", "letters", F.when(F.col("equal").isNotNull(), 1.0).otherwise(0.0).alias("similarity"), F.coalesce("equal", "first").alias("idx")), "best")
    most = 1.0  # what templates of the lengths still to come can reach
    low = 1.0
    for ratio in LENGTH_RATIOS:
        open_ = best.filter((F.col("similarity") < 1) & (F.col("similarity") <= most) & (F.col("n") > 0)).withColumnsRenamed({"similarity": "sofar", "idx": "held"})
        shorter, longer = F.least("n", "m"), F.greatest("n", "m")
        near = (longer >= shorter * low if low > 1 else F.lit(True)) & (longer < shorter * ratio if ratio < math.inf else F.lit(True)) & (F.col("m") > 0)
        if ratio < math.inf:  # lengths within a ratio lie in the same class or in neighbouring ones
            place = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1))) / math.log(ratio)).cast("int")
            met = open_.withColumn("class", F.explode(F.array(place("n") - 1, place("n"), place("n") + 1))).join(known.withColumn("class", place("m")), ["item", "class"])
        else:
            met = open_.join(known, "item")
        common = F.aggregate(F.zip_with("letters", "counts", lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
        bound = 2.0 * common / (F.col("n") + F.col("m"))
        may = (bound > F.col("sofar")) | ((bound == F.col("sofar")) & (F.col("idx") < F.col("held")))
        pairs = written(met.filter(near).filter(may).select("item", "asked", "idx", "known"), "pairs")
        if compared is not None:
            compared.append(pairs.count())
        found = _ratios(pairs, kinds).groupBy("item", "asked").agg(F.max(F.struct("similarity", (-F.col("idx")).alias("i"))).alias("b"))
        same = best.alias("o").join(found.alias("f"), (F.col("o.item").eqNullSafe(F.col("f.item"))) & (F.col("o.asked") == F.col("f.asked")), "left")
        wins = F.coalesce((F.col("f.b.similarity") > F.col("o.similarity")) | ((F.col("f.b.similarity") == F.col("o.similarity")) & (-F.col("f.b.i") < F.col("o.idx"))), F.lit(False))
        best = written(same.select("o.item", "o.asked", "o.n", "o.letters", F.when(wins, F.col("f.b.similarity")).otherwise(F.col("o.similarity")).alias("similarity"), F.when(wins, -F.col("f.b.i")).otherwise(F.col("o.idx")).alias("idx")), "best")
        most, low = 2 / (1 + ratio), ratio
    return asks.join(best.select("item", F.col("asked").alias("q"), "idx", "similarity"), ["item", "q"]).select("record_id", F.col("idx").alias(idx), "similarity")


def shortest(df: DataFrame, text: str, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of the shortest texts; ties go by ``keys``.  A top-k: nothing is sorted whole."""
    return df.withColumn("text_length", F.length(text)).filter("text_length IS NOT NULL").orderBy("text_length", *keys).limit(n)
