"""Corpus pipeline: quality, near-duplicate, repeated-passage and benchmark filters, then token ids.

``STAGES`` are applied in order; each stage gets all documents that its predecessor kept, written as
Parquet and reread, and all but the last return the columns of ``documents``.

Defined cases, for every stage: an empty table gives an empty one; other columns than those of
``documents`` are dropped, whatever their names; null ids, languages, sources and lengths are values
like others; texts of any length are read whole.  Null and empty texts: the classifier scores them by
its bias alone, they link with nothing, lose nothing, hit nothing, and have no token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import bpe, decontaminate, jaccard, quality, store, substring

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Most ids of dropped documents that are broadcast; beyond it the same join is shuffled.
BROADCAST_IDS = 500_000
#: Words of a shingle and the least similarity, in hundredths, of near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more).

    Repeated rows have one score and stay or go together; a score of just 0.5 stays; without any
    label that isn't held out every score is 0.5, so all stay."""
    labelled = quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = quality.fit(labelled, rows=None)
    return quality.score(docs, weights, keep=COLUMNS[1:]).filter("score >= 0.5").select(*COLUMNS)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that similarity links join: that of the smallest id, nulls last.

    Of several texts of that id in a group the one of the smallest digest stays, of equal rows (id and
    text) the one whose other columns are least.  Texts without words link with nothing and all stay;
    so do texts of one id that no link joins."""
    groups = jaccard.join_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT, mark_first=True)
    counted = groups.filter("n_shingles > 0").groupBy("digest", "row", "first").agg(F.count(F.lit(1)).alias("n"))
    others, _ = store.write_table(counted.filter("NOT first OR n > 1").select(F.col("digest").alias("__digest"), F.col("row").alias("__row"), "first"), "pipeline-others")
    bounded = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    digest, row = jaccard.text_key(F.col("doc_id"), F.col("text"))
    keyed = docs.select(*COLUMNS, digest.alias("__digest"), row.alias("__row"))
    stays = keyed.join(bounded(others.drop("first")), ["__digest", "__row"], "left_anti").select(*COLUMNS)
    repeated = others.filter("first").drop("first")
    if repeated.isEmpty():
        return stays
    once = keyed.join(bounded(repeated), ["__digest", "__row"], "left_semi")
    once = once.groupBy("__digest", "__row").agg(F.min(F.struct(*COLUMNS)).alias("kept")).select("kept.*")
    return stays.unionByName(once)


def repeat_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their passages of 35 words and more that stand elsewhere too.

    No row goes: a text all of whose words are repeated becomes empty, and rows that repeat a text of 35
    words or more (which the stage before leaves only for texts that it can't link) all do."""
    cut = substring.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def contamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no benchmark window, or with less than a twentieth of their words in such.

    Just a twentieth goes; repeated rows stay or go together; an empty benchmark keeps all."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(docs, items, keep=COLUMNS[1:])
    return found.filter("NOT (n_hit > 0 AND 20 * n_hit >= n_words)").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each kept document, with the digests of ids and decoded text; one row for each row."""
    return bpe.encode_decode(docs, with_text=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("substring dedup", repeat_filter),
    ("benchmark decontamination", contamination_filter),
    ("BPE encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each stage but the last returns is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs, _ = store.write_table(docs, f"pipeline-{number}")
    return docs


#: A trained classifier and a token vocabulary aren't SQL; the tests hold stages against brute force.
ORACLE_SQL = None
