"""Token counts through a digest cache.

Counts are kept in a table by (digest of the normalised content, digest of the tokenizer version).
A run joins its contents with the stored counts, encodes only the distinct contents that miss, and
appends those to the cache.

Normalisation here is null to empty text and UTF-8; nothing that could alter a count is folded.
Defined cases: null counts as the empty text; repeated rows and null ids stay; other columns are
ignored; texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, store

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"
#: Most rows whose keys are broadcast to skip second copies; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000


def tokenizer_digest(path: str, version: str = "1") -> str:
    """Digest of the tokenizer file and of the way it is used; a change makes old counts misses."""
    h = hashlib.sha256(f"special strings as in the file, none added; {version}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def _content_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_cache(spark: SparkSession, cache_uri: str) -> DataFrame:
    """Stored counts; an absent folder is an empty cache."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_uri)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_uri) if there else spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, cache_uri: str, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``content_digest`` for every row of ``docs``;
    ``cache_uri`` gains the counts of the contents it lacked.

    Texts aren't shuffled: the narrow (digest, row) table decides which row of each missing content
    is encoded, and the others' keys go to the scan as a broadcast if they are few, else by a join.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    version = tokenizer_digest(bpe.resolve(tokenizer))
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    keyed = source.withColumn("content_digest", _content_digest(F.col("__text"))).withColumn("__row", F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    narrow, narrow_uri = store.write_table(keyed.select(id_col, "content_digest", "__row", F.octet_length("__text").cast("bigint").alias("n_bytes")), "token-rows")

    cached = read_cache(spark, cache_uri).filter(F.col("tokenizer_digest") == version).select("content_digest").distinct()
    seen = narrow.groupBy("content_digest").agg(F.min("__row").alias("owner"))
    owners = seen.join(cached, "content_digest", "left_anti")
    # rows that needn't be encoded: those of cached contents and all but the owner of the others
    skip = narrow.join(owners.withColumnRenamed("owner", "__row"), ["content_digest", "__row"], "left_anti").select("content_digest", "__row").distinct()
    skip, skip_uri = store.write_table(skip, "token-skip")
    if skip.count() <= BROADCAST_ROWS:
        skip = F.broadcast(skip)
    misses = keyed.select("content_digest", "__row", "__text").join(skip, ["content_digest", "__row"], "left_anti").select("content_digest", "__text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.codec(bpe.resolve(tokenizer))
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                with bpe.no_collection():
                    counts = [ids.count(",") + 1 if (ids := codec.encode_joined(t.as_py())) else 0 for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_uri)
    store.drop(spark, skip_uri)
    # repeated input rows or two runs at once may have appended a content twice; the count is the same
    counts = read_cache(spark, cache_uri).filter(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))
    # written, so that the join's own exchange stands between them and a hot digest can be split
    counts, _ = store.write_table(counts, "token-counts")
    return narrow.drop("__row").join(counts, "content_digest").select(id_col, "n_bytes", "n_tokens", "content_digest")
