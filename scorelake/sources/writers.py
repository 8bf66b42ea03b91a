"""Sinks: records, shards, manifests and release audits."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a result that may go into one JSON file through the driver.
ENVELOPE_ROWS = 100_000


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, one file a partition; Spark's commit makes it appear whole."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_slice(df: DataFrame, condition, path: str) -> bool:
    """Write the rows of a slice, only if there are any; tells whether it did."""
    part = df.filter(condition)
    if part.isEmpty():
        return False
    write_jsonl(part, path)
    return True


def write_shards(df: DataFrame, order: str, shards: int, path: str) -> None:
    """Contiguous shards of nearly equal row counts (at most one apart), one folder each.

    Places come from range-sorted partitions and their counts, not from one global window."""
    chunk_numbers(df, order, shards).withColumnRenamed("chunk", "shard").write.mode("overwrite").partitionBy("shard").json(path)


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under a temporary name and rename it over ``path``."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    target, temporary = hadoop(path), hadoop(path + ".tmp")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = files.create(temporary, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    files.delete(target, False)
    if not files.rename(temporary, target):
        raise OSError(f"can't replace {path}")


def write_manifest(spark: SparkSession, path: str, entries: Mapping[str, object]) -> None:
    """Run manifest as sorted JSON, beside the outputs that it describes."""
    replace_file(spark, path, json.dumps({"spark": spark.version, **entries}, indent=2, sort_keys=True, default=str))


def write_envelope(df: DataFrame, path: str, envelope: Mapping[str, object] | None = None, key: str = "final") -> None:
    """A result for people: one JSON file, the records inside the caller's envelope.  Tables of more than
    ``ENVELOPE_ROWS`` rows raise; they go to JSON lines."""
    rows = [json.loads(r.value) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).limit(ENVELOPE_ROWS + 1).collect()]
    if len(rows) > ENVELOPE_ROWS:
        raise ValueError(f"more than {ENVELOPE_ROWS} rows for one JSON file")
    replace_file(df.sparkSession, path, json.dumps({**envelope, key: rows} if envelope is not None else rows, indent=2, ensure_ascii=False))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` (below ``folder``) and ``sha256`` of every file, hashed in a task as it is read, in blocks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_replace("path", r"^\w+:/+", "/")
    root = folder.split(":", 1)[-1].rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(1).to_pylist():
                filesystem, where = fs.FileSystem.from_uri(path)
                sha = hashlib.sha256()
                with filesystem.open_input_stream(where, compression=None) as stream:
                    while block := stream.read(1 << 20):
                        sha.update(block)
                digests.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["name", "sha256"])

    listed = files.select(F.regexp_replace(name, f"^.*{root}/".replace("/", "/+"), "").alias("name"), "path")
    return listed.mapInArrow(run, "name string, sha256 string")


def audit(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Differences between files and a manifest (name, sha256): ``name`` and ``problem``."""
    there = checksums(spark, folder).withColumnRenamed("sha256", "actual")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "not listed").when(F.col("actual") != F.col("sha256"), "changed")
    return manifest.join(there, "name", "full_outer").withColumn("problem", problem).filter("problem IS NOT NULL").select("name", "problem")


def dimensions(df: DataFrame, rows: str = "rows", columns: str = "columns") -> DataFrame:
    """``df`` with ``dimension``, such as ``3 x 2``, of its nested answer."""
    return df.withColumn("dimension", F.concat_ws(" x ", F.size(rows).cast("string"), F.size(columns).cast("string")))


def chunk_numbers(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """Near-equal contiguous chunk of each row: the first ones have a row more if they don't come out even."""
    from ..operators.lineage import with_row_ids

    numbered = with_row_ids(df, [order], "__n")
    size, extra = divmod(numbered.count(), chunks)
    cut = extra * (size + 1)
    chunk = F.when(F.col("__n") < cut, F.floor(F.col("__n") / (size + 1))).otherwise(extra + F.floor((F.col("__n") - cut) / max(size, 1)))
    return numbered.withColumn("chunk", chunk.cast("int")).drop("__n")
