"""Shared storage for written tables, archives and shards.

Everything that must outlive an executor goes below ``spark.checkpoint.dir``, which driver and
executors share.  Only where that setting is absent (single-machine tests) is a folder made here.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, taken from the session; own one only if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scorelake-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared root; not yet created."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and reread it: lineage is cut, and lost
    executors cost no recomputation.  Returns the table and its URI."""
    spark = df.sparkSession
    uri = new_folder(spark, name)
    schema = df.schema
    df.write.parquet(uri)
    return spark.read.schema(schema).parquet(uri), uri


def drop(spark: SparkSession, *uris: str) -> None:
    """Delete written tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for uri in uris:
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession, folder: str, pattern: str) -> None:
    """Delete the files of ``folder`` whose names match ``pattern``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    drop(spark, *(status.getPath().toString() for status in found or ()))


#: Bytes of rows that a Python worker is sent at once, unless one row alone has more.
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send Arrow batches of at most ``BATCH_BYTES``: texts differ in length, so a number
    of rows doesn't bound a worker's memory.  A smaller limit of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(re.match(r"-?\d+", spark.conf.get(name))[0]) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def default_parallelism(spark: SparkSession) -> int:
    """Partition count for deliberate shuffles, as the session sets it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
