"""Session settings that the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def create(name: str = "scorelake", **settings: str) -> SparkSession:
    """Session with these settings under the caller's; partition counts are left to the cluster's
    configuration and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder for files that driver and executors both see; not yet created.

    It lies below ``spark.checkpoint.dir``; only a single-machine session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="scorelake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
