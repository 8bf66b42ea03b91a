"""Nodes of JSON documents of any depth, as rows.

Documents are parsed as variants in the JVM and taken apart level by level: each level's containers are
exploded into the next, so no document passes through the driver or a Python worker, and a plan's size
doesn't depend on depth.  Every level is written to the scratch folder, which costs one small job a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder

_KIND = "lower(regexp_extract(schema_of_variant({0}), '^[A-Z]+', 0))"


def nodes(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id``, ``path`` (``$``, ``.key``, ``[place]``), ``parent`` (its path), ``key``, ``place`` (in an array), ``depth``,
    ``kind`` (object, array, string, bigint, ...; void for null) and ``value`` (variant) of every node.

    Texts that aren't JSON, and nulls, have no nodes.  Keys are taken as they are, so a key with a dot makes a
    path that looks like two."""
    spark = docs.sparkSession
    start = docs.select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("value")).filter("value IS NOT NULL")
    level = start.selectExpr("id", "'$' AS path", "CAST(NULL AS STRING) AS parent", "CAST(NULL AS STRING) AS key", "CAST(NULL AS INT) AS place", "0 AS depth", f"{_KIND.format('value')} AS kind", "value")
    found = None
    while True:
        uri = scratch_folder(spark, "json-level")
        level.write.parquet(uri)
        level = spark.read.schema(level.schema).parquet(uri)
        found = level if found is None else found.unionByName(level)
        open_ = level.filter("kind IN ('object', 'array')")
        if open_.isEmpty():
            return found
        level = spark.sql(
            "SELECT id, concat(path, if(e.key IS NULL, concat('[', e.pos, ']'), concat('.', e.key))) AS path, path AS parent, e.key AS key, "
            f"if(e.key IS NULL, e.pos, NULL) AS place, depth + 1 AS depth, {_KIND.format('e.value')} AS kind, e.value AS value FROM {{above}}, LATERAL variant_explode(value) AS e",
            above=open_,
        )


def final_statements(found: DataFrame, key: str = "final", field: str = "sql") -> DataFrame:
    """Statements of every ``key`` node that is an array, at any depth: ``id``, ``path``, ``nth`` (the item's place),
    ``item_id``, ``template_id``, ``round_idx``, ``intent``, ``question``, ``sql`` (blanks around it cut) and ``sha256``.

    Items that aren't objects or whose ``field`` isn't text are left out, as they are in the plain reading."""
    items = found.sparkSession.sql("SELECT id, path, e.pos AS nth, e.value AS item FROM {arrays}, LATERAL variant_explode(value) AS e", arrays=found.filter((F.col("key") == key) & (F.col("kind") == "array")))
    held = items.withColumn("kind", F.expr(_KIND.format("item"))).filter("kind = 'object'")
    text = F.try_variant_get("item", f"$.{field}", "string")
    plain = held.filter(F.expr(f"schema_of_variant(try_variant_get(item, '$.{field}', 'variant')) = 'STRING'"))
    names = ("item_id", "template_id", "round_idx", "intent", "question")
    told = plain.select("id", "path", "nth", *(F.try_variant_get("item", f"$.{n}", "string").alias(n) for n in names), F.regexp_replace(text, r"^\s+|\s+$", "").alias("sql"))
    return told.withColumn("sha256", F.sha2("sql", 256))
