"""Connected components by repeated contraction onto the smallest neighbour.

Labels are hash values, so neighbours are ordered at random and every round merges a constant share
of the vertices; each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (a node of the component) for every node of ``edges`` (``a``, ``b``, longs).

    Repeated edges and loops do no harm; an edge with a null end is left out; no edges give an empty
    table."""
    spark = edges.sparkSession
    edges, edges_uri = store.write_table(edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b"), "cc-edges")
    both = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels, labels_uri = store.write_table(both.withColumn("comp", F.col("node")), "cc-labels")
    open_, open_uri = store.write_table(edges.filter("a <> b").distinct(), "cc-open")
    while not open_.isEmpty():
        ends = open_.select(F.col("a").alias("comp"), F.col("b").alias("other")).union(open_.select("b", "a"))
        hooks, hooks_uri = store.write_table(ends.groupBy("comp").agg(F.min("other").alias("other")).select("comp", F.least("comp", "other").alias("onto")), "cc-hooks")
        step, step_uri = store.write_table(labels.join(hooks, "comp", "left").select("node", F.coalesce("onto", "comp").alias("comp")), "cc-labels")
        left = open_.join(hooks.select(F.col("comp").alias("a"), F.col("onto").alias("x")), "a").join(hooks.select(F.col("comp").alias("b"), F.col("onto").alias("y")), "b")
        rest, rest_uri = store.write_table(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-open")
        store.drop(spark, labels_uri, open_uri, hooks_uri)
        labels, labels_uri, open_, open_uri = step, step_uri, rest, rest_uri
    store.drop(spark, edges_uri, open_uri)
    return labels
