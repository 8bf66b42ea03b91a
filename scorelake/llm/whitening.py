"""Embedding whitening: principal components by MLlib's distributed singular values.

Components of the vectors become integers, so sums and deviations from the mean are exact.  Centred rows
form a distributed ``RowMatrix``, whose ``computeSVD`` gives right singular vectors and singular values;
a singular value s stands for the variance s^2 / n.  The total variance comes from the exact deviations
instead, so that it holds all components, also those that the decomposition drops.

What reaches the driver depends on the vectors' length alone: one sum a component, the singular vectors,
and the whitened columns' covariance.

Defined cases: null vectors and those with null or non-finite entries are left out; so are empty vectors
and those whose length isn't the commonest (the longest of several); repeated rows and null ids stay;
components whose singular value is below ``RCOND`` of the largest are left out, so equal vectors, or a
single one, give no row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: Least singular value that counts, as a share of the largest.  Squares of smaller ones drown in rounding.
RCOND = 1e-6
#: Longest vectors whose covariance matrix one machine decomposes whole.
MOST_DIMS = 15_000


def scaled_vectors(vectors: DataFrame, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """``id`` and ``x``, the components floor(scale * c) + shift of the usable vectors, and their length."""
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL AND size(v) > 0").filter(finite)
    commonest = usable.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = commonest["dims"] if commonest else 0
    return usable.filter(F.size("v") == dims).select("id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x")), dims


def _exact_sums(scaled: DataFrame, dims: int) -> tuple[int, list[int], int]:
    """Number of vectors, sum of each component and largest absolute component."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, most = 0, [0] * dims, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, dims)
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()  # neither overflows
                sums = [s + (h << 32) + t for s, h, t in zip(sums, high, low, strict=True)]
                n, most = n + len(x), max(most, int(x.max()), -int(x.min()))
        yield pa.RecordBatch.from_pylist([{"i": i, "n": n, "s": str(s), "most": str(most)} for i, s in enumerate(sums)] if n else [], pa.schema([("i", pa.int32()), ("n", pa.int64()), ("s", pa.string()), ("most", pa.string())]))

    parts = scaled.select("x").mapInArrow(partial, "i int, n bigint, s string, most string")
    rows = parts.groupBy("i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)")), F.max(F.col("most").cast("decimal(38,0)"))).orderBy("i").collect()
    return (rows[0][1], [int(r[2]) for r in rows], max(int(r[3]) for r in rows)) if rows else (0, [0] * dims, 0)


def _literal(values: list[int], kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _centred(scaled: DataFrame, n: int, sums: list[int], most: int) -> DataFrame:
    """``id``, ``deviation`` (exact sum of (n x - S)^2) and ``y`` (the centred vector, x - S / n)."""
    bound = 2 * n * most
    kind = "bigint" if bound < 1 << 62 else "decimal(38,0)"
    wide = "bigint" if len(sums) * bound * bound < 1 << 62 else "decimal(38,0)"
    off = scaled.select("id", F.zip_with("x", _literal(sums, kind), lambda x, s: x.cast(kind) * F.lit(n).cast(kind) - s).alias("off"))
    square = F.aggregate("off", F.lit(0).cast(wide), lambda sum_, d: (sum_ + d.cast(wide) * d.cast(wide)).cast(wide))
    return off.select("id", square.cast("decimal(38,0)").alias("deviation"), F.transform("off", lambda d: d.cast("double") / n).alias("y"))


def principal_components(centred: DataFrame, n: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances, falling, and unit eigenvectors (as rows) of the centred rows' covariance."""
    column = MLUtils.convertVectorColumnsFromML(centred.select(array_to_vector("y").alias("y")), "y")
    found = RowMatrix(column, n, dims).computeSVD(dims if dims <= MOST_DIMS else min(dims, 64), False, RCOND)
    return np.square(found.s.toArray()) / n, found.V.toArray().T


def _identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity; means are taken off first."""
    w = [F.get("w", F.lit(i)) for i in range(k)]
    means = whitened.agg(*(F.sum(c) / n for c in w)).first()
    off = [c - m for c, m in zip(w, means, strict=True)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*(F.sum(off[i] * off[j]) / n for i, j in pairs)).first()
    return max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component: ``id_col``, ``component`` (from 1), ``n``, ``deviation``
    (decimal), ``whitened``, ``explained`` and ``identity_error``."""
    spark = vectors.sparkSession
    store.bounded_batches(spark)
    scaled, dims = scaled_vectors(vectors, scale, shift, id_col, vec_col)
    n, sums, most = _exact_sums(scaled, dims) if dims else (0, [], 0)
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    centred = _centred(scaled, n, sums, most)
    total = centred.agg(F.sum(F.col("deviation").cast("double"))).first()[0] / n**3
    if not total > 0:
        return spark.createDataFrame([], schema)
    variances, directions = principal_components(centred, n, dims)
    k = min(components, len(variances))
    project = (directions[:k] / np.sqrt(variances[:k])[:, None]).T

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = batch.column("y").flatten().to_numpy().reshape(-1, dims) @ project
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("deviation"), lists], ["id", "deviation", "w"])

    whitened, _ = store.write_table(centred.mapInArrow(apply, f"id {id_type}, deviation decimal(38,0), w array<double>"), "whitened")
    error = _identity_error(whitened, n, k)
    explained = F.array(*(F.lit(float(e / total)) for e in variances[:k]))
    return whitened.select("id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        F.col("id").alias(id_col), (F.col("i") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"),
    )
