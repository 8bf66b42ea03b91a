"""Centroid clustering: exact Lloyd rounds by dual-tree descent.

Vectors are cut into blocks as they come.  A cover tree over each block is built once and written to the
shared folder; every round builds a tree over the centroids and descends both together: a pair of nodes is
dropped when no centroid of it can be nearest to any vector of it, a block's node with one centroid left
is assigned whole by its stored sums, and pairs of leaves are compared exactly.  Tasks return one sum a
centroid; what reaches the driver depends on the numbers of centroids and components alone.

Components are integers and all sums and distances exact, so results do not depend on blocks or tasks.

Defined cases: null vectors, those of another length and those with null or non-finite entries are left
out; rows of one id, equal vectors and null ids stay (a null id starts a centroid only after all others;
equal hashes start in the vectors' order); with fewer vectors than centroids there are fewer centroids;
of equal centroids the first gets the vectors, and a centroid without vectors stays where it is; no
vectors give an empty result; other columns are ignored.  Scaled components beyond 2^27 raise, since a
distance may not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Vectors of a block, and vectors or centroids of a leaf.
BLOCK, LEAF, CENTROID_LEAF = 2048, 16, 1
#: Scaled components are at most this large.
LARGEST = 1 << 27
#: Distances are compared exactly between leaves only; bounds give way by this share.
SLACK = 1e-9


@dataclass
class Tree:
    """A cover tree as arrays.  Points are ordered so that node ``i`` covers ``start[i]:end[i]``; its centre is
    the point at ``start[i]``, ``radius[i]`` bounds their distance from it, and its children are the nodes
    ``child[i]:child[i] + children[i]``.  A leaf has no children."""

    order: np.ndarray
    start: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray


def _from(points: np.ndarray, squares: np.ndarray | None, i: int) -> np.ndarray:
    """Distances of real points from the i-th; with their squares given, all terms are exact integers."""
    if squares is None:
        return np.sqrt(np.square(points - points[i]).sum(axis=1))
    return np.sqrt(np.maximum(squares + squares[i] - 2 * (points @ points[i]), 0))


def cover_tree(points: np.ndarray, leaf: int) -> Tree:
    """Cover tree over integer points: the children of a node of radius up to 2^i are centres more than 2^(i-1)
    apart, its own centre first, and each takes the points nearest to it, which lie within 2^(i-1)."""
    real = points.astype(np.float64)
    squares = np.square(real).sum(axis=1)
    exact = len(points) > 0 and squares.max() < 2.0**51
    order = np.arange(len(points))
    start, end, radius, child, children = ([0], [len(points)], [0.0], [0], [0]) if len(points) else ([], [], [], [], [])
    node = 0
    while node < len(start):
        lo, hi = start[node], end[node]
        own = order[lo:hi]
        here, here_squares = real[own], squares[own] if exact else None
        near = _from(here, here_squares, 0)
        radius[node] = float(near.max()) * (1 + SLACK)
        if hi - lo > leaf and radius[node] > 0:
            scale = 2.0 ** (np.ceil(np.log2(near.max())) - 1)
            owner, centres = np.zeros(hi - lo, dtype=np.int64), [0]
            while near.max() > scale:  # the farthest point is the next centre
                far = int(near.argmax())
                to_far = _from(here, here_squares, far)
                closer = to_far < near
                owner[closer], near = len(centres), np.minimum(near, to_far)
                owner[far] = len(centres)
                centres.append(far)
            first = np.ones(hi - lo, dtype=np.int64)
            first[centres] = 0  # centres lead their ranges
            places = np.lexsort((first, owner))
            order[lo:hi] = own[places]
            bounds = lo + np.searchsorted(owner[places], np.arange(len(centres) + 1))
            child[node], children[node] = len(start), len(centres)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                start.append(a), end.append(b), radius.append(0.0), child.append(0), children.append(0)
        node += 1
    return Tree(order, *(np.array(x, dtype=kind) for x, kind in ((start, np.int64), (end, np.int64), (radius, np.float64), (child, np.int64), (children, np.int64))))


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0] .. first[0] + count[0] - 1, first[1] .. and so on."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _pair_distances(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """Exact squared distances of a[i] and b[j]."""
    out = np.empty(len(i), dtype=np.int64)
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.square(a[i[lo : lo + step]] - b[j[lo : lo + step]]).sum(axis=1)
    return out


def assign(points: np.ndarray, tree: Tree, centroids: np.ndarray, centre_tree: Tree) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, int]:
    """Nearest centroid of every point (``points`` in the tree's order): ranges of points that a whole node
    assigns (start, end, centroid), then single points and their centroids, and the number of node pairs seen.

    Of equally near centroids the one of the smallest number is taken."""
    leader = centroids[centre_tree.order]
    q, r = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    upper = np.full(len(tree.start), np.inf)
    whole: list[tuple[int, int, int]] = []
    leaf_q, leaf_r, seen = [], [], 0
    while len(q):
        seen += len(q)
        apart = np.sqrt(_pair_distances(points, tree.start[q], leader, centre_tree.start[r]).astype(np.float64))
        np.minimum.at(upper, q, (apart + tree.radius[q]) * (1 + SLACK))
        stays = (apart - tree.radius[q] - centre_tree.radius[r]) * (1 - SLACK) <= upper[q]
        q, r = q[stays], r[stays]
        left = np.bincount(q, minlength=len(upper))
        final = (centre_tree.children[r] == 0) & (centre_tree.end[r] - centre_tree.start[r] == 1)
        done = final & (left[q] == 1)
        whole += zip(tree.start[q[done]].tolist(), tree.end[q[done]].tolist(), centre_tree.order[centre_tree.start[r[done]]].tolist(), strict=True)
        q, r = q[~done], r[~done]
        # the wider side of a node's pairs is opened
        leaf, inner = tree.children[q] == 0, centre_tree.children[r] > 0
        widest = np.zeros(len(upper))
        np.maximum.at(widest, q[inner], centre_tree.radius[r[inner]])
        any_inner = np.bincount(q[inner], minlength=len(upper)) > 0
        open_r = any_inner[q] & (leaf | (widest[q] >= tree.radius[q]))
        open_q = ~open_r & ~leaf
        last = ~open_r & leaf
        leaf_q.append(q[last]), leaf_r.append(r[last])
        wide = open_r & inner & (leaf | (centre_tree.radius[r] >= tree.radius[q]))
        same = open_r & ~wide
        n_r, n_q = centre_tree.children[r[wide]], tree.children[q[open_q]]
        down = _spread(tree.child[q[open_q]], n_q)
        upper[down] = np.minimum(upper[down], np.repeat(upper[q[open_q]], n_q))
        q, r = np.concatenate([q[same], np.repeat(q[wide], n_r), down]), np.concatenate([r[same], _spread(centre_tree.child[r[wide]], n_r), np.repeat(r[open_q], n_q)])
    q, r = np.concatenate(leaf_q), np.concatenate(leaf_r)
    # leaves: every vector of one against every centroid of the other
    n_p, n_c = tree.end[q] - tree.start[q], centre_tree.end[r] - centre_tree.start[r]
    point, right, n_right = _spread(tree.start[q], n_p), np.repeat(r, n_p), np.repeat(n_c, n_p)
    point, number = np.repeat(point, n_right), centre_tree.order[_spread(centre_tree.start[right], n_right)]
    best = np.lexsort((number, _pair_distances(points, point, centroids, number), point))
    point, number = point[best], number[best]
    first = np.ones(len(point), dtype=bool)
    first[1:] = point[1:] != point[:-1]
    return whole, point[first], number[first], seen


_TREE = ("order", "start", "end", "radius", "child", "children")


def _smallest(values: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest signed type."""
    most = int(np.abs(values).max()) if values.size else 0
    return values.astype(next(t for t in (np.int8, np.int16, np.int32) if most <= np.iinfo(t).max))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and vectors of up to ``BLOCK`` rows at once."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == BLOCK:
                yield _whole(held)
                held, n = [], 0
    if n:
        yield _whole(held)


def _whole(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    rows = pa.Table.from_batches(held).combine_chunks()
    return rows.column("id").combine_chunks(), rows.column("q").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)


def write_trees(vectors: DataFrame) -> tuple[DataFrame, str]:
    """Cover trees over blocks of ``vectors`` (``id``, ``q``), one row a block, in the shared folder."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _blocks(batches):
            if int(np.abs(points).max()) > LARGEST:
                raise ValueError("a scaled component lies beyond 2^27")
            tree = cover_tree(points, LEAF)
            own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(tree.order)))
            stored = [own, pa.array([len(ids)], pa.int32())]
            ordered = _smallest(points[tree.order])
            stored += [pa.array([ordered.tobytes()], pa.binary()), pa.array([ordered.itemsize], pa.int32())]
            stored += [pa.array([getattr(tree, f).tobytes()], pa.binary()) for f in _TREE[1:]]
            yield pa.RecordBatch.from_arrays(stored, ["ids", "n", "points", "width", *_TREE[1:]])

    store.bounded_batches(vectors.sparkSession)
    schema = f"ids array<{id_type}>, n int, points binary, width int, " + ", ".join(f"`{f}` binary" for f in _TREE[1:])
    return store.write_table(vectors.mapInArrow(build, schema), "cover-trees")


def _read(row: dict) -> tuple[np.ndarray, Tree]:
    kinds = dict(zip(_TREE[1:], (np.int64, np.int64, np.float64, np.int64, np.int64), strict=True))
    points = np.frombuffer(row["points"], dtype=f"i{row['width']}").reshape(row["n"], -1).astype(np.int64)
    return points, Tree(np.arange(row["n"]), *(np.frombuffer(row[f], dtype=kinds[f]) for f in _TREE[1:]))


def _labels(points: np.ndarray, found: tuple) -> np.ndarray:
    whole, single, numbers, _ = found
    out = np.empty(len(points), dtype=np.int64)
    for a, b, k in whole:
        out[a:b] = k
    out[single] = numbers
    return out


def _sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and componentwise sum of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre_tree = cover_tree(centroids, CENTROID_LEAF)
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                points, tree = _read(row)
                whole, single, numbers, _ = assign(points, tree, centroids, centre_tree)
                if whole:  # a node's sum is a difference of running sums
                    a, b, own = np.array(whole, dtype=np.int64).T
                    running = np.concatenate([np.zeros((1, dims), dtype=np.int64), np.cumsum(points, axis=0)])
                    np.add.at(counts, own, b - a)
                    np.add.at(sums, own, running[b] - running[a])
                np.add.at(counts, numbers, 1)
                np.add.at(sums, numbers, points[single])
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = trees.drop("ids").mapInArrow(partial, "cluster int, n bigint, sums array<bigint>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for c, i, n, s in each.collect():  # centroids x components
        found.setdefault(c, (n, [0] * dims))[1][i] = int(s)
    return found


def scaled_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id`` and ``q``, the components floor(scale * x) of the vectors that are whole."""
    fine = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL").filter(fine)
    return kept.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def cluster_vectors(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of
    every whole vector, after ``rounds`` rounds.

    Centroids start as the vectors with the smallest SHA-256 of "seed:id"."""
    spark = vectors.sparkSession
    scaled = scaled_vectors(vectors, dims, scale, id_col, vec_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = scaled.orderBy(digest.asc_nulls_last(), "q").limit(clusters).collect()
    trees, trees_uri = write_trees(scaled)
    centroids = np.array([r["q"] for r in starts], dtype=np.int64).reshape(len(starts), dims)
    for _ in range(rounds if len(starts) else 0):
        moved = centroids.copy()
        for c, (n, sums) in _sums(trees, centroids).items():
            moved[c] = [s // n for s in sums]
        centroids = moved

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre_tree = cover_tree(centroids, CENTROID_LEAF)
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                points, tree = _read(row)
                own = _labels(points, assign(points, tree, centroids, centre_tree))
                apart = _pair_distances(points, np.arange(len(points)), centroids, own)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), pa.array(own, pa.int32()), pa.array(apart)], ["id", "cluster", "distance"])

    id_type = vectors.schema[id_col].dataType.simpleString()
    labelled, _ = store.write_table(trees.mapInArrow(label, f"id {id_type}, cluster int, distance bigint"), "clustered")
    store.drop(spark, trees_uri)
    totals = {c: int(s) for c, s in labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame([(c, totals.get(c, 0), sum(totals.values()), d) for c, d in enumerate(digests)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = labelled.join(F.broadcast(per_cluster), "cluster")  # one row a centroid
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
