"""Fingerprints, whitening and clustering against brute force, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from scorelake.llm import clustering, fingerprints, queries, sharding, whitening

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = "doc_id bigint, text string, id string, part int, guest boolean"


# fingerprints


def brute_sketch(text):
    words, found = WORD.findall(text or ""), set()
    for i in range(max(len(words) - 4, 1) if words else 0):
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64(w.encode(), seed=h).intdigest()
        found.add(h - (1 << 64) if h >> 63 else h)
    return sorted(h for h in found if h < fingerprints.LIMIT) or ([min(found)] if found else [])


def shown(sketch):
    return ",".join(f"{h & (1 << 64) - 1:016X}" for h in sketch)


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def brute_next(rows):
    """Expected values of rows with distinct ids."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (id_, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        a, b, c = brute_sketch(text), brute_sketch(edited), brute_sketch(after)
        inside = len(set(a) & set(c)) / len(a) if a else float(not c)
        out[id_] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), jaccard(a, b), jaccard(a, c), inside)
    return out


def compared(frame):
    return {r[0]: tuple(r)[1:] for r in fingerprints.compare_with_next(frame).collect()}


def test_fingerprints_of_whole_table_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = queries.queries()["op11_fingerprints"](spark, SF)
    assert {r[0]: tuple(r)[1:] for r in found.collect()} == brute_next(rows)


def test_fingerprints_at_seams_and_of_awkward_rows(spark):
    draw = random.Random(3)
    rows = [(None, "a null id comes last"), (7_000_000_000_000_000_001, None), (7_000_000_000_000_000_000, "x " * 30_000)]
    for i in range(300):
        n = draw.choice([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 20, 30])
        rows.append((i * 3 - 100, None if i % 20 == 3 else "".join(draw.choice(["a", "b", "cc", "é", "日本", ""]) + draw.choice([" ", "  ", "\n", "\t", "", "", " "]) for _ in range(n))))
    full = lambda some: spark.createDataFrame([(i, t, "x", 1, True) for i, t in some], TEXTS)
    assert compared(full(rows).repartition(3)) == brute_next(rows)
    assert compared(full(rows[4:5])) == brute_next(rows[4:5])
    assert compared(full(rows[:1])) == brute_next(rows[:1])
    assert compared(full([])) == {}


def test_fingerprints_of_repeated_rows_and_equal_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text), (2, text), (3, "other " + text)]
    found = fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(found) == 5 and len({r["fingerprint"] for r in found if r["doc_id"] < 3}) == 1
    assert sorted(r["near_next"] for r in found if r["doc_id"] == 1)[1:] == [1.0, 1.0]
    with pytest.raises(ValueError):
        fingerprints.compare_with_next(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_plan_shuffles_texts_once_without_python(spark):
    plan = queries.queries()["op11_fingerprints"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_merged_sketches_tell_containment_of_unequal_texts(spark):
    draw = random.Random(4)
    book = [f"w{draw.randrange(3000)}" for _ in range(20_000)]
    passage, strange = " ".join(book[5000:5800]), " ".join(f"v{draw.randrange(3000)}" for _ in range(800))
    docs = spark.createDataFrame([(1, passage), (2, strange), (3, passage + " " + strange), (4, ""), (5, None), (1, passage)], "doc_id bigint, text string")
    collection = fingerprints.sketch_documents(spark.createDataFrame([(1, " ".join(book[:10_000])), (2, " ".join(book[9_000:]))], "doc_id bigint, text string"))
    merged = fingerprints.merge(collection)
    both = set(brute_sketch(" ".join(book[:10_000]))) | set(brute_sketch(" ".join(book[9_000:])))
    assert {r["hash"] for r in merged.collect()} == both and merged.count() == len(both)
    found = fingerprints.contained_in(fingerprints.sketch_documents(docs), merged).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 6 and by[1]["contained"] == 1.0 and by[2]["contained"] == 0.0 and 0.35 < by[3]["contained"] < 0.65
    assert by[4]["contained"] is None and by[5]["n_hashes"] == 0


# whitening


def brute_whiten(matrix, components=8):
    x = np.floor(np.asarray(matrix, dtype=float) * 1024) + 100_000
    n, off = len(x), x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    exact = x.astype(int)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, exact.sum(axis=0), strict=True)) for row in exact]
    return np.abs(off @ vectors / np.sqrt(values)), values / np.square(off).sum() * n, deviation


def test_whitening_of_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    found = queries.queries()["op12_whitening"](spark, SF).toPandas()
    white, explained, deviation = brute_whiten(np.stack(table["embedding"]))
    wide = found.pivot(index="vec_id", columns="component", values="whitened").loc[table["vec_id"]].to_numpy()
    assert len(found) == 8 * len(table) and np.abs(np.abs(wide) - white).max() < 1e-9
    assert np.abs(found.groupby("component")["explained"].first().to_numpy() / explained - 1).max() < 1e-9
    assert found.groupby("vec_id")["deviation"].first().loc[table["vec_id"]].tolist() == deviation
    assert found["identity_error"].nunique() == 1 and found["identity_error"].iloc[0] < 1e-9 and set(found["n"]) == {len(table)}
    covariance = np.cov(wide.T, bias=True)
    assert np.abs(covariance - np.eye(8)).max() < 1e-9


VECTORS = "vec_id bigint, embedding array<float>, id string, x int, w string"


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = rng.normal(size=(40, 5)).astype(np.float32).tolist()
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [1.0, None, 0.0, 0.0, 0.0], [nan] * 5, [inf, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, "a", 1, "b") for i, v in enumerate([*good, *bad])] + [(3, good[3], "a", 1, "b"), (None, good[0], "a", 1, "b")]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).toPandas()
    white, explained, deviation = brute_whiten([*good, good[3], good[0]])
    assert len(found) == 42 * 5 and sorted(set(found["vec_id"].dropna())) == list(range(40))
    assert np.abs(found[found["vec_id"] == 7].sort_values("component")["whitened"].abs().to_numpy() - white[7][:5]).max() < 1e-9
    assert abs(found.groupby("component")["explained"].first().sum() - 1) < 1e-9 and int(found[found["vec_id"] == 7]["deviation"].iloc[0]) == deviation[7]
    frame = lambda some: spark.createDataFrame([(i, v, "a", 1, "b") for i, v in enumerate(some)], VECTORS)
    assert whitening.whiten(frame([])).count() == whitening.whiten(frame([None])).count() == 0
    assert whitening.whiten(frame([good[0]])).count() == whitening.whiten(frame([good[0]] * 4)).count() == 0
    line = whitening.whiten(frame([[float(i), 2.0 * i, 1.0] for i in range(9)])).toPandas()  # one direction only
    assert set(line["component"]) == {1} and abs(line["explained"].iloc[0] - 1) < 1e-9 and line["identity_error"].iloc[0] < 1e-9


def test_deviations_stay_exact_beyond_longs(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id bigint, embedding array<double>")
    scaled, dims = whitening.scaled_vectors(vectors)
    n, sums, most = whitening._exact_sums(scaled, dims)
    assert (n, most) == (3, 102_048) and sums == [3 * 100_000 + 3 * 1024, 3 * 101_024]
    narrow = [r["deviation"] for r in whitening._centred(scaled, n, sums, most).orderBy("id").collect()]
    wide = [r["deviation"] for r in whitening._centred(scaled, n, sums, 1 << 60).orderBy("id").collect()]
    assert narrow == wide == [(3 * 1024) ** 2, 0, (3 * 1024) ** 2]


# clustering


def brute_lloyd(rows, clusters=16, rounds=3, dims=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    centroids = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == k]
            if members:
                centroids[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = sum(d for _, d, _ in found)
    of = {k: sum(d for _, d, c in found if c == k) for k in range(len(centroids))}
    return sorted(((i, k, d, of[k], inertia, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found), key=repr)


@pytest.mark.parametrize("case", ["spread", "copies", "few", "line"])
def test_clustering_of_awkward_rows(spark, case):
    rng = np.random.default_rng(6)
    if case == "spread":
        vectors = (rng.normal(size=(300, 64)) / 3 + rng.integers(0, 4, size=300)[:, None]).astype(np.float32).tolist()
        vectors += [None, [1.0] * 63, [1.0] * 65, [*[0.0] * 63, None], [float("nan")] * 64, [float("-inf"), *[0.0] * 63]]
    elif case == "copies":  # a third of all rows is one vector; equal centroids tie
        vectors = [[0.5] * 64] * 120 + rng.normal(size=(60, 64)).astype(np.float32).tolist() + [[-0.25] * 64] * 120
    elif case == "few":
        vectors = [[0.0] * 64, [1.0] * 64, [1.0] * 64]
    else:
        vectors = [[i / 64, *[0.0] * 63] for i in range(400)]
    rows = [(i, v, "a", 1, "b") for i, v in enumerate(vectors)] + ([(1, vectors[1], "a", 1, "b"), (None, vectors[2], "a", 1, "b")] if case != "few" else [])
    found = clustering.cluster_vectors(spark.createDataFrame(rows, VECTORS).repartition(3))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_lloyd([(r[0], r[1]) for r in rows])


def test_clustering_without_vectors(spark):
    empty = clustering.cluster_vectors(spark.createDataFrame([(1, None, "a", 1, "b")], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="2\\^27"):
        clustering.cluster_vectors(spark.createDataFrame([(1, [1e9] * 64, "a", 1, "b")], VECTORS))


@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_cover_tree_covers_and_separates(leaf):
    rng = np.random.default_rng(leaf)
    points = np.concatenate([rng.integers(-50, 50, size=(200, 3)), np.tile([[7, 7, 7]], (40, 1)), rng.integers(-2, 2, size=(60, 3))])
    tree = clustering.cover_tree(points, leaf)
    placed = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(300)) and (tree.start[0], tree.end[0]) == (0, 300)
    for i in range(len(tree.start)):
        own = placed[tree.start[i] : tree.end[i]]
        assert np.sqrt(np.square(own - own[0]).sum(axis=1)).max() <= tree.radius[i]
        below = range(tree.child[i], tree.child[i] + tree.children[i])
        if below:
            assert [tree.start[j] for j in below] + [tree.end[i]] == [tree.start[i]] + [tree.end[j] for j in below]
            apart = 2.0 ** (np.ceil(np.log2(tree.radius[i] / (1 + clustering.SLACK))) - 1)
            centres = placed[[tree.start[j] for j in below]]
            gaps = np.sqrt(np.square(centres[:, None] - centres[None]).sum(axis=2))
            assert (gaps[~np.eye(len(centres), dtype=bool)] > apart).all() and all(tree.radius[j] <= apart * (1 + 1e-6) for j in below)
        else:
            assert len(own) <= leaf or tree.radius[i] == 0


def test_descent_prunes_node_pairs():
    rng = np.random.default_rng(8)
    points = np.concatenate([rng.integers(-3, 4, size=(100, 4)) + 100 * np.array(c) for c in np.ndindex(2, 2, 2, 2)])
    centroids = np.concatenate([100 * np.array([c]) for c in np.ndindex(2, 2, 2, 2)])
    tree = clustering.cover_tree(points, 16)
    whole, single, numbers, seen = clustering.assign(points[tree.order], tree, centroids, clustering.cover_tree(centroids, 1))
    assert seen < 1600 * 16 / 20 and sum(b - a for a, b, _ in whole) == 1600 and not len(single) and not len(numbers)


# sharding around large groups


@pytest.mark.parametrize("hot", [[], [60], [0], [119], [30, 90], [0, 119]])
def test_large_groups_leave_the_other_shards_near_equal(spark, hot):
    texts = sorted((f"text {i} " + "x" * (150 + i % 30) for i in range(120)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 * (j + 1) + k, texts[i]) for j, i in enumerate(hot) for k in range(300)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), 16).toPandas()
    loads = found.groupby("shard")["size"].sum()
    groups = found.groupby("digest")["size"].sum()
    assert len(loads) == 16 and len(found) == len(rows) and found.groupby("digest")["shard"].nunique().max() == 1
    assert loads.max() == sharding.smallest_capacity(groups.sort_index().tolist(), 16)
    others = loads.sort_values().iloc[: 16 - len(hot)]
    assert others.max() <= 2 * others.min() and (not hot or others.max() < 3000)
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
