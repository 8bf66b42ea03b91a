"""Nodes of nested documents against plain recursion."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from scorelake.sources import nodes


def value(draw, depth):
    kind = draw.randrange(8 if depth else 5)
    if kind == 7 or kind == 6:
        return {draw.choice(["a", "b", "final", "x y"]): value(draw, depth - 1) for _ in range(draw.randrange(4))}
    if kind == 5:
        return [value(draw, depth - 1) for _ in range(draw.randrange(4))]
    return draw.choice([None, True, 7, "text", "", -3, [], {}, [{"sql": " SELECT 1 ", "item_id": "i"}], {"final": [{"sql": "b"}, {"sql": 5}, "no", {"q": 1}]}])


def plain(v, path="$", parent=None, key=None, place=None, depth=0):
    kind = "void" if v is None else "boolean" if isinstance(v, bool) else "bigint" if isinstance(v, int) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
    out = [(path, parent, key, place, depth, kind, v)]
    if isinstance(v, dict):
        for k, x in v.items():
            out += plain(x, f"{path}.{k}", path, k, None, depth + 1)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            out += plain(x, f"{path}[{i}]", path, None, i, depth + 1)
    return out


@pytest.fixture(scope="module")
def documents():
    draw = random.Random(12)
    deep = "x"
    for _ in range(12):
        deep = {"final": [deep, {"sql": "deep"}]}
    return [(i, value(draw, 5)) for i in range(60)] + [(100, deep), (101, {"sql": 1})]


def test_nodes_equal_plain_recursion(spark, documents):
    rows = [(i, json.dumps(v)) for i, v in documents] + [(200, "not json"), (201, None), (202, "")]
    found = nodes.nodes(spark.createDataFrame(rows, "doc bigint, body string"), "doc", "body")
    got = sorted(((r["id"], *r[1:7], json.loads(r["j"])) for r in found.select("id", "path", "parent", "key", "place", "depth", "kind", F.to_json("value").alias("j")).collect()), key=str)
    assert got == sorted(((i, *n) for i, v in documents for n in plain(v)), key=str)


def test_final_statements_at_any_depth(spark, documents):
    rows = [(i, json.dumps(v)) for i, v in documents]
    found = nodes.final_statements(nodes.nodes(spark.createDataFrame(rows, "doc bigint, body string"), "doc", "body"))
    want = []
    for i, v in documents:
        for path, _, key, _, _, kind, x in plain(v):
            if key == "final" and kind == "array":
                want += [(i, path, n, item.get("item_id"), item["sql"].strip(), hashlib.sha256(item["sql"].strip().encode()).hexdigest()) for n, item in enumerate(x) if isinstance(item, dict) and isinstance(item.get("sql"), str)]
    assert len(want) > 15 and sorted(((r["id"], r["path"], r["nth"], r["item_id"], r["sql"], r["sha256"]) for r in found.collect()), key=str) == sorted(want, key=str)
    assert nodes.nodes(spark.createDataFrame([], "doc bigint, body string"), "doc", "body").count() == 0
