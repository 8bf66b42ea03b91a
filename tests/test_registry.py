"""The streamed registry against a plain one, stopped and resumed, with eviction."""

import os
import random
from collections import defaultdict

import pytest
from scorelake.streaming import registry

SCHEMA = "k string, at bigint, fp string, extra string"


def rows_of(draw, n, start):
    return [(draw.choice(["a", "a", "a", "b", None]), start + i, draw.choice([None, "", *(f"p{j}" for j in range(25))]), "x") for i in range(n)]


def plain(batches, capacity):
    recent, out = defaultdict(lambda: registry.Recent(capacity)), []
    for batch in batches:
        for k, at, fp, _ in sorted(batch, key=lambda r: r[1]):
            out.append((k, at, fp, *recent[k].add(fp)))
    return sorted(out, key=str)


def drop(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/made-{name}")
    part = next(f for f in os.listdir(f"{folder}/made-{name}") if f.endswith(".parquet"))
    os.rename(f"{folder}/made-{name}/{part}", f"{folder}/in/{name}.parquet")


def run(spark, folder, out, capacity, shards=1):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    admitted = registry.admit(stream, ["k"], "fp", "at", capacity, shards)
    query = admitted.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check-{out}").option("path", f"{folder}/{out}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(200)
    return sorted(((r["k"], r["at"], r["fp"], r["kept"], r["repeats"]) for r in spark.read.parquet(f"{folder}/{out}").collect()), key=str)


@pytest.mark.parametrize("capacity", [5, 100])
def test_stopped_and_resumed_stream_equals_one_run(spark, tmp_path, capacity):
    draw, folder = random.Random(capacity), str(tmp_path)
    os.mkdir(f"{folder}/in")
    batches = [rows_of(draw, 30, 100 * b) for b in range(4)]
    for b in (0, 1):
        drop(spark, folder, f"f{b}", batches[b])
    first = run(spark, folder, "out", capacity)
    assert first == plain(batches[:2], capacity)
    for b in (2, 3):
        drop(spark, folder, f"f{b}", batches[b])
    resumed, whole = run(spark, folder, "out", capacity), run(spark, folder, "once", capacity)
    assert resumed == whole == plain(batches, capacity)
    assert any(not kept for *_, kept, _ in whole)


def test_shards_keep_equal_fingerprints_together(spark, tmp_path):
    draw, folder = random.Random(1), str(tmp_path)
    os.mkdir(f"{folder}/in")
    rows = rows_of(draw, 120, 0)
    drop(spark, folder, "f0", rows)
    kept = lambda found: [r[:4] for r in found]  # noqa: E731  places are those of a shard
    assert kept(run(spark, folder, "out", 100, shards=3)) == kept(plain([rows], 100))


def test_recent_forgets_the_oldest():
    recent = registry.Recent(2)
    assert [recent.add(p)[0] for p in ("a", "b", "a", "c", "a", "b", None, "")] == [True, True, False, True, True, True, True, True]
    again = registry.Recent(2, *recent.state())
    assert again.state() == recent.state() and again.add("b") == (False, 5)
