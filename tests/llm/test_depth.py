"""Crafted words, whole methods and awkward inputs of the training-data operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from scorelake.llm import decontaminate, jaccard, licences, media, quality, store, substring, textbuf, warc

from test_operators import SCHEMA, brute_components, brute_contamination, brute_repeats, by_id, lower, rows_of  # noqa: I001


def morse(levels, first="a", second="b"):
    """A word and its complement that have one polynomial hash modulo 2^64 under every odd base."""
    bits = [0]
    for _ in range(levels):
        bits += [1 - b for b in bits]
    return "".join((first, second)[b] for b in bits), "".join((second, first)[b] for b in bits)


# words and windows


def test_crafted_words_differ(spark):
    one, two = morse(10)
    assert len(one) == 1024 and one != two
    rest = [f"w{i}" for i in range(34)]
    texts = [" ".join([one, *rest]), " ".join([two, *rest]), one, two]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    assert [by_id(substring.find_repeats(frame))[i]["n_removed"] for i in range(4)] == [0] * 4
    assert [by_id(jaccard.join_components(frame))[i]["component_id"] for i in range(4)] == [c for _, c in brute_components(texts)]


def test_runs_of_crafted_words_differ():
    bits = morse(6, "0", "1")
    h = [np.array([(3, 2**63 + 5)[int(c)] for c in b], dtype=np.uint64) for b in bits]
    for which in (0, 1):
        assert textbuf.window_hashes(h[0], 64, which)[0] != textbuf.window_hashes(h[1], 64, which)[0]


def test_hashes_follow_the_bytes_of_words():
    draw = random.Random(1)
    words = ["", *("".join(draw.choice("abé日") for _ in range(n)) for n in [*range(1, 40)] * 6)]
    text = " ".join(words).encode()
    raw = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = textbuf.words(np.array([0, len(raw)]), raw)
    found = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    assert found == text.split()
    for which in (0, 1):
        h = textbuf.word_hashes(raw, starts, ends, which)
        by_word = {}
        for w, x in zip(found, h.tolist(), strict=True):
            assert by_word.setdefault(w, x) == x
        assert len(set(by_word.values())) == len(by_word)


# substring dedup


def test_levels_double_up_to_the_window():
    assert [substring.level_lengths(w) for w in (35, 64, 8, 1)] == [[9, 18, 35], [8, 16, 32, 64], [4, 8], [1, 1]]


@pytest.mark.parametrize("window", [35, 64, 17])
def test_each_level_reads_what_the_last_left(spark, window):
    draw = random.Random(window)
    word = lambda: f"v{draw.randrange(60)}"
    shared = [word() for _ in range(90)]
    texts = [" ".join([word() for _ in range(draw.randrange(20, 160))] + shared[draw.randrange(30) : 90 - draw.randrange(30)]) for _ in range(40)]
    texts += [" ".join(shared[: window - 1]), " ".join(shared[:20] + [word()] + shared[20:40])]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    levels = substring._Levels(frame, "doc_id", "text", window, ())
    assert levels.levels == len(levels.lengths) - 1
    got = by_id(substring.find_repeats(frame, window=window))
    assert [got[i]["n_removed"] for i in range(len(texts))] == [n for _, n, _ in brute_repeats(texts, window)]


def test_levels_end_when_nothing_repeats(spark):
    texts = [" ".join(f"{c}{i}" for i in range(80)) for c in "abc"]
    levels = substring._Levels(spark.createDataFrame(rows_of(texts), SCHEMA), "doc_id", "text", 35, ())
    assert levels.levels == 1 and levels.live.isEmpty()


# decontamination


def test_two_benchmarks_share_an_index(spark):
    draw = random.Random(8)
    texts = [" ".join(f"t{draw.randrange(50)}" for _ in range(draw.randrange(1, 90))) for _ in range(50)]
    frame = spark.createDataFrame(rows_of(texts), SCHEMA)
    index = decontaminate.build_index(frame)
    for k in (3, 11):
        items = [(i, " ".join(texts[(i * k) % 50].split()[2:30])) for i in range(6)] + [(9, "t1"), (10, "nowhere")]
        found = by_id(decontaminate.find_contamination(frame, spark.createDataFrame(items, "item_id bigint, text string"), index=index))
        assert [(found[i]["n_words"], found[i]["n_hit"], found[i]["items"]) for i in range(50)] == brute_contamination(texts, items)
    store.drop(spark, index.uri)


@pytest.mark.parametrize("slack", [0, 2])
def test_windows_nearby(spark, slack):
    draw = random.Random(slack)
    texts = [" ".join(f"t{draw.randrange(25)}" for _ in range(draw.randrange(1, 60))) for _ in range(40)]
    items = [(i, " ".join(texts[i].split()[1:16])) for i in range(8)] + [(9, "t1"), (10, "t2 nowhere")]
    found = by_id(decontaminate.find_contamination(spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(items, "item_id bigint, text string"), near=slack))
    count = Counter(w for t in texts for w in t.split())
    windows = {tuple(w[s : s + 13]) for _, t in items for w in [t.split()] if w for s in range(max(1, len(w) - 12))}
    for i, text in enumerate(texts):
        near = 0
        for win in windows:
            rare = sorted((count[w], off, w) for off, w in enumerate(win))[:2]
            if not rare[0][0]:
                continue
            starts = [[p - off for p, w in enumerate(text.split()) if w == word and p >= off] for _, off, word in rare]
            near += bool(starts[0]) if len(starts) == 1 else any(abs(a - b) <= slack for a in starts[0] for b in starts[1])
        assert found[i]["n_near"] == near, i


def test_a_long_text_full_of_matches(spark):
    words = [f"x{i}" for i in range(12_000)]
    items = spark.createDataFrame([(i, " ".join(words[i * 40 : i * 40 + 60])) for i in range(300)], "item_id bigint, text string")
    found = decontaminate.find_contamination(spark.createDataFrame(rows_of([" ".join(words), "x1"]), SCHEMA), items).orderBy("doc_id").collect()
    assert (found[0]["n_words"], found[0]["n_hit"], len(found[0]["items"])) == (12_000, 12_000, 300) and found[1]["n_hit"] == 0


# WARC


def test_warc_files_depend_on_the_pages_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "LEAST_BYTES", 1 << 16)
    draw = random.Random(6)
    pages = [(draw.randrange(4000), f"http://h/{i % 700}", f"<p>{i % 900} " + "z" * draw.randrange(300), "x") for i in range(6000)]
    pages += [(77, "http://same", "<p>same" * 40, "x")] * 3000  # a hot row that fills several parts
    schema = "page_id bigint, url string, html string, weight string"
    made = []
    for parts, shuffle in ((3, "5"), (7, "9")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        draw.shuffle(pages)
        folder = store.new_folder(spark, "warc-test")
        manifest = warc.write_archive(spark.createDataFrame(pages, schema).repartition(parts), folder, roll_bytes=40_000)
        made.append(sorted((f["file"], f["records"], f["sha256"]) for f in manifest.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[0] == made[1] and sum(n for _, n, _ in made[0]) == len(pages)
    assert len({f.rsplit("-", 1)[0] for f, _, _ in made[0]}) > 8
    read = warc.read_archive(manifest, folder)
    first = {}
    for i, _, html, _ in pages:
        first[html] = min(first.get(html, i), i)
    want = [(i, "response" if first[html] == i else "revisit", None if first[html] == i else first[html]) for i, _, html, _ in pages]
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in read.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# media


def test_media_values_are_those_of_the_bytes(spark):
    texts = [None, "", "a", "ab" * 64, "é" * 500, "x" * 70_000]
    folder = store.new_folder(spark, "media-test")
    got = by_id(media.read_features(media.write_shards(spark.createDataFrame(rows_of(texts), SCHEMA), folder), folder))
    for i, text in enumerate(texts):
        payload = (text or "").encode()
        payload += b"\0" * ((64 - len(payload) % 64) % 64 if payload else 64)
        width = len(payload) // 64
        lines = b"".join(b"\0" + payload[k * width : (k + 1) * width] for k in range(64))
        chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", width.to_bytes(4, "big") + (64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")
        n, total = len(payload), sum(payload)
        spread = sum(b * b for b in payload) * n - total * total
        feature = f"png8:{width}x64:mean{total * 1000 // n}:var{spread * 1000 // (n * n)}:kinds{len(set(payload))}"
        assert (got[i]["media_sha256"], got[i]["media_bytes"], got[i]["feature"]) == (hashlib.sha256(png).hexdigest(), len(png), feature)


# quality


def plain_ftrl(rows, epochs, alpha=1.0, beta=1.0, l1=0.1, l2=0.5):
    """The same learner over dictionaries of words and pairs of words."""

    def features(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        names = [("1", x) for x in w] + [("2", "same") if a == b else ("2", a, b) for a, b in zip(w, w[1:], strict=False)]
        norm = math.sqrt(len(names)) or 1.0
        return {k: math.sqrt(names.count(k)) / norm for k in set(names)} | {"bias": 1.0}

    z, n = {}, {}

    def weight(k):
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - math.copysign(l1, x)) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    def score(f):
        return 1 / (1 + math.exp(-max(-35, min(35, sum(v * weight(k) for k, v in f.items())))))

    made = [(features(t), y) for t, y in sorted(rows, key=lambda r: (hashlib.md5((r[0] or "").encode()).hexdigest(), r[1]))]
    for _ in range(epochs):
        for f, y in made:
            p, old = score(f), {k: weight(k) for k in f}
            for k, v in f.items():
                g = (p - y) * v
                sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k], n[k] = z.get(k, 0.0) + g - sigma * old[k], n.get(k, 0.0) + g * g
    return lambda text: score(features(text))


def test_training_equals_a_plain_loop(spark):
    draw = random.Random(12)
    texts = [" ".join(draw.choice(["red", "GREEN", "blue", "sky", "sky", "élan", "un-questionable-words"]) for _ in range(draw.randrange(0, 25))) for _ in range(60)]
    rows = [(t or None, int("blue" in t)) for t in texts]
    frame = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id bigint, text string, quality int")
    scored = {r["doc_id"]: r["score"] for r in quality.score(frame, quality.fit(frame, epochs=3)).collect()}
    plain = plain_ftrl(rows, 3)
    assert max(abs(scored[i] - plain(t)) for i, (t, _) in enumerate(rows)) < 1e-5


def test_training_is_bounded_by_bytes(spark):
    frame = spark.createDataFrame([(i, f"w{i} " * 5 + f"v{i % 7}", i % 2) for i in range(80)], "doc_id bigint, text string, quality int")
    few, all_ = quality.fit(frame, epochs=1, most_bytes=200), quality.fit(frame, epochs=1)
    assert np.count_nonzero(few) < np.count_nonzero(all_)


# licences


def test_licence_names_of_any_length(spark):
    """Holders and subjects of hundreds of words, on one line or wrapped, and a lead repeated through a long text."""
    holder = " ".join(f"Holder{i}" for i in range(400))
    wrapped = "\n".join(f"holder {i} of the" for i in range(100))
    texts = [
        f"In no event shall {holder} be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the {wrapped} software.",
        f"To the extent possible under law, {wrapped} people waived all copyright and related or neighboring rights to {holder}.",
        f"The files of {holder} are licensed under the MIT License.",
        f"{holder} is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "in no event shall we " * 5000,
        f"{holder}. Nothing is licensed.",
    ]
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    first = min(got)
    assert [(got[first + i]["n_known"], got[first + i]["licences"]) for i in range(len(texts))] == [(1, []), (1, ["CC0-1.0"]), (1, ["MIT"]), (1, ["GPL-3.0-or-later"]), (0, []), (0, [])]


def test_licences_tie_and_keep_their_rows(spark):
    texts = ["MIT License\nMIT License", "Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", None, None]
    got = licences.scan(spark.createDataFrame(rows_of(texts, [1, 2, None, None]), SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), ",".join(r["licences"])) for r in got) == [("1", "MIT"), ("2", "Apache-2.0,MIT"), ("None", ""), ("None", "")]


# pipeline


def test_pipeline_stages_on_awkward_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    columns = corpus_pipeline.COLUMNS
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, win string"
    rows = [(None, None, None, None, None, 0.5, "w"), (1, "", "en", None, 0, None, None), (1, "", "en", None, 0, None, None), (7, "long " * 30_000, None, "s", 5, 1.0, "w"), (None, "a b", "en", "s", 3, 0.1, "w")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, kinds)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, sf)
            if k < 4:
                assert after.columns == list(columns), name
            n = after.count()
            assert n <= len(table) and (n == len(table) or k in (0, 1)), (name, n)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert 0 < len(out) <= docs.count() and len({r["doc_id"] for r in out}) == len(out)
    assert docs.filter(F.col("doc_id").isin([r["doc_id"] for r in out])).count() == len(out)
