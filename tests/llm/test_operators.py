"""Training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from scorelake.llm import bpe, components, decontaminate, jaccard, licences, media, quality, sharding, store, substring, token_counts, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, row bigint, win string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
BARE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return [(i, t, "en", "s", None, 0.5, "k", 7, "w") for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    vocabulary = [a + b for a in ("the", "an", "Ñu", "ing", "é", "to", "x.", "re") for b in ("", "st", "Ra", "li-", "on", "9", "日本", "!")]
    word = lambda: draw.choice(vocabulary)
    shared = [word() for _ in range(60)]
    out = [None, "", "  \t\n ", "one", "One", "a b c", "a b c", " ".join(shared), " ".join(shared), "\x00\x1f a\x00b"]
    for i in range(60):
        body = [word() for _ in range(draw.randrange(1, 150))]
        if i % 3 == 0:
            at = draw.randrange(len(body))
            body[at:at] = shared[draw.randrange(10) : 60 - draw.randrange(10)]
        if i % 10 == 9:
            body = ["again"] * 90
        out.append((" " if i % 2 else "\n ").join(body))
    base = out[30].split()
    for i in range(6):  # near copies, some of which differ too much
        copy = list(base) * 2
        for _ in range(i):
            copy[draw.randrange(len(copy))] = f"new{i}"
        out.append(" ".join(copy))
    out.append("long " * 40_000)
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# decontamination


def brute_contamination(texts, items, window=13):
    wins = {}
    for item, text in items:
        w = BARE.findall(lower(text))
        if item is not None and w:
            n = min(len(w), window)
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = BARE.findall(lower(text)), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out.append((len(w), len(hit), sorted(found)))
    return out


def items_of(texts):
    long = " ".join(texts[7].split()[5:40])
    return [(1, long), (2, "One"), (3, None), (4, ""), (5, "a, B; c"), (None, "the"), (1, texts[20]), (22, "again again again"), (3, "nowhere to be found"), (6, long)]


def test_contamination(spark, docs, texts):
    items = items_of(texts)
    found = by_id(decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), keep=("score", "key", "win")))
    want = brute_contamination(texts, items)
    assert [(found[i]["n_words"], found[i]["n_hit"], found[i]["items"]) for i in range(len(texts))] == want
    assert any(n for _, n, _ in want) and found[3]["key"] == "k"


def test_contamination_of_empty_tables_and_repeated_rows(spark, docs, empty, texts):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontaminate.find_contamination(docs, none).collect()} == {0}
    items = spark.createDataFrame(items_of(texts), "item_id bigint, text string")
    assert decontaminate.find_contamination(empty, items).count() == 0
    twice = spark.createDataFrame(rows_of([texts[7]] * 3 + ["One"], [None, None, 1, None]), SCHEMA)
    assert sorted(r["n_hit"] for r in decontaminate.find_contamination(twice, items).collect()) == [1, *[brute_contamination([texts[7]], items_of(texts))[0][1]] * 3]


def test_contamination_is_native(spark, docs, texts):
    items = spark.createDataFrame(items_of(texts), "item_id bigint, text string")
    plan = decontaminate.find_contamination(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark, docs, texts):
    phrases = [("p", "One"), ("q", "a c"), ("r", "again"), ("s", "")]
    found = {(r["doc_id"], r["phrase"]): r["n_spans"] for r in decontaminate.proximity_matches(docs, spark.createDataFrame(phrases, "phrase string, text string"), 3).collect()}
    want = {}
    for i, text in enumerate(texts):
        w = BARE.findall(lower(text))
        for p, q in phrases:
            need = set(BARE.findall(lower(q)))
            n = sum(1 for s in range(len(w)) if need and w[s] in need and need <= set(w[s : s + 3]))
            if n:
                want[i, p] = n
    assert found == want


# licences


def test_licences(spark, docs, empty):
    texts = [None, "", "Released under the MIT License.\nOnce. LICENSED under CC BY-NC 4.0! x", "Permission is hereby granted, free of charge, to any person obtaining a copy.\n\nSome words.\nThe software is provided \"as is\", without warranty of any kind.", "The software is provided as is, without warranty of any kind. Permission is hereby granted, free of charge, to any person obtaining a copy.", "All rights reserved" + " word" * 9000, "x. All rights reserved."]
    got = by_id(licences.scan(spark.createDataFrame(rows_of(texts), SCHEMA)))
    assert [(got[i]["n_known"], got[i]["licences"]) for i in range(7)] == [(0, []), (0, []), (2, ["CC-BY-NC-4.0", "MIT"]), (2, ["MIT"]), (2, []), (0, []), (1, ["Proprietary"])]
    assert licences.scan(empty).count() == 0 and licences.scan(docs).count() == docs.count()


# quality


def test_quality_learns_and_scores_whole_texts(spark):
    draw = random.Random(2)
    good = lambda: " ".join(draw.choice(["calm", "river", "stone", "light", "over", "under"]) for _ in range(draw.randrange(5, 60)))
    bad = lambda: " ".join(draw.choice(["BUY", "now!!", "|", "free", "click"]) for _ in range(draw.randrange(5, 60)))
    rows = [(i, good() if i % 4 else bad(), int(i % 4 > 0)) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, None, None), (900, "", 1)], "doc_id bigint, text string, quality int")
    weights = quality.fit(df.filter(~quality.held_out()))
    scored = {r["doc_id"]: r["score"] for r in quality.score(df, weights).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum((scored[i] >= 0.5) == (y == 1) for i, _, y in held)
    assert right >= 0.95 * len(held) and len(held) > 50
    assert scored[None] == scored[900] and 0 <= scored[900] <= 1
    alone = quality.score(df.filter("doc_id = 7"), weights).first()["score"]
    assert alone == scored[7]
    assert quality.score(df.filter("doc_id < 0"), weights).count() == 0
    assert set(r["score"] for r in quality.score(df, quality.fit(df.filter("false"))).collect()) == {0.5}
    chosen = quality.training_rows(df, df.select("doc_id", "quality"), rows=40)
    assert chosen.columns == ["doc_id", "text", "quality"] and chosen.count() == 40 and chosen.filter(quality.held_out()).count() == 0


def test_held_out_is_crc_of_the_id(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", quality.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


MIT = """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2021 X
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
BSD = """Copyright (c) 2019, The Foo Project. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
GPL = """/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */
int x;"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
"""


def test_licences_of_whole_wrapped_texts(spark):
    bsd2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
    cases = [
        (MIT, 4, ["MIT"]), ("The MIT License (MIT)\n\n" + MIT, 5, ["MIT"]), (APACHE, 4, ["Apache-2.0"]), (BSD, 7, ["BSD-3-Clause"]), (bsd2, 6, ["BSD-2-Clause"]),
        (GPL, 4, ["GPL-3.0-or-later"]), (GPL.replace("General", "Lesser General").replace("version 3", "version 2.1"), 4, ["LGPL-2.1-or-later"]), (MPL, 2, ["MPL-2.0"]),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\nCopyright", 1, ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License,\nversion 3.", 1, ["GPL-3.0"]),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License. Words.", 1, ["CC-BY-SA-4.0"]),
        ("Note: Released under the MIT License.", 1, ["MIT"]), ("Foo is released under MIT.", 1, ["MIT"]), ("License: MIT", 1, ["MIT"]),
        ("// SPDX-License-Identifier: (MIT OR apache-2.0)\n/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", 2, ["Apache-2.0", "GPL-2.0-only", "MIT"]),
        ("We like the MIT License for its short text.", 0, []),
    ]
    got = by_id(licences.scan(spark.createDataFrame(rows_of([t for t, _, _ in cases]), SCHEMA)))
    assert [(got[i]["n_known"], got[i]["licences"]) for i in range(len(cases))] == [(n, names) for _, n, names in cases]


# Jaccard join


def shingles(text, size=4):
    w = SPACE.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def brute_components(texts, percent=85):
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def test_jaccard_components(docs, texts):
    found = by_id(jaccard.join_components(docs))
    want = brute_components(texts)
    assert [(found[i]["n_shingles"], found[i]["component_id"]) for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(want) - 4


@pytest.mark.parametrize("rounds", [0, 1, 6])
def test_jaccard_of_clusters_in_every_round(spark, monkeypatch, rounds):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "LIST_RATIO", 0)
    draw = random.Random(rounds)
    texts = []
    for c in range(3):
        base = [f"w{draw.randrange(4000)}" for _ in range(120)]
        for _ in range(14):
            copy = list(base)
            for _ in range(draw.randrange(5)):
                copy[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(f"w{draw.randrange(30)}" for _ in range(8)) for _ in range(30)]
    found = by_id(jaccard.join_components(spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)))
    assert [found[i]["component_id"] for i in range(len(texts))] == [c for _, c in brute_components(texts)]


def test_jaccard_edges(spark, empty):
    assert jaccard.join_components(empty).count() == 0
    df = spark.createDataFrame(rows_of([None, "", "x y", "X  y", "x y", "x y"], [None, 4, None, 9, 3, 3]), SCHEMA)
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()), key=str)
    assert got == sorted([(-1, 0, None), (4, 0, 4), (-1, 1, 3), (9, 1, 3), (3, 1, 3), (3, 1, 3)], key=str)


def test_components_of_chains(spark):
    draw = random.Random(3)
    names = draw.sample(range(10**9), 60)
    edges = [(names[i], names[i + 1]) for i in range(39)] + [(names[i], names[i]) for i in range(40, 45)] + [(names[50], names[51])] * 3 + [(None, 1)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({got[n] for n in names[:40]}) == 1 and got[names[50]] == got[names[51]] != got[names[0]]
    assert len(got) == 40 + 5 + 2
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# WARC


def test_warc_round_trip(spark):
    same, other = "<p>ñ " * 50, "x" * 70_000
    pages = [(3, "http://a/3", same), (1, "http://a/1", same), (None, None, same), (2, "u\r\nv", None), (5, "http://ü/", ""), (4, None, other), (9, "http://a/9", other), (9, "http://a/9", other), (10, "h", "\r\n\r\nWARC/1.1\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    folder = store.new_folder(spark, "warc-test")
    manifest = warc.write_archive(df, folder, roll_bytes=200, parts=3)
    files = manifest.collect()
    assert sum(f["records"] for f in files) == len(pages) and len(files) > 3
    got = warc.read_archive(manifest, folder, with_html=True).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in pages:
        h = h or ""
        revisit = i != first[h]
        want.append((str(i), len(h.encode()), warc.payload_digest(h.encode()), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else h))
    key = lambda t: tuple(map(str, t))
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in got), key=key) == sorted(want, key=key)
    again = store.new_folder(spark, "warc-test")
    assert {(f["file"], f["sha256"]) for f in warc.write_archive(df.repartition(5), again, roll_bytes=200, parts=3).collect()} == {(f["file"], f["sha256"]) for f in files}


def test_warc_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    folder = store.new_folder(spark, "warc-test")
    got = {r["page_id"]: r["refers_to"] for r in warc.read_archive(warc.write_archive(df, folder, least_bytes=3), folder).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    folder = store.new_folder(spark, "warc-test")
    assert warc.read_archive(warc.write_archive(df.filter("false"), folder), folder).count() == 0


# media


def test_media_round_trip(spark, docs, texts, empty):
    folder = store.new_folder(spark, "media-test")
    rows = media.read_headers(media.write_shards(docs, folder), folder)
    got = by_id(media.read_features(rows, folder))
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["width"] * r["height"], r["bit_depth"]) == (len(payload), 8) and r["media_sha256"] == r["digest"]
        png = media.to_png(payload)
        assert media.from_png(png) == payload and hashlib.sha256(png).hexdigest() == r["media_sha256"] and r["feature"] == media.features(payload)
    places = {(r["shard"], r["offset"]) for r in got.values()}
    assert len(places) < len(texts)
    folder = store.new_folder(spark, "media-test")
    assert media.read_features(media.write_shards(empty, folder), folder).count() == 0


# sharding


def brute_capacity(sizes, shards):
    best = {0: [0] * (len(sizes) + 1)}
    prefix = [0]
    for s in sizes:
        prefix.append(prefix[-1] + s)
    row = prefix[:]
    for _ in range(shards - 1):
        row = [min(max(row[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(len(prefix))]
    return row[-1] if best else 0


def test_smallest_capacity():
    draw = random.Random(1)
    for _ in range(60):
        sizes = [draw.choice([1, 2, 5, 40, 100]) for _ in range(draw.randrange(0, 25))]
        shards = draw.randrange(1, 8)
        assert sharding.smallest_capacity(sizes, shards) == brute_capacity(sizes, shards)


def test_sharding(spark, docs, texts, empty):
    got = by_id(sharding.shard_documents(docs, 5))
    assert sorted(got) == list(range(len(texts)))
    totals = {}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["digest"]) == (len(raw) + 1, zlib.crc32(raw), hashlib.md5(raw).hexdigest())
        totals[got[i]["digest"]] = totals.get(got[i]["digest"], 0) + len(raw) + 1
    for shard in range(5):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert len({(r["digest"], r["shard"]) for r in got.values()}) == len(totals)
    load = Counter()
    for r in got.values():
        load[r["shard"]] += r["size"]
    assert max(load.values()) == brute_capacity([totals[d] for d in sorted(totals)], 5)
    assert sharding.shard_documents(empty, 5).count() == 0


def test_cuts_are_refined_to_single_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    draw = random.Random(4)
    sizes = {hashlib.md5(str(i).encode()).hexdigest(): draw.choice([1, 3, 10, 200]) for i in range(3000)}
    groups = spark.createDataFrame(list(sizes.items()), "digest string, size bigint").cache()
    for shards in (1, 7, 16):
        capacity, starts = sharding.plan_cuts(groups, shards)
        assert capacity == sharding.smallest_capacity([sizes[d] for d in sorted(sizes)], shards)
        loads = Counter()
        for d, s in sizes.items():
            loads[sum(d >= x for x in starts)] += s
        assert max(loads.values()) == capacity


# BPE


def test_bpe_equals_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.resolve("byte_bpe_50k.json"))
    got = by_id(bpe.encode_decode(docs))
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        joined = ",".join(map(str, ids))
        assert got[i]["ids"] == joined and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(joined.encode()).hexdigest()


def test_bpe_of_odd_strings():
    from tokenizers import Tokenizer

    path = bpe.resolve("byte_bpe_50k.json")
    library, own, draw = Tokenizer.from_file(path), bpe.codec(path), random.Random(9)
    odd = ["<|endoftext|>", "a<|endoftext|> b", " " * 500, "\n \n", "a" * 4000, "it's we'LL", "\x85\xa0\x1c x", "🎉" * 50, "=-" * 900]
    letters = "aAbs 's\t\n<|endoftext|>éß日🎉́​09.,!-_"
    odd += ["".join(draw.choice(letters) for _ in range(draw.randrange(1, 120))) for _ in range(300)]
    for text in odd:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


# substring dedup


def brute_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    assert [[w.decode() for w in ws] for ws in words] == [SPACE.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), b" ".join(kept)))
    return out


@pytest.mark.parametrize("window", [35, 8, 2, 1])
def test_repeats(docs, texts, window):
    short = [t if t is None or len(t) < 50_000 else t[:900] for t in texts]
    frame = docs if window == 35 else docs.withColumn("text", F.when(F.length("text") < 50_000, F.col("text")).otherwise(F.substring("text", 1, 900)))
    texts = texts if window == 35 else short
    got = by_id(substring.find_repeats(frame, window=window))
    want = brute_repeats(texts, window)
    assert [(got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) for i in range(len(texts))] == [(n, k, hashlib.sha256(t).hexdigest()) for n, k, t in want]
    if window == 35:
        cut = by_id(substring.remove_repeats(frame))
        assert [cut[i]["text"] for i in range(len(texts))] == [text if not k else t.decode() for text, (_, k, t) in zip(texts, want, strict=True)]
        assert cut[5]["key"] == "k" and sorted(cut) == list(range(len(texts)))


def test_repeats_of_empty_and_repeated_rows(spark, empty):
    assert substring.find_repeats(empty).count() == 0 and substring.remove_repeats(empty).count() == 0
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame(rows_of([long, long, "x " + long, None], [None, None, 1, 1]), SCHEMA)
    assert sorted((r["n_words"], r["n_removed"]) for r in substring.find_repeats(df).collect()) == [(0, 0), (50, 50), (50, 50), (51, 50)]
    assert sorted(r["text"] or "-" for r in substring.remove_repeats(df).collect()) == ["", "", "-", "x"] or sorted(str(r["text"]) for r in substring.remove_repeats(df).collect()) == ["", "", "None", "x"]


# token counts


def test_token_counts_and_their_cache(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.resolve("byte_bpe_50k.json"))
    uri = store.new_folder(spark, "cache-test")
    want = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts]
    half = by_id(token_counts.count_tokens(docs.filter("doc_id % 2 = 0"), uri))
    stored = token_counts.read_cache(spark, uri).count()
    assert stored == len({t or "" for t in texts[::2]}) and all((half[i]["n_bytes"], half[i]["n_tokens"]) == want[i] for i in half)
    full = by_id(token_counts.count_tokens(docs, uri))
    assert [(full[i]["n_bytes"], full[i]["n_tokens"]) for i in range(len(texts))] == want
    stored = token_counts.read_cache(spark, uri)
    assert stored.count() == stored.select("content_digest").distinct().count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(empty, uri).count() == 0


# pipeline


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        after, _ = store.write_table(stage(spark, docs, sf), "pipeline-test")
        ids = sorted(before)
        if k < 4:
            assert after.columns == list(corpus_pipeline.COLUMNS)
        got = {r["doc_id"]: r for r in after.collect()}
        if k == 1:
            comps = brute_components([before[i]["text"] for i in ids])
            assert sorted(got) == [ids[n] for n, (_, c) in enumerate(comps) if c == n]
        if k == 2:
            assert [got[i]["text"] for i in ids] == [before[i]["text"] if not n else t.decode() for i, (_, n, t) in zip(ids, brute_repeats([before[i]["text"] for i in ids]), strict=True)]
        if k == 3:
            want = brute_contamination([before[i]["text"] for i in ids], items)
            assert sorted(got) == [i for i, (n, h, _) in zip(ids, want, strict=True) if not (h and 20 * h >= n)]
        if k == 4:
            assert sorted(got) == ids
        assert 0 < len(got) <= len(before)
        docs = after


def test_near_duplicate_stage_links_at_five_words_and_four_fifths(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    changed = base[:100] + [f"c{i}" for i in range(15)] + base[115:]
    texts = [" ".join(base), " ".join(base + [f"a{i}" for i in range(40)]), " ".join(changed), " ".join(base[:100] + [f"z{i}" for i in range(100)])]
    kept = corpus_pipeline.near_duplicate_filter(spark, spark.createDataFrame(rows_of(texts), SCHEMA), "")
    sets = [shingles(t, 5) for t in texts]
    assert [5 * len(sets[0] & s) >= 4 * len(sets[0] | s) for s in sets] == [True, True, True, False]
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3]


def test_near_duplicate_stage_keeps_one_row_of_repeated_and_null_ids(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    texts = [one, one, one + " end", two, two, two + " end", three, three, three + " end", None, "", one.replace("x", "v")]
    ids = [5, 5, 5, None, None, None, None, 8, 7, None, 9, 5]
    frame = spark.createDataFrame(rows_of(texts, ids), SCHEMA)
    kept, _ = store.write_table(corpus_pipeline.near_duplicate_filter(spark, frame, ""), "pipeline-test")
    got = [(r["doc_id"], (r["text"] or "")[:1]) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, "x"), (5, "v"), (None, "y"), (7, "z"), (None, ""), (9, "")], key=str)
    words = [len((r["text"] or "").split()) for r in corpus_pipeline.repeat_filter(spark, kept, "").collect()]
    assert sorted(words)[:2] == [0, 0] and min(sorted(words)[2:]) >= 60
