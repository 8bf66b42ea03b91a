"""WARC archives: a deterministic sharded writer and its reader.

Records are range-sorted by page id, url and digest.  The sorted keys are cut into parts of about equal
bytes, a function of the pages alone: the same pages give the same files, whatever their order, the
session or its partitions.  A task writes a part into files that roll by compressed size, one gzip member
a record, with headers and digests made anew.  Files are written under temporary names, renamed when
complete, and listed in a manifest table, whose own commit makes the archive valid: a file that no
manifest row names doesn't count, and temporary files left by lost tasks are deleted after it.

Payloads are shuffled once and never joined: the few columns that tell roles come to a part beside its
pages.  Equal rows that fill several parts are counted and dealt out to them.

Of records with equal payloads of at least ``least_bytes`` bytes, the one with the smallest page id is
a response and the others revisit it; smaller ones are all responses.

Defined cases: null html is the empty payload; null url gives no target header, control characters in one
are percent-encoded; a null page id
sorts first and never is the one others refer to while the group has an id; rows that tie on the
smallest id are all responses; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

MANIFEST = "file string, part int, seq int, records bigint, bytes bigint, sha256 string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a part, about; a smaller input has so many parts at most, of so many bytes at least.
PART_BYTES, FEW_PARTS, LEAST_BYTES = 256 << 20, 24, 1 << 20
#: Bytes that a record's headers count for.
HEAD_BYTES = 512


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_KEY = ("__id", "__url", "__sha1")


def _keys(pages: DataFrame) -> DataFrame:
    """Distinct keys of ``pages`` (__id, __url, __html): with the payload's size and the number of rows."""
    html = F.coalesce("__html", F.lit(""))
    keyed = pages.select("__id", "__url", F.sha1(html.cast("binary")).alias("__sha1"), F.octet_length(html).cast("bigint").alias("__size"))
    return keyed.groupBy(*_KEY, "__size").agg(F.count(F.lit(1)).alias("__n"))


def _revisits(keys: DataFrame, least_bytes: int) -> DataFrame:
    """Keys of the records that revisit another, with its id as a string."""
    firsts = keys.filter(F.col("__size") >= least_bytes).groupBy("__sha1").agg(F.min("__id").alias("__first"), F.sum("__n").alias("__all")).filter("__all > 1 AND __first IS NOT NULL")
    joined = keys.join(firsts.select("__sha1", "__first"), "__sha1").filter(~F.col("__id").eqNullSafe(F.col("__first")))
    return joined.select(*_KEY, F.col("__first").cast("string").alias("__refers"))


def _order(key: tuple) -> tuple:
    """Python's order of keys, nulls first."""
    return tuple((x is not None, x) if x is not None else (False,) for x in key)


def plan_parts(keys: DataFrame, parts: int | None = None) -> tuple[int, list[tuple], list[tuple]]:
    """(number of parts, least key of each part after the first, hot keys with their parts) for written keys.

    Parts are cut at equal shares of all bytes in the order of the keys; a key whose rows alone have two
    shares is hot and gets its own range of parts."""
    spark = keys.sparkSession
    weight = (F.col("__size") + HEAD_BYTES) * F.col("__n")
    total = keys.agg(F.sum(weight)).first()[0] or 0
    parts = parts or max(1, -(-total // PART_BYTES), min(FEW_PARTS, total // LEAST_BYTES))
    if parts == 1 or not total:
        return 1, [], []
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in _KEY) + ", weight bigint, before bigint, task int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            weights = batch.column(3).to_numpy()
            after = done + np.cumsum(weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(after - weights), pa.array(np.full(len(weights), task, dtype=np.int32))], [*_KEY, "weight", "before", "task"])
            done = int(after[-1]) if len(after) else done

    ordered = keys.select(*_KEY, weight.alias("weight")).repartitionByRange(store.default_parallelism(spark), *_KEY).sortWithinPartitions(*_KEY)
    ranked, uri = store.write_table(ordered.mapInArrow(run, schema), "warc-ranked")
    sums = sorted((r.task, r.w) for r in ranked.groupBy("task").agg(F.sum("weight").alias("w")).collect())
    starts = accumulate((w for _, w in sums), initial=0)
    offsets = spark.createDataFrame([(task, start) for (task, _), start in zip(sums, starts, strict=False)], "task int, offset bigint")
    at = F.col("offset") + F.col("before")
    part = lambda x: F.expr(f"CAST(({x}) * CAST({parts} AS DECIMAL(20,0)) DIV {total} AS INT)")
    placed = ranked.join(F.broadcast(offsets), "task").select(*_KEY, at.alias("at"), "weight").select(*_KEY, part("at").alias("part"), part("at + weight - 1").alias("last"))
    bounds = [tuple(r.key) for r in placed.groupBy("part").agg(F.min(F.struct(*_KEY)).alias("key")).orderBy("part").collect()]
    hot = [(*r[:3], r.part, r["last"]) for r in placed.filter("last > part + 1").collect()]
    store.drop(spark, uri)
    return parts, bounds[1:], hot


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", least_bytes: int = 0, roll_bytes: int = 256 << 20, parts: int | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``pages`` (``id_col``, url, html) as WARC files below ``folder``; returns the manifest
    (also stored there): file, part, seq, records, bytes, sha256.  ``parts`` overrides their number."""
    spark = pages.sparkSession
    store.bounded_batches(spark)
    pages = pages.select(F.col(id_col).alias("__id"), F.col("url").alias("__url"), F.col("html").alias("__html"))
    keys, keys_uri = store.write_table(_keys(pages), "warc-keys")
    parts, bounds, hot = plan_parts(keys, parts)
    edges = [_order(b) for b in bounds]
    among = {tuple(key): -1 - i for i, (*key, _, _) in enumerate(hot)}

    @F.arrow_udf("int")
    def part_of(ids: pa.Array, urls: pa.Array, digests: pa.Array) -> pa.Array:
        keys = zip(ids.to_pylist(), urls.to_pylist(), digests.to_pylist(), strict=True)
        return pa.array([among.get(k) or bisect.bisect_right(edges, _order(k)) for k in keys], pa.int32())

    sha1 = F.sha1(F.coalesce("__html", F.lit("")).cast("binary")).alias("__sha1")
    place = part_of(*_KEY) if edges or among else F.lit(0)
    rows = pages.select("__id", "__url", "__html", sha1).withColumn("__part", place)
    if hot:
        ranges = spark.createDataFrame([(-1 - i, first, last) for i, (*_, first, last) in enumerate(hot)], "__part int, first int, last int")
        once = rows.filter("__part < 0").groupBy(*_KEY, "__part").agg(F.count(F.lit(1)).alias("n"), F.max("__html").alias("__html"))
        once = once.join(F.broadcast(ranges), "__part").withColumn("i", F.explode(F.expr("sequence(0L, n - 1)")))
        once = once.select("__id", "__url", "__html", "__sha1", F.expr("CAST(first + i * (last - first + 1) DIV n AS INT)").alias("__part"))
        rows = rows.filter("__part >= 0").unionByName(once)
    roles = _revisits(keys, least_bytes)
    roles = roles.withColumn("__part", place)
    if hot:  # each part of a hot key needs its role
        spread = roles.filter("__part < 0").join(F.broadcast(ranges), "__part").withColumn("__part", F.explode(F.sequence("first", "last"))).drop("first", "last")
        roles = roles.filter("__part >= 0").unionByName(spread)
    both = rows.withColumn("__refers", F.lit(None).cast("string")).unionByName(roles.withColumn("__html", F.lit(None).cast("string"))).withColumn("__page", F.col("__refers").isNull())
    ordered = both.repartitionById(parts, "__part").sortWithinPartitions(*_KEY, "__page").select(F.col("__id").cast("string"), "__url", "__html", "__sha1", "__refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        done: list[tuple] = []
        stream, records, size, sha = None, 0, 0, None
        role: tuple = (None, None)

        def names() -> tuple[str, str]:
            name = f"part-{part:06d}-{len(done):04d}.warc.gz"
            return name, f"{base}/.{name}.{attempt}"

        def close() -> None:
            name, temporary = names()
            stream.close()
            filesystem.move(temporary, f"{base}/{name}")
            done.append((name, part, len(done), records, size, sha.hexdigest()))

        try:
            for batch in batches:
                for page, url, html, sha1, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                    key = (page.as_py(), url.as_py(), sha1.as_py())
                    if refers.is_valid:
                        role = (key, refers.as_py())
                        continue
                    payload = (html.as_py() or "").encode()
                    raw = record(*key[:2], payload, payload_digest(payload), role[1] if role[0] == key else None, date)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    if stream is not None and size + len(member) > roll_bytes:
                        close()
                        stream = None
                    if stream is None:
                        stream, records, size, sha = filesystem.open_output_stream(names()[1], compression=None), 0, 0, hashlib.sha256()
                    stream.write(member)
                    sha.update(member)
                    records, size = records + 1, size + len(member)
            if stream is not None:
                close()
                stream = None
        finally:
            if stream is not None:
                stream.close()
                filesystem.delete_file(names()[1])
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "part", "seq", "records", "bytes", "sha256"])

    made = ordered.mapInArrow(write, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    store.sweep(spark, folder, ".part-*")
    store.drop(spark, keys_uri)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def parse(filesystem: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one file, one record in memory at a time."""
    with filesystem.open_input_stream(path, compression=None) as stream:
        data = stream.read(1 << 20)
        while data:
            member, raw = zlib.decompressobj(31), []
            while not member.eof:
                if not data and not (data := stream.read(1 << 20)):
                    raise ValueError(f"{path} ends inside a record")
                raw.append(member.decompress(data))
                data = member.unused_data
            data = data or stream.read(1 << 20)
            head, _, rest = b"".join(raw).partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            headers = dict(line.split(": ", 1) for line in lines)
            block = rest[: int(headers["Content-Length"])]
            if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{payload_digest(block)}":
                raise ValueError(f"a broken record in {path}")
            yield headers, block


def read_archive(manifest: DataFrame, folder: str, id_type: str = "bigint", with_html: bool = False) -> DataFrame:
    """Records of the files that the manifest names: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, and html of responses if ``with_html``.  Block and payload digests are
    checked; a mismatch raises."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["html"] * with_html]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.string()] * with_html]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for file in batch.column(0):
                rows, held = [], 0
                for headers, block in parse(filesystem, f"{base}/{file.as_py()}"):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"a payload in {file} doesn't match its header")
                    html = [(payload.decode() if kind == "response" else None)] * with_html
                    rows.append((headers.get("X-Page-Id"), headers.get("WARC-Target-URI"), size, digest, kind, headers.get("X-Refers-To-Page-Id"), *html))
                    held += len(payload) * with_html
                    if len(rows) >= 4096 or held >= 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", html string" * with_html
    files = manifest.select("file")
    spread = max(1, min(files.count(), 8 * store.default_parallelism(manifest.sparkSession)))
    return files.repartition(spread).mapInArrow(read, schema).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
