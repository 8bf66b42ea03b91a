"""Media columns: content-addressed payloads in tar shards.

Each task packs its distinct media objects into one tar shard, named by content digest, under a
temporary name that a rename commits.  Rows carry digest, offset and length.  Metadata columns are
filled by range reads of the objects' headers alone, features by range reads of whole objects.
A content is stored once in each shard that holds a row of it, so no payload is shuffled and a hot
content costs one copy a shard.

Objects are 8-bit greyscale PNG images of 64 rows: losslessly compressed 8-bit samples.

Defined cases: null is the empty payload; equal texts give equal values; an empty table writes no
shard; repeated rows and null ids stay; other columns are ignored; a payload is held in memory whole.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: Payloads are padded to a positive multiple of this; an image has as many rows.
UNIT = 64
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Media bytes that a reading task gets, about; fewer while that leaves tasks of this many rows idle.
READ_BYTES, READ_ROWS = 64 << 20, 256
#: Bytes that hold an image's signature and header chunk.
HEADER_BYTES = 33


def pad(payload: bytes) -> bytes:
    """Payload with zero bytes appended up to a positive multiple of ``UNIT``."""
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes) -> bytes:
    """Lossless 8-bit greyscale image of ``UNIT`` rows; no row filter, so samples are the bytes."""
    width = len(samples) // UNIT
    rows = np.zeros((UNIT, width + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(samples, dtype=np.uint8).reshape(UNIT, width)
    return PNG_MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, UNIT, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from an object's first bytes."""
    if head[:8] != PNG_MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(media: bytes) -> bytes:
    """Samples of an image that ``to_png`` made."""
    width, height, _ = png_header(media)
    at, data = 8, []
    while at < len(media):
        length, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + length])
        at += length + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the texts into tar shards below ``folder``; returns (and stores) the rows' addresses:
    ``id_col``, ``n_bytes``, ``digest``, ``shard``, ``offset``, ``length``.

    A retried task writes the same bytes under its own temporary name; the rename is the commit.
    """
    spark = docs.sparkSession
    store.bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, digest string, shard string, offset bigint, length bigint"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        name = f"shard-{task.partitionId():06d}.tar"
        temporary, shard, known, at = f"{base}/.{name}.{task.taskAttemptId()}", None, {}, 0
        try:
            for batch in batches:
                out: list[list] = [[], [], [], []]
                for text in batch.column(1):
                    text = (text.as_py() or "").encode()
                    content = hashlib.sha256(text).digest()
                    if content not in known:
                        media = to_png(pad(text))
                        digest = hashlib.sha256(media).hexdigest()
                        if shard is None:
                            shard = filesystem.open_output_stream(temporary, compression=None)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        shard.write(head + media + bytes(-len(media) % 512))
                        known[content] = (digest, at + len(head), len(media))
                        at += len(head) + len(media) + -len(media) % 512
                    for column, value in zip(out, (len(text), *known[content]), strict=True):
                        column.append(value)
                sizes, digests, offsets, lengths = out
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array([name] * len(sizes), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], [id_col, "n_bytes", "digest", "shard", "offset", "length"])
        except BaseException:
            if shard is not None:
                shard.close()
                filesystem.delete_file(temporary)
            raise
        if shard is not None:
            shard.write(bytes(1024))
            shard.close()
            filesystem.move(temporary, f"{base}/{name}")

    rows, _ = store.write_table(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(pack, schema), "media-rows")
    return _spread(rows)


def _spread(rows: DataFrame) -> DataFrame:
    """Written ``rows`` dealt out by the bytes they refer to, in ranges of places: reads follow the media,
    not the small table of addresses."""
    total, n = rows.agg(F.sum("length"), F.count(F.lit(1))).first()
    few = min(store.default_parallelism(rows.sparkSession), n // READ_ROWS + 1)
    return rows.repartitionByRange(max(-(-(total or 0) // READ_BYTES), few), "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batch: pa.RecordBatch, folder: str, most: int | None) -> Iterator[tuple[tuple, bytes | None]]:
    """Each row's (shard, offset, length) with its bytes, ``most`` at most, read in row order; a
    range asked for before in the batch comes as None."""
    filesystem, base = pafs.FileSystem.from_uri(folder)
    columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "length")]
    opened, file, seen = None, None, set()
    for where in zip(*columns, strict=True):
        if where in seen:
            yield where, None
            continue
        seen.add(where)
        if where[0] != opened:
            opened, file = where[0], filesystem.open_input_file(f"{base}/{where[0]}")
        yield where, file.read_at(where[2] if most is None else min(most, where[2]), where[1])


def read_headers(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``width``, ``height``, ``bit_depth`` from range reads of the headers alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}
            out = []
            for where, head in _ranges(batch, folder, HEADER_BYTES):
                if head is not None:
                    known[where] = png_header(head)
                out.append(known[where])
            arrays = [pa.array([x[i] for x in out], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "width", "height", "bit_depth"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", width int, height int, bit_depth int")


def features(samples: bytes) -> str:
    """Text form of simple sample statistics: mean and spread in thousandths, distinct values."""
    counts = np.bincount(np.frombuffer(samples, dtype=np.uint8), minlength=256).astype(object)
    n = int(counts.sum())
    total = sum(int(c) * v for v, c in enumerate(counts))
    squares = sum(int(c) * v * v for v, c in enumerate(counts))
    return f"png8:{n // UNIT}x{UNIT}:mean{total * 1000 // n}:var{(squares * n - total * total) * 1000 // (n * n)}:kinds{sum(1 for c in counts if c)}"


def read_features(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``payload_bytes``, ``payload_sha256``, ``tail_crc32``, ``media_bytes``,
    ``media_sha256`` and ``feature``, computed from the stored bytes; an object whose bytes don't
    have the digest its row carries raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, tuple] = {}
            out = []
            digests = batch.column(batch.schema.get_field_index("digest"))
            for i, (where, media) in enumerate(_ranges(batch, folder, None)):
                if media is not None:
                    digest = hashlib.sha256(media).hexdigest()
                    if digest != digests[i].as_py():
                        raise ValueError(f"{where} doesn't hold the object {digests[i]}")
                    payload = from_png(media)
                    known[where] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), digest, features(payload))
                out.append(known[where])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
