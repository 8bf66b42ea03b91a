"""Vectorised word boundaries and word hashes over Arrow string buffers.

A batch's texts are one UTF-8 buffer plus offsets; words are found on that buffer with numpy, and so
are short words hashed; longer ones are hashed once while a process remembers them.  Memory of a call
is about ten bytes per byte of the texts it is given, plus bounded temporaries; callers pass slices
of bounded size (a single longer text makes a slice of its own).
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, unless one text alone is longer.
SLICE_BYTES = 2 << 20

#: ASCII white space of the word patterns: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Words of at most so many bytes are hashed as two numbers, longer ones by digest.
_SHORT = 15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Digests of longer words that a process keeps at most; words above this many bytes aren't kept.
_KEPT_WORDS, _KEPT_BYTES = 1 << 14, 64


class _Digests(dict):
    """16-byte digests of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= _KEPT_BYTES:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = digest
        return digest


_DIGESTS = _Digests()


#: What other operators keep in this process; given up when a user of this module runs here, so that a
#: worker that serves several operators in turn holds the memory of one.
KEPT: list[dict] = []


def trim() -> None:
    """Give freed memory back to the system: workers wait for their next task with little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _give_up() -> None:
    if any(KEPT):
        for kept in KEPT:
            kept.clear()
        trim()


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets int64, bytes uint8) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(n + 1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets, bytes) over consecutive rows of at most ``limit`` bytes."""
    _give_up()
    offsets, raw = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, offsets[first : end + 1] - offsets[first], raw[offsets[first] : offsets[end]]
        first = end
    trim()


def words(offsets: np.ndarray, raw: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in ``raw`` and the first word index of each row (rows + 1 long)."""
    inside = ~separators[raw]
    begins, stops = inside.copy(), inside.copy()
    if len(raw):
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = inside[edges]
        stops[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word's bytes; ``which`` (0 or 1) picks one of two.

    A short word is two numbers, the second with the length in its top byte, put through bijections and
    mixed: of words with the same first eight bytes, and of words of one length of at most eight, no two
    have one hash.  A longer word has half of its 128-bit BLAKE2b digest.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    lengths = ends - starts
    padded = np.concatenate([raw, np.zeros(16, dtype=np.uint8)])
    eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    for a in range(0, len(starts), 1 << 14):  # temporaries stay small
        begin, size = starts[a : a + (1 << 14)], np.minimum(lengths[a : a + (1 << 14)], _SHORT)
        head = mix((eight[begin] & _MASKS[np.minimum(size, 8)]) + _ODD[which])
        tail = size.astype(np.uint64) << np.uint64(56)
        more = np.flatnonzero(size > 8)
        tail[more] |= eight[begin[more] + 8] & _MASKS[size[more] - 8]
        out[a : a + (1 << 14)] = mix(head ^ tail * _ODD[1 - which])
    rest = np.flatnonzero(lengths > _SHORT)
    if len(rest):
        data = raw.tobytes()
        joined = b"".join([_DIGESTS[data[a:b]] for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        out[rest] = np.frombuffer(joined, dtype="<u8")[which::2]
    return out


def window_hashes(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` consecutive word hashes, made by doubling; entry i covers
    words i to i + length - 1, so the result is ``length - 1`` shorter (empty if negative).

    Runs are joined by a mixing step that isn't linear; where the length is no power of two, two
    overlapping runs identify the longer one."""
    if len(h) < length:
        return np.empty(0, dtype=np.uint64)
    have, size = h, 1
    while size < length:
        step = min(size, length - size)
        have = mix(mix(have[: len(have) - step] + _ODD[which]) ^ have[step:] * _ODD[1 - which])
        size += step
    return have if length > 1 else mix(have)
