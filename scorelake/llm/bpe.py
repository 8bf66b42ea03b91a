"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can be the last one of its BPE
encoding.  An Aho-Corasick automaton over the vocabulary gives the suffix matches, that is the tokens
that end at each position; a token is the last one of a prefix if it is compatible with the last
token of the prefix before it, that is, if BPE would leave the border between the two alone.
The table of last tokens is filled left to right and followed backwards to emit the ids, so time is
linear in the text however long a pre-token is.

Defined cases: null encodes like the empty text (no ids); the special token's string inside a text
is that special token, as the library treats it by default; texts of any length are encoded whole.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textbuf

#: Pre-token pattern of byte-level BPE files that set use_regex (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 62
#: Entries after which a process empties its caches; they save time only.
CACHE_WORDS, CACHE_PAIRS, CACHED_LENGTH = 150_000, 200_000, 64


#: White space right before a blank.
_RUN = re.compile(r"\s ")


def _keep(cache: dict[str, str], key: str, value: str) -> dict[str, str]:
    cache = {} if len(cache) >= CACHE_WORDS else cache
    cache[key] = value
    return cache


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte, as byte-level vocabularies spell them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeCodec:
    """Encoder and decoder of one byte-level BPE file (tokenizers JSON)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        spelled = {s: bytes(alphabet[c] for c in s) for s in spec["model"]["vocab"]}
        ids = spec["model"]["vocab"]
        self.bytes_of = {str(i): spelled[s] for s, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {str(i): s.encode() for s, i in self.special.items()}
        self._size = [0] * (max([*ids.values(), *self.special.values()]) + 1)
        for s, i in ids.items():
            self._size[i] = len(spelled[s])

        # rank and parts of every merge; a token's own rank is the rank of the merge that makes it
        self._merge: dict[int, int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = ids[a], ids[b]
            self._merge.setdefault(left << 20 | right, rank)
            self._parts.setdefault(ids[a + b], (left, right, rank))
        self._edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self._automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            if s not in self.special and self._encodes_to_itself(i):
                self._automaton.add_word(spelled[s].decode("latin-1"), i)
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._words: dict[str, str] = {}
        self._fresh: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._split = regex.compile(PATTERN)
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Parts of ``token`` along its right (1) or left (0) edge, each with the rank at which a
        merge inside the token consumes it (never, for the token itself)."""
        out = self._edges[side].get(token)
        if out is None:
            out, part = [(token, _NEVER)], token
            while (made := self._parts.get(part)) is not None:
                part = made[side]
                out.append((part, made[2]))
            self._edges[side][token] = out
        return out

    def _border_holds(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge ranked below ``limit`` joins parts of ``left`` and ``right`` across
        their border.  A part takes part while it isn't consumed; on equal rank the merge further
        left comes first."""
        rights, merges = self._spine(right, 0), self._merge
        for a, a_until in self._spine(left, 1):
            a <<= 20
            for b, b_until in rights:
                rank = merges.get(a | b)
                if rank is not None and rank < limit and rank < a_until and rank <= b_until:
                    return False
        return True

    def _encodes_to_itself(self, token: int) -> bool:
        made = self._parts.get(token)
        return made is None or self._border_holds(made[0], made[1], made[2])

    def _pre_token(self, word: str) -> str:
        """Comma-joined ids of one pre-token."""
        text = word.encode("utf-8", "surrogatepass").decode("latin-1")
        size, fits = self._size, self._fits
        last = [-1] * (len(text) + 1)
        for end, token in self._automaton.iter(text):
            if last[end] >= 0:
                continue
            start = end - size[token]  # the table's index is the place of a prefix's last byte
            if start >= 0:
                before = last[start]
                key = before << 20 | token
                holds = fits.get(key)
                if holds is None:
                    if len(fits) >= CACHE_PAIRS:
                        fits.clear()
                    holds = fits[key] = self._border_holds(before, token, _NEVER)
                if not holds:
                    continue
            last[end] = token
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(str(token := last[at]))
            at -= size[token]
        return ",".join(ids[::-1])

    def _piece(self, piece: str) -> str:
        """Ids of a stretch of text that starts and ends at borders of pre-tokens."""
        out, words = [], self._split.findall(piece)
        if len(words) == 1:  # the caller remembers the whole piece
            return self._words.get(piece) or self._pre_token(piece)
        for word in words:
            ids = self._words.get(word)
            out.append(self._pre_token(word) if ids is None else ids)
            if ids is None and len(word) <= CACHED_LENGTH:
                self._words = _keep(self._words, word, out[-1])
        return ",".join(out)

    def _plain(self, text: str) -> list[str]:
        """Ids of a text without special tokens, in stretches.  White space after anything else
        starts a pre-token, so text without white space before a blank can be cut at its blanks."""
        if not text:
            return []
        if _RUN.search(text):
            return [self._piece(text)]
        head, *rest = text.split(" ")
        out = [self._piece(head)] if head else []
        fresh, older = self._fresh, self._older
        for piece in rest:
            ids = fresh.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = self._piece(" " + piece)
                if len(piece) <= CACHED_LENGTH:
                    if len(fresh) >= CACHE_WORDS:
                        self._older, self._fresh = older, fresh = fresh, {}
                    fresh[piece] = ids
            out.append(ids)
        return out

    def encode_joined(self, text: str) -> str:
        """Decimal ids of a whole text, joined by commas."""
        if self._specials is None or not self._specials.search(text):
            return ",".join(self._plain(text))
        out, at = [], 0
        for found in self._specials.finditer(text):
            out += [*self._plain(text[at : found.start()]), str(self.special[found.group()])]
            at = found.end()
        return ",".join([*out, *self._plain(text[at:])])

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return list(map(int, joined.split(","))) if joined else []

    def decode_joined(self, joined: str) -> str:
        """Text of comma-joined ids; bytes that aren't UTF-8 become replacement characters."""
        if not joined:
            return ""
        return b"".join(map(self.bytes_of.__getitem__, joined.split(","))).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


_CODECS: dict[str, BpeCodec] = {}
textbuf.KEPT.append(_CODECS)


def codec(path: str) -> BpeCodec:
    """One codec for each file and process."""
    if path not in _CODECS:
        _CODECS[path] = BpeCodec(path)
    return _CODECS[path]


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """The codec makes no cycles; collecting garbage over its many small objects halves its speed."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def resolve(tokenizer: str) -> str:
    """Path of a tokenizer file: as given if it exists, else that of the installed vocabularies."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def encode_decode(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = True,
    with_text: bool = True,
) -> DataFrame:
    """Encode every whole text and decode the ids again, row by row and without a shuffle.

    Returns ``id_col``, ``n_tokens``, ``ids`` (comma-joined decimal, if ``with_ids``), ``decoded``
    (if ``with_text``), ``ids_sha256`` and ``decoded_sha256``.  One row for each input row: null
    texts have no ids, repeated rows and null ids stay, other columns are ignored.
    """
    store.bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    wanted = [("ids", pa.string())] * with_ids + [("decoded", pa.string())] * with_text
    schema = f"`{id_col}` {id_type}, n_tokens bigint" + "".join(f", {n} string" for n, _ in wanted) + ", ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(resolve(tokenizer))
        names = [id_col, "n_tokens", *(n for n, _ in wanted), "ids_sha256", "decoded_sha256"]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                out: dict[str, list] = {name: [] for name in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
                with no_collection():
                    for text in part.column(1):
                        ids = bpe.encode_joined(text.as_py() or "")
                        decoded = bpe.decode_joined(ids)
                        out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                        out["ids"].append(ids if with_ids else None)
                        out["decoded"].append(decoded if with_text else None)
                        out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                arrays = [part.column(0), pa.array(out["n_tokens"], pa.int64()), *(pa.array(out[n], t) for n, t in wanted), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)
            textbuf.trim()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
