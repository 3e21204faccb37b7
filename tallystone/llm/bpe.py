"""Byte-level BPE by prefix dynamic programming.

In a byte-level BPE vocabulary exactly one token can end the encoding of a byte string. The table of a piece
holds that token for each of its prefixes; the encoding is read off backwards. As an entry depends on the
entries of at most one token's length before it, an append continues the table exactly, and an edit
recomputes only from the edit on until the table repeats itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a task keeps; beyond, it starts afresh.
CACHE_PIECES = 300_000
#: Longer pieces aren't kept.
CACHE_PIECE_CHARS = 64


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary with the tables that the prefix encoder needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=-1) + 1
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds all 256 single bytes")
        self.token: list[bytes] = [b""] * self.size
        for word, rank in ranks.items():
            self.token[rank] = word
        self.longest = max(map(len, ranks))
        #: token bytes -> rank; byte strings that only begin tokens -> -1
        self.trie: dict[bytes, int] = {}
        for word in ranks:
            for n in range(1, len(word)):
                self.trie.setdefault(word[:n], -1)
        self.trie.update(ranks)
        self._parts: list[tuple[int, int]] = [(r, r) for r in range(self.size)]
        self._joined: dict[int, int] = {}
        self._fits: dict[int, bool] = {}
        for word, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for n in range(len(word) - 1, 0, -1):
                left, right = ranks.get(word[:n], self.size), ranks.get(word[n:], self.size)
                if left < rank and right < rank and self._adjacent(left, right):
                    self._parts[rank] = (left, right)
                    self._joined[left * self.size + right] = rank
                    break
        self._fits.clear()

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens side by side: undo merges, latest first, and look for a merge
        across the border that would have come before the one undone."""
        bound = self.size
        while True:
            if self._joined.get(left * self.size + right, bound) < bound:
                return False
            first_left = left > right
            for side in (first_left, not first_left):
                if side:
                    inner = self._parts[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = self._parts[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
            else:
                return True

    def adjacent(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 500_000:
                self._fits.clear()
            known = self._fits[key] = self._adjacent(left, right)
        return known

    def forget(self) -> None:
        self._fits.clear()

    def encode(self, piece: bytes) -> list[int]:
        """The ids of a piece: the prefix table of PrefixTable, filled in one go and read off backwards."""
        get, fits, size, n = self.trie.get, self._fits.get, self.size, len(piece)
        whole = get(piece, -1)
        if whole >= 0:
            return [whole]
        last = [-1] * (n + 1)
        for start in range(n):
            base = last[start] * size
            for stop in range(start + 1, n + 1):
                rank = get(piece[start:stop])
                if rank is None:
                    break
                if rank >= 0 and last[stop] < 0:
                    fit = start == 0 or fits(base + rank)
                    if fit or fit is None and self.adjacent(last[start], rank):
                        last[stop] = rank
            if last[start + 1] < 0:
                raise ValueError(f"no token ends at byte {start + 1}: not a BPE vocabulary")
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.token[last[at]])
        return out[::-1]


class PrefixTable:
    """For each prefix of a byte string, the last token of its encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Continue exactly: entries of earlier prefixes stay as they are."""
        begin = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(begin, len(self.data), None)

    def _fill(self, begin: int, end: int, stop: list[int] | None) -> int:
        """Compute the entries after ``begin``. ``stop``: old entries of the same suffix, by distance from the
        end; once as many entries as the longest token has bytes repeat, the others do too. Gives the number
        of prefixes computed."""
        voc, data, last, trie = self.vocabulary, self.data, self.last, self.vocabulary.trie
        window, repeats = voc.longest, 0
        for start in range(max(0, begin - window), end):
            # every token that starts here may end a longer prefix
            if start > begin:
                if last[start] < 0:
                    raise ValueError(f"no token ends at byte {start}: not a BPE vocabulary")
                if stop is not None and end - start < len(stop):
                    repeats = repeats + 1 if stop[len(stop) - 1 - (end - start)] == last[start] else 0
                    if repeats >= window:
                        last[start + 1 :] = stop[len(stop) - (end - start) :]
                        return start - begin
            left, stop_at = last[start], start
            while stop_at < end:
                stop_at += 1
                rank = trie.get(data[start:stop_at])
                if rank is None:
                    break
                if rank >= 0 and stop_at > begin and last[stop_at] < 0 and (start == 0 or voc.adjacent(left, rank)):
                    last[stop_at] = rank
        if end > begin and last[end] < 0:
            raise ValueError(f"no token ends at byte {end}: not a BPE vocabulary")
        return end - begin

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at``; gives the number of prefixes that were computed anew."""
        old, tail = self.last, self.data[at + removed :]
        self.data = self.data[:at] + inserted + tail
        self.last = old[: at + 1] + [-1] * (len(inserted) + len(tail))
        return self._fill(at, len(self.data), old[at + removed :])

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.token[self.last[at]])
        return out[::-1]


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a file of lines of base64 bytes and rank."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


class Encoder:
    """Encodes whole texts; keeps the ids of short pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self._split = vocabulary, regex.compile(pattern).findall
        self._known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = np.array(self.vocabulary.encode(piece.encode("utf-8")), dtype="<u4").tobytes()
        if len(piece) <= CACHE_PIECE_CHARS:
            if len(self._known) >= CACHE_PIECES:
                self._known.clear()
            self._known[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, piece = self._known.get, self._piece
        return b"".join([known(p) or piece(p) for p in self._split(text)])

    def forget(self) -> None:
        """Drop what was kept: a worker lives on after a task, and other tasks need its memory."""
        self._known.clear()
        self.vocabulary.forget()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load(path), pattern)


def public_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = encoder(path, pattern)
    try:
        yield from _encoded(batches, coder, with_ids)
    finally:
        coder.forget()


def _encoded(batches: Iterator[pa.RecordBatch], coder: Encoder, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, ids_sha, text_sha, kept = [], [], [], []
        for text in batch.column(1):
            ids = coder.encode(text.as_py())
            count.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            if with_ids:
                kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
        columns = [batch.column(0), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and give digests of both (and the ids on request).

    (doc_id, n_tokens, ids_sha256 of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the
    decoded bytes[, ids]), one row per input row. Null texts count as empty: no ids. Repeated rows give
    repeated rows, equal texts equal values; an empty table gives an empty table; other columns don't matter.
    Each worker loads the vocabulary from ``path`` and keeps a bounded number of pieces.
    """
    default = public_vocabulary() if path is None or pattern is None else ("", "")
    path, pattern = path or default[0], pattern or default[1]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: encoded_batches(it, path, pattern, with_ids), schema)
