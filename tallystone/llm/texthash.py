"""Vectorised hashing of words and word shingles over Arrow string buffers (numpy, no per-row loop)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53), U64(0x9E3779B97F4A7C15)
_S33 = U64(33)
_POW_N = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = U64(1)
    return np.multiply.accumulate(out)


_POW = _powers(0x9E3779B97F4A7C15 | 1, _POW_N)
_STEP = _powers(0xD6E8FEB86659FD93, 64)

#: Bytes of a word of a shingle: ASCII letters, digits, underscore, and every byte of a non-ASCII character.
SHINGLE_BYTES = np.zeros(256, dtype=bool)
SHINGLE_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
#: Bytes of a token that ends at white space only.
SOLID_BYTES = np.ones(256, dtype=bool)
SOLID_BYTES[[32, *range(9, 14)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words; returns a new array."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix64(x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without nulls; offsets has one entry more than rows."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


#: Bytes, words or cells that are worked on at once.
PIECE = 1 << 20


def _inside(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the bytes from ``a`` to ``b``: whether each is part of a word, and whether a word starts there."""
    inside = table[data[a:b]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    if a:
        first[0] &= not table[data[a - 1]]
    edge = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
    first[edge] = inside[edge]
    return inside, first


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SHINGLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in ``data``) of all words, and the word offsets of the rows.

    A word is a maximal run of the bytes that ``table`` marks, within one row. Bytes are looked at in pieces; a
    word that goes on in the next piece keeps its place and its sum.
    """
    sums: list[np.ndarray] = []
    all_starts: list[np.ndarray] = []
    all_lengths: list[np.ndarray] = []
    run = 0  # length so far of the word that the piece before ended in
    for a in range(0, len(data), PIECE):
        inside, first = _inside(data, offsets, table, a, min(a + PIECE, len(data)))
        if not inside.any():
            run = 0
            continue
        goes_on = bool(inside[0] and not first[0])
        run = run if goes_on else 0
        begins = np.flatnonzero(first)
        at = np.cumsum(inside) - 1  # place of a byte among those of words
        begin = at[begins]
        if goes_on:
            begin = np.append(0, begin)
        count = int(at[-1]) + 1
        lengths = np.diff(np.append(begin, count))
        place = np.arange(count, dtype=np.int64) - np.repeat(begin, lengths)
        if goes_on:
            place[: lengths[0]] += run
        value = data[a : a + PIECE][inside].astype(U64)
        value += U64(1)
        value *= _POW[place % _POW_N]
        if run + int(lengths.max()) > _POW_N:
            value *= np.where(place < _POW_N, U64(1), _STEP[(place // _POW_N) % 64] | U64(1))
        own = np.add.reduceat(value, begin)
        if goes_on:
            sums[-1][-1] += own[0]
            all_lengths[-1][-1] += lengths[0]
            own = own[1:]
        if len(begins):
            sums.append(own)
            all_starts.append(begins + a)
            all_lengths.append(lengths[1:] if goes_on else lengths)
        run = int(all_lengths[-1][-1]) if inside[-1] else 0
    if not sums:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64)
    hashed, starts, lengths = np.concatenate(sums), np.concatenate(all_starts), np.concatenate(all_lengths)
    del sums, all_starts, all_lengths
    for a in range(0, len(hashed), PIECE):
        hashed[a : a + PIECE] = mix64(hashed[a : a + PIECE] ^ (lengths[a : a + PIECE].astype(U64) * _GOLD))
    lengths += starts
    return hashed, starts, lengths, np.searchsorted(starts, offsets, side="left").astype(np.int64)


def _row_sums(values: Callable[[int, int], np.ndarray], rows: np.ndarray) -> np.ndarray:
    """Sums by row of values that are made in pieces."""
    out = np.zeros(len(rows) - 1, U64)
    for a in range(int(rows[0]), int(rows[-1]), PIECE):
        b = min(a + PIECE, int(rows[-1]))
        edges = np.clip(rows, a, b) - a
        some = np.flatnonzero(np.diff(edges))
        out[some] += np.add.reduceat(values(a, b), edges[:-1][some])
    return out


def row_keys(words: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (two arrays) for the sequence of words of each row; of the bytes for a row without words."""
    count = np.diff(rows)
    place = lambda a, b: (np.arange(a, b) - np.repeat(rows[:-1], np.diff(np.clip(rows, a, b)))).astype(U64)
    one = _row_sums(lambda a, b: mix64(words[a:b] ^ mix64(place(a, b) + _GOLD)), rows)
    two = _row_sums(lambda a, b: mix64(words[a:b] + mix64(place(a, b) + _GOLD) * _M1), rows)
    for i in np.flatnonzero(count == 0):
        own = offsets[i : i + 2]
        spot = lambda a, b, own=own: mix64(np.arange(a - own[0], b - own[0]).astype(U64) + _M2)
        one[i] = mix64(_row_sums(lambda a, b: mix64(data[a:b].astype(U64) ^ spot(a, b)), own))[0]  # noqa: B023
        two[i] = mix64(_row_sums(lambda a, b: mix64(data[a:b].astype(U64) + spot(a, b) * _M1), own))[0]  # noqa: B023
    extra = count.astype(U64)
    return mix64(one + extra * _GOLD), mix64(two ^ (extra * _M2))


def shingle_cells(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, offsets): a hash for each occurrence of each n-word shingle of each row, sorted within rows.

    The i-th occurrence of a shingle in a row is a cell of its own, so a row's cells are a set whose Jaccard
    similarity is the weighted Jaccard similarity of shingle counts. A row of 1 to n - 1 words has one
    shingle of all of them; a row without words has none.
    """
    count = np.diff(rows)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out = np.concatenate([np.zeros(1, np.int64), np.cumsum(made)])
    total = int(out[-1])
    if not total:
        return np.zeros(0, U64), out
    rolled = np.empty(total, U64)
    padded = np.concatenate([words, np.zeros(n - 1, U64)])
    for a in range(0, total, PIECE):
        b = min(a + PIECE, total)
        at = np.arange(a, b) + np.repeat(rows[:-1] - out[:-1], np.diff(np.clip(out, a, b)))
        part = np.zeros(b - a, U64)
        for j in range(n):
            part += padded[at + j] * _STEP[j + 1]
        rolled[a:b] = part
    for i in np.flatnonzero((count > 0) & (count < n)):
        own = words[rows[i] : rows[i + 1]]
        rolled[out[i]] = (own * _STEP[1 : len(own) + 1]).sum(dtype=U64) + U64(len(own))
    for a in range(0, total, PIECE):
        rolled[a : a + PIECE] = mix64(rolled[a : a + PIECE])
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        rolled[a:b].sort()
    fresh = np.ones(total, bool)
    fresh[1:] = rolled[1:] != rolled[:-1]
    fresh[out[:-1][made > 0]] = True
    again = np.flatnonzero(~fresh)
    if len(again):
        news = np.flatnonzero(fresh)
        for a in range(0, len(again), PIECE):
            own = again[a : a + PIECE]
            copy = own - news[np.searchsorted(news, own) - 1]
            rolled[own] = mix64(rolled[own] + copy.astype(U64) * _GOLD)
    return rolled, out
