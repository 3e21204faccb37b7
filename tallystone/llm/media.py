"""ISO base media containers: write, walk and describe them without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A stored picture: 8 x 8 pixels of three 8-bit samples.
SIDE, FRAME_BYTES = 8, 192
TIMESCALE, TICKS_PER_FRAME = 600, 24
#: Every so many pictures one is listed as a sync sample.
SYNC_EVERY = 16

# Fixed values of the file format: boxes that hold boxes, and how many bytes precede their children.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"mfra": 0, b"meta": 4, b"stsd": 8}
# Fixed values of the file format: bytes of a sample entry ahead of its own boxes, by handler.
ENTRY_BYTES = {b"vide": 78, b"soun": 28}


class BadContainer(ValueError):
    """The bytes are no ISO media container, or its tables contradict each other."""


# ---------------------------------------------------------------- writing


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(raw: bytes, unit: int = FRAME_BYTES) -> bytes:
    """``raw`` with spaces appended up to a positive multiple of ``unit``."""
    return raw + b" " * (unit - len(raw) if not raw else -len(raw) % unit)


_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, frame: int = FRAME_BYTES, sync_every: int = SYNC_EVERY) -> bytes:
    """A container with one uncompressed video track whose samples are the frames of ``payload``.

    The same payload always gives the same bytes: no times of writing, no identifiers.
    """
    if not payload or len(payload) % frame:
        raise ValueError("the payload is a positive multiple of the frame size")
    n = len(payload) // frame
    length = n * TICKS_PER_FRAME
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH32sHh", SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"\x03raw", 24, -1))
    syncs = np.arange(1, n + 1, sync_every, dtype=">u4")
    stbl_head = box(b"stsd", struct.pack(">II", 0, 1), entry) + full_box(b"stts", 0, struct.pack(">III", 1, n, TICKS_PER_FRAME)) + full_box(b"stss", 0, struct.pack(">I", len(syncs)), syncs.tobytes())
    stbl_head += full_box(b"stsc", 0, struct.pack(">IIII", 1, 1, n, 1)) + full_box(b"stsz", 0, struct.pack(">II", frame, n))

    def moov(start: int) -> bytes:
        stbl = box(b"stbl", stbl_head, full_box(b"co64", 0, struct.pack(">IQ", 1, start)))
        dinf = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        minf = box(b"minf", full_box(b"vmhd", 1, bytes(8)), dinf, stbl)
        mdhd = full_box(b"mdhd", 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1)
        hdlr = full_box(b"hdlr", 0, bytes(4), b"vide", bytes(12), b"\0")
        tkhd = full_box(b"tkhd", 7, struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">HHHH", 0, 0, 0, 0), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), version=1)
        mvhd = full_box(b"mvhd", 0, struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, length, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    data_head = struct.pack(">I4sQ", 1, b"mdat", n * frame + 16)
    start = len(head) + len(moov(0)) + len(data_head)
    return head + moov(start) + data_head + payload


# ---------------------------------------------------------------- reading


@dataclass
class Track:
    """One track: sample tables decoded to arrays, payload bytes untouched."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def keyframes(self) -> list[tuple[int, int]]:
        """(first byte, bytes) of each sync sample."""
        return list(zip(self.offsets[self.sync].tolist(), self.sizes[self.sync].tolist(), strict=True))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of the boxes between two places; sizes 0 and 1 as the format has them."""
    while end - start >= 8:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise BadContainer("a box is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            raise BadContainer(f"box {kind!r} ends outside of its parent")
        yield kind, body, start + size
        start += size


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the body, end) of every box, parents first. Bodies of leaves aren't read."""
    view = memoryview(data)
    for kind, body, stop in boxes(view, start, len(view) if end is None else end):
        here = (*path, kind)
        yield here, body, stop
        skip = CONTAINERS.get(kind)
        if skip is not None and stop - body >= skip:
            if kind == b"meta" and view[body + 4 : body + 8] in (b"hdlr", b"mhdr"):
                skip = 0  # the older form without version and flags
            if kind != b"stsd":
                yield from walk(view, body + skip, stop, here)


def _table(view: memoryview, body: int, end: int, columns: str) -> np.ndarray:
    """A counted table of big-endian unsigned columns (I or Q) after version and flags."""
    (n,) = struct.unpack_from(">I", view, body + 4)
    kind = np.dtype([(str(i), ">u8" if c == "Q" else ">u4") for i, c in enumerate(columns)])
    if body + 8 + n * kind.itemsize > end:
        raise BadContainer("a sample table is longer than its box")
    raw = np.frombuffer(view, kind, n, body + 8)
    return np.stack([raw[str(i)].astype(np.int64) for i in range(len(columns))], axis=1) if n else np.zeros((0, len(columns)), np.int64)


def _codec(view: memoryview, body: int, end: int, handler: bytes) -> str:
    """The codec string of the first sample entry, with profile and level where the entry has them."""
    for kind, inner, stop in boxes(view, body + 8, end):
        name = kind.decode("latin-1").strip()
        skip = ENTRY_BYTES.get(handler)
        if skip is not None and stop - inner > skip:
            for sub, at, _ in boxes(view, inner + skip, stop):
                if sub == b"avcC":
                    return f"{name}.{bytes(view[at + 1 : at + 4]).hex()}"
                if sub == b"esds":
                    found = bytes(view[at:stop]).find(b"\x05", 4)
                    kind_at = bytes(view[at:stop]).find(b"\x04", 4)
                    if 0 <= kind_at < found:
                        length = 1
                        while view[at + kind_at + length] & 0x80:
                            length += 1
                        wide = 1
                        while view[at + found + wide] & 0x80:
                            wide += 1
                        return f"{name}.{view[at + kind_at + length + 1]:02x}.{view[at + found + wide + 1] >> 3}"
        return name
    return ""


def _track(view: memoryview, body: int, end: int) -> Track:
    track, handler, found, entries = Track(), b"", {}, None
    for path, at, stop in walk(view, body, end):
        kind = path[-1]
        if kind == b"mdhd":
            wide = view[at] == 1
            track.timescale, track.duration = struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))
        elif kind == b"hdlr" and path[0] == b"mdia" and len(path) == 2:
            handler = bytes(view[at + 8 : at + 12])
        elif kind == b"stsd":
            entries = (at, stop)
        elif kind in (b"stts", b"stsc", b"stss", b"stco", b"co64", b"stsz", b"stz2"):
            found[kind] = (at, stop)
    track.handler = handler.decode("latin-1")
    if entries:
        track.codec = _codec(view, *entries, handler)
    if b"stsz" in found:
        at, stop = found[b"stsz"]
        size, n = struct.unpack_from(">II", view, at + 4)
        if size:
            track.sizes = np.full(n, size, np.int64)
        else:
            if at + 12 + 4 * n > stop:
                raise BadContainer("a sample table is longer than its box")
            track.sizes = np.frombuffer(view, ">u4", n, at + 12).astype(np.int64)
    elif b"stz2" in found:
        at, stop = found[b"stz2"]
        width, n = struct.unpack_from(">II", view, at + 4)
        raw = np.frombuffer(view[at + 12 : stop], np.uint8)
        track.sizes = {4: lambda: np.stack([raw >> 4, raw & 15], 1).ravel(), 8: lambda: raw, 16: lambda: raw[: len(raw) // 2 * 2].view(">u2")}[width & 255]()[:n].astype(np.int64)
    n = len(track.sizes)
    runs = _table(view, *found[b"stts"], "II") if b"stts" in found else np.zeros((0, 2), np.int64)
    steps = np.repeat(runs[:, 1], runs[:, 0])
    track.times = np.cumsum(steps) - steps
    where = _table(view, *found[b"co64"], "Q")[:, 0] if b"co64" in found else _table(view, *found[b"stco"], "I")[:, 0] if b"stco" in found else np.zeros(0, np.int64)
    per = _table(view, *found[b"stsc"], "III") if b"stsc" in found else np.zeros((0, 3), np.int64)
    if n:
        if not len(per) or not len(where):
            raise BadContainer("samples without chunks")
        first = np.minimum(per[:, 0] - 1, len(where))
        held = np.repeat(per[:, 1], np.diff(np.append(first, len(where))))
        if int(held.sum()) < n:
            raise BadContainer("the chunks hold fewer samples than there are sizes")
        chunk = np.repeat(np.arange(len(held)), held)[:n]
        before = np.cumsum(track.sizes) - track.sizes
        opens = np.ones(n, bool)
        opens[1:] = chunk[1:] != chunk[:-1]
        base = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        track.offsets = where[chunk] + before - before[base]
    track.sync = np.arange(n) if b"stss" not in found else _table(view, *found[b"stss"], "I")[:, 0] - 1
    track.sync = track.sync[track.sync < n]
    return track


def tracks(data: bytes | memoryview) -> list[Track]:
    """All tracks of a container; payloads are neither read nor decoded."""
    view = memoryview(data)
    out = [_track(view, body, end) for path, body, end in walk(view) if path == (b"moov", b"trak")]
    if not out:
        raise BadContainer("no track")
    return out


def sample_bytes(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track's samples in order."""
    view = memoryview(data)
    if len(track.offsets) and int((track.offsets + track.sizes).max()) > len(view):
        raise BadContainer("a sample lies outside of the file")
    joined = (track.offsets[1:] == track.offsets[:-1] + track.sizes[:-1]) if len(track.offsets) else np.zeros(0, bool)
    edges = np.flatnonzero(np.concatenate([[True], ~joined])) if len(track.offsets) else np.zeros(0, np.int64)
    stops = np.append(edges[1:], len(track.offsets))
    return b"".join(view[int(track.offsets[a]) : int(track.offsets[b - 1] + track.sizes[b - 1])] for a, b in zip(edges.tolist(), stops.tolist(), strict=True))


def feature(track: Track) -> str:
    """Codec, seconds, number of samples and the byte ranges of the keyframes."""
    ranges = ",".join(f"{a}-{a + n - 1}" for a, n in track.keyframes())
    return f"codec={track.codec};seconds={track.seconds:.3f};samples={len(track.sizes)};keyframes={ranges}"


# ---------------------------------------------------------------- columns

MEDIA_SCHEMA = "codec string, seconds double, samples long, keyframes array<struct<first: long, bytes: long>>, error string"


def media_columns(df: DataFrame, media_col: str, *, id_col: str) -> DataFrame:
    """Codec, duration and keyframe byte ranges of each container's first video track, or else first track.

    Bytes that are no container give nulls and a reason in ``error``, as null and empty bytes do. The whole
    file is never decoded: boxes are walked and sample tables read. Repeated rows give repeated rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out_type = pa.list_(pa.struct([("first", pa.int64()), ("bytes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for cell in batch.column(1):
                try:
                    found = tracks(cell.as_py() or b"")
                    best = next((t for t in found if t.handler == "vide"), found[0])
                    made.append((best.codec, best.seconds, len(best.sizes), [{"first": a, "bytes": n} for a, n in best.keyframes()], None))
                except (BadContainer, struct.error, IndexError, ValueError) as why:
                    made.append((None, None, None, None, str(why) or type(why).__name__))
            types = [pa.string(), pa.float64(), pa.int64(), out_type, pa.string()]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "codec", "seconds", "samples", "keyframes", "error"])

    return df.select(id_col, F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"`{id_col}` {kind}, {MEDIA_SCHEMA}")


def stored_batches(batches: Iterator[pa.RecordBatch], with_media: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        files: list[bytes] = []
        for cell in batch.column(1):
            raw = cell.as_py().encode("utf-8")
            media = mux(padded(raw))
            track = tracks(media)[0]
            back = sample_bytes(media, track)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(track)))
            if with_media:
                files.append(media)
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *([pa.array(files, pa.binary())] if with_media else [])], names=[*names, *(["media"] if with_media else [])])


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Store each whole text as samples of a container, read it back, and give digests and features.

    The UTF-8 bytes, with spaces up to a positive multiple of 192, become 8 x 8 pictures of 8-bit samples;
    the pictures are read back through the container's own boxes and sample tables. ``feature`` holds codec,
    duration and keyframe byte ranges; ``with_media`` adds the file. Null texts count as empty (one picture of
    spaces); equal texts give equal values; an empty table gives an empty table; other columns don't matter.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + (", media binary" if with_media else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: stored_batches(it, with_media), schema)
