"""A PySpark data source for WARC archives: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Archives are gzip files of one member per record, so a record can be read alone. Beside each archive the
writer leaves an index of where its records start. The reader plans partitions of about ``splitBytes`` from
files and indexes, takes predicates on record type and header columns, parses a record's headers first, and
inflates payloads only of records that pass. Archives without an index, and plain ones, are read in order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tallystone.llm.scratch import Scratch

READ_SCHEMA = "file string, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, headers map<string,string>, payload binary, payload_bytes long, payload_sha1 string"
WRITE_SCHEMA = "record_id string, target_uri string, refers_to string, payload binary"
#: Columns that a record's headers hold, and the header of each.
HEADER_COLUMNS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
SPLIT_BYTES = 32 << 20
FILE_BYTES = 256 << 20
HEAD_BYTES = 2048
#: What the name of an index adds to that of its archive, an entry of it (offset and length), and entries read at once.
INDEX, ENTRY, INDEX_ROWS = ".idx", struct.Struct("<QQ"), 65536
#: Records of a batch of the reader.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
# Fixed value of the format: the profile of a revisit of an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN_AT = "1970-01-01T00:00:00Z"


#: Names that Hadoop has for stores which Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss"}


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address as Spark names it, and the path there."""
    scheme, mark, rest = path.partition("://")
    if not mark:
        return pafs.FileSystem.from_uri(path if path.startswith("file:") else f"file://{path}")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


# ---------------------------------------------------------------- records


def parse_headers(block: bytes) -> dict[str, str]:
    """Header lines after the first, names in lower case; continuation lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP message, without its transfer and content coding."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark or not block.startswith(b"HTTP/"):
        return block
    headers = parse_headers(head)
    if "chunked" in headers.get("transfer-encoding", "").lower():
        plain, at = bytearray(), 0
        while (end := body.find(b"\r\n", at)) >= 0 and (size := int(body[at:end].split(b";")[0] or b"0", 16)):
            plain += body[end + 2 : end + 2 + size]
            at = end + 4 + size
        body = bytes(plain)
    coding = headers.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        return zlib.decompress(body, 31)
    if coding == "deflate":
        return zlib.decompress(body)
    return body


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, written_at: str = WRITTEN_AT) -> bytes:
    """One response record, or a revisit record without the payload if it refers to another."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {written_at}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c for c in uri if c not in "\r\n"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _columns(headers: dict[str, str]) -> dict[str, str | None]:
    out = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        value = out[c]
        if value and value[0] == "<" and value[-1] == ">":
            out[c] = value[1:-1]
    return out


def sequential(stream: io.BufferedIOBase, wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records of a plain or inflated stream; payloads of records that ``wanted`` refuses are passed over."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
        headers = parse_headers(b"".join(head).replace(b"\r\n", b"\n").replace(b"\n", b"\r\n"))
        size = int(headers.get("content-length", "0"))
        if wanted(headers) and need_payload:
            yield headers, stream.read(size)
            continue
        stream.seek(size, io.SEEK_CUR)
        if wanted(headers):
            yield headers, None


def indexed(handle, spans: Iterable[tuple[int, int]], wanted, need_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Records at known places: the headers of each are inflated first, the rest only if it is wanted."""
    for offset, length in spans:
        handle.seek(offset)
        raw = handle.read(min(length, HEAD_BYTES))
        inflater = zlib.decompressobj(31)
        text = inflater.decompress(raw)
        got = len(raw)
        while b"\r\n\r\n" not in text and got < length:
            more = handle.read(min(length - got, HEAD_BYTES))
            got += len(more)
            text += inflater.decompress(more)
        head, _, block = text.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        if not wanted(headers):
            continue
        if not need_payload:
            yield headers, None
            continue
        if got < length:
            block += inflater.decompress(handle.read(length - got))
        yield headers, block[: int(headers.get("content-length", "0"))]


# ---------------------------------------------------------------- reader


@dataclass
class Span(InputPartition):
    """Records of one file: so many from a place in its index, or all of them in order."""

    path: str
    first: int = 0
    count: int | None = None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        #: payload: full, digest (its size and SHA-1 only) or none
        self.payload = options.get("payload", "full")
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has", IsNotNull: "set"}
        for f in filters:
            kind, column = kinds.get(type(f)), getattr(f, "attribute", ())
            if kind and len(column) == 1 and column[0] in HEADER_COLUMNS:
                self.tests.append((column[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def _wanted(self, headers: dict[str, str]) -> bool:
        if not self.tests:
            return True
        columns = _columns(headers)
        for column, kind, value in self.tests:
            own = columns[column]
            if own is None:
                return False
            if kind == "eq" and own != value or kind == "in" and own not in value or kind == "starts" and not own.startswith(value) or kind == "ends" and not own.endswith(value) or kind == "has" and value not in own:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        files, root = open_fs(self.path)
        if files.get_file_info(root).type == pafs.FileType.File:
            found = [files.get_file_info(root)]
        else:
            found = [x for x in files.get_file_info(pafs.FileSelector(root, recursive=True)) if x.type == pafs.FileType.File and (x.path.endswith(".warc") or x.path.endswith(".warc.gz")) and "/_" not in x.path[len(root) :]]
        # of an index the driver looks at the size only: a task reads its own part
        indexes = {x.path: x for x in files.get_file_info([x.path + INDEX for x in found])}
        out: list[InputPartition] = []
        for info in sorted(found, key=lambda x: x.path):
            index = indexes[info.path + INDEX]
            if index.type != pafs.FileType.File:
                out.append(Span(info.path))
                continue
            records = index.size // ENTRY.size
            step = max(1, -(-records // max(1, -(-info.size // self.split))))
            out += [Span(info.path, a, min(step, records - a)) for a in range(0, records, step)]
        return out or [Span("")]

    def _places(self, files: pafs.FileSystem, partition: Span) -> Iterator[tuple[int, int]]:
        """(offset, length) of the records of a partition, some at a time."""
        with files.open_input_file(partition.path + INDEX) as index:
            for a in range(partition.first, partition.first + partition.count, INDEX_ROWS):
                n = min(INDEX_ROWS, partition.first + partition.count - a)
                index.seek(a * ENTRY.size)
                yield from ENTRY.iter_unpack(index.read(n * ENTRY.size))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = open_fs(self.path)
        need = self.payload != "none"
        rows: list[dict] = []
        held = 0
        with files.open_input_file(partition.path) as raw:
            if partition.count is not None:
                records = indexed(raw, self._places(files, partition), self._wanted, need)
            else:
                stream = io.BufferedReader(raw) if not partition.path.endswith(".gz") else gzip.GzipFile(fileobj=io.BufferedReader(raw))
                records = sequential(stream, self._wanted, need)
            for headers, block in records:
                payload = None
                if block is not None:
                    payload = http_payload(block) if "application/http" in headers.get("content-type", "") else block
                row = {"file": partition.path, **_columns(headers), "headers": list(headers.items()), "payload": payload if self.payload == "full" else None}
                row |= {"payload_bytes": None if payload is None else len(payload), "payload_sha1": None if payload is None else sha1_base32(payload)}
                rows.append(row)
                held += len(block or b"")
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


_ARROW = pa.schema(
    [("file", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string())]
    + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha1", pa.string())]
)


# ---------------------------------------------------------------- writer


@dataclass
class Wrote(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Tasks write below ``_staged``; the driver moves the files of the tasks that count into place."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.most = int(options.get("filebytes", FILE_BYTES))
        self.level = int(options.get("level", 6))
        self.at = options.get("writtenat", WRITTEN_AT)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        files, root = open_fs(self.path)
        staged = f"{root}/_staged-{self.job}"
        files.create_dir(staged, recursive=True)
        names: list[str] = []
        out, index, offset = None, bytearray(), 0

        def finish() -> None:
            if out is not None:
                out.close()
                with files.open_output_stream(f"{staged}/{names[-1]}{INDEX}", compression=None) as places:
                    places.write(bytes(index))

        for batch in iterator:
            ids, uris, refs, payloads = (batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "target_uri", "refers_to", "payload"))
            for i in range(batch.num_rows):
                if out is None or offset >= self.most:
                    finish()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, index, offset = files.open_output_stream(f"{staged}/{names[-1]}", compression=None), bytearray(), 0
                packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                raw = record_bytes(ids[i].as_py(), uris[i].as_py(), payloads[i].as_py() or b"", refs[i].as_py(), self.at)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                index += ENTRY.pack(offset, len(member))
                offset += len(member)
        finish()
        return Wrote(names)

    def commit(self, messages: list[Wrote | None]) -> None:
        files, root = open_fs(self.path)
        if self.overwrite:
            for old in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
                if old.type == pafs.FileType.File:
                    files.delete_file(old.path)
        for message in messages:
            for name in message.names if message else []:
                for suffix in (INDEX, ""):  # an archive is visible only once its index is
                    files.move(f"{root}/_staged-{self.job}/{name}{suffix}", f"{root}/{name}{suffix}")
        files.create_dir(root, recursive=True)
        self._clear(files, root)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(*open_fs(self.path))

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/_staged-{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{root}/_staged-{self.job}")


class WarcDataSource(DataSource):
    """Options: path; reading: splitBytes, payload (full, digest, none); writing: fileBytes, level, writtenAt."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark hand predicates to it."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---------------------------------------------------------------- pages

PREFIX = "urn:page:"


def write_pages(pages: DataFrame, path: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row; of equal payloads of at least ``min_bytes`` bytes all but the first are revisits.

    The first is that of the smallest id (all rows of it, if it is repeated; null ids come last). Null pages
    have an empty payload.
    """
    spark = pages.sparkSession
    register(spark)
    scratch = Scratch(spark, "warc-firsts")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("same", F.sha2("payload", 256))
    firsts = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("same").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.where("n > 1").drop("n"), "firsts")
    marked = keyed.join(firsts, "same", "left")
    name = lambda c: F.concat(F.lit(PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), name("first"))
    made = marked.select(name("page_id").alias("record_id"), F.col("url").alias("target_uri"), refers.alias("refers_to"), "payload")
    made.write.format("warc").mode("append").option("path", path).save()


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of archives of pages.

    Size and digest of a response are those of the payload as read back; a revisit has those of the response
    that it refers to, found by the digest in its own header.
    """
    register(spark)
    source = spark.read.format("warc").option("path", path)
    page = lambda c: F.substring(c, len(PREFIX) + 1, 20).try_cast("long")
    responses = source.option("payload", "digest").load().where("record_type = 'response'")
    responses = responses.select(page("record_id").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = source.option("payload", "none").load().where("record_type = 'revisit'")
    revisits = revisits.select(page("record_id").alias("page_id"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))
    known = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    full = revisits.join(known, "payload_digest", "left").select(*responses.columns)
    return responses.unionByName(full)


def archive_pages(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write archives of all pages to the shared folder, and read them back.

    Repeated rows give repeated records; an empty table gives an empty table; other columns don't matter.
    """
    path = Scratch(pages.sparkSession, "warc").folder("archives")
    write_pages(pages, path, min_bytes=min_bytes)
    return read_pages(pages.sparkSession, path)


#: The same result for DuckDB.
ARCHIVE_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
