"""WARC archives as a Spark data source: gzip members, one record each, read by byte ranges.

``df.write.format("warc")`` writes one archive per task, ``spark.read.format("warc")``
reads archives of any size by ranges. Folders may be on any store that
``pyarrow.fs`` opens from a URI (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha1
from itertools import pairwise

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tiegrid.llm.common import materialize
from tiegrid.plans.work import join_on_hot_keys

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are always stored.
LEAST_SHARED = 1000
#: Rows of the source: what a task writes and what it reads.
WRITTEN = "page_id bigint, url string, payload binary, payload_digest string, record_type string, refers_to bigint"
RECORD = "path string, offset bigint, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, digest_ok boolean, payload binary"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(head) + made.compress(block) + made.compress(b"\r\n\r\n") + made.flush()


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None, date: str) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP headers of the full payload only."""
    headers = [("WARC-Type", record_type), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if record_type == "revisit":
        headers += [("WARC-Refers-To", _record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    headers.append(("Content-Type", "application/http;msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(headers, http + (payload if record_type == "response" else b""))


@dataclass
class Part(WriterCommitMessage):
    path: str


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes a hidden file of its own; the driver shows those of the attempts that count."""

    def __init__(self, folder: str, date: str):
        self.folder, self.date = folder, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = fs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/.part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(path, compression=None) as out:
            out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = [batch.column(k)[i].as_py() for k in range(6)]
                    out.write(page_record(*row, self.date))
        return Part(path)

    def commit(self, messages: list[Part | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                store.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages: list[Part | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


@dataclass
class Ranges(InputPartition):
    """(file, start, end) of what one task scans."""

    ranges: list[tuple[str, int, int]]


class _Blocks:
    """Bytes of a file at any place, through one block that is kept."""

    def __init__(self, file: pa.NativeFile, size: int, block: int = 1 << 20):
        self.file, self.size, self.block, self.at, self.held = file, size, block, 0, b""

    def bytes_at(self, at: int) -> memoryview:
        """What is held from ``at`` on, at least three bytes unless the file ends."""
        if not self.at <= at <= self.at + len(self.held) - 3:
            self.file.seek(at)
            self.at, self.held = at, self.file.read(self.block)
        return memoryview(self.held)[at - self.at :]


def _next_magic(blocks: _Blocks, at: int, end: int) -> int | None:
    """The first place from ``at``, before ``end``, at which gzip's magic bytes stand."""
    while at < end:
        left = len(blocks.bytes_at(at))
        found = blocks.held.find(MAGIC, at - blocks.at)
        if found >= 0:
            return blocks.at + found if blocks.at + found < end else None
        if left < 3:
            return None
        at += left - 2
    return None


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def read_member(blocks: _Blocks, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, end) of the record that begins at ``at``, or None where no gzip member with WARC headers does.

    A member whose headers are right but that is cut off, fails its checksum or
    has another length than it says is damage, and raises.
    """
    unpack, pieces, head, end = zlib.decompressobj(31), bytearray(), None, at
    while not unpack.eof:
        held = blocks.bytes_at(end)[: 1 << 16]
        if not held:
            break
        try:
            pieces += unpack.decompress(held)
        except zlib.error as e:
            if head is None:
                return None
            raise ValueError(f"damaged record at byte {at}: {e}") from e
        end += len(held) - len(unpack.unused_data)
        if head is None:
            if not pieces.startswith(b"WARC/1."[: len(pieces)]):
                return None
            stop = pieces.find(b"\r\n\r\n")
            if stop >= 0:
                head = _fields(bytes(pieces[:stop]))
                if "warc-type" not in head or not head.get("content-length", "").isdigit():
                    return None
                begin = stop + 4
    if head is None:
        return None
    length = int(head["content-length"])
    if not unpack.eof or bytes(pieces[begin + length :]) != b"\r\n\r\n":
        raise ValueError(f"damaged record at byte {at}: its member is cut off or has another length than it says")
    return head, bytes(pieces[begin : begin + length]), end


def _hex_digest(value: str | None) -> str | None:
    name, _, digest = (value or "").partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()


def _row(path: str, at: int, head: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind, said = head["warc-type"], _hex_digest(head.get("warc-payload-digest"))
    payload, size, digest, right = None, None, said, None
    if head.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        if kind == "revisit":
            length = _fields(http).get("content-length", "")
            size = int(length) if length.isdigit() else None
        else:
            payload, size, digest = body, len(body), sha1(body).hexdigest()
            right = said is None or said == digest
    return path, at, kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), size, digest, right, payload if payloads else None


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int, payloads: bool):
        self.folder, self.range_bytes, self.payloads = folder, range_bytes, payloads

    def partitions(self) -> Sequence[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(".gz") and not f.base_name.startswith("."))
        parts, now, room = [], [], self.range_bytes
        for path, size in files:
            for start, end in pairwise([*range(0, size, self.range_bytes), size]):
                if now and end - start > room:
                    parts.append(Ranges(now))
                    now, room = [], self.range_bytes
                now.append((path, start, end))
                room -= end - start
        return [*parts, Ranges(now)] if now or not parts else parts

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        kinds = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[k]) for n, k in (f.split(" ") for f in RECORD.split(", "))])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for path, start, end in partition.ranges:
            with store.open_input_file(path) as file:
                blocks, at = _Blocks(file, file.size()), start
                while (at := _next_magic(blocks, at, end)) is not None:
                    found = read_member(blocks, at)
                    if found is None:  # the three bytes stand inside other data
                        at += 1
                        continue
                    head, block, after = found
                    rows.append(_row(path, at, head, block, self.payloads))
                    held, at = held + (len(block) if self.payloads else 200), after
                    if held > 4_000_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Options: ``rangeBytes`` (what a task scans), ``payloads`` (false leaves them out), ``date`` (of written records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema: object) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("rangeBytes", 64 << 20)), self.options.get("payloads", "true").lower() == "true")

    def writer(self, schema: object, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def share_payloads(pages: DataFrame) -> DataFrame:
    """The records to write, one for each row of ``pages`` (page_id, url, html).

    A null html is empty. Of rows with equal payloads of 1000 bytes or more,
    those with the largest page_id are responses and the others revisits that
    refer to it; repeated rows of that id are all responses, and so are all rows
    where no id is known. A row without an id refers to the largest known one.
    Payloads are equal if length and SHA-1 are. Further columns are not read.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns({"payload_digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("bigint")})
    named = rows.withColumn("same", F.concat_ws(":", "payload_digest", "n_bytes"))
    keyed = materialize(named.groupBy("same").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("copies")), "payloads")
    joined = join_on_hot_keys(named, keyed, "same", "copies")
    revisit = (F.col("n_bytes") >= LEAST_SHARED) & F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("stored")).alias("refers_to"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Writes a record for each page into archives in ``folder``; an empty table gives archives without pages, or none."""
    pages.sparkSession.dataSource.register(WarcSource)
    share_payloads(pages).write.format("warc").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, payloads: bool = True, range_bytes: int = 64 << 20) -> DataFrame:
    """Every record of the archives in ``folder``: where it begins, its type, ids, digest and payload.

    Files are cut into ranges of ``range_bytes``. A task looks for gzip's magic
    bytes in its range, takes those for a record at which a gzip member with
    WARC headers begins, and reads all records that begin in its range, the last
    one beyond its end. ``payload_bytes`` and ``payload_digest`` are of the full
    payload: worked out for responses (``digest_ok`` tells whether the header
    agrees), from the headers for revisits. A damaged record stops the job. A
    payload that holds an archive of its own, stored as it is, would show records
    of its own where a range begins inside it; text can't, as 1F 8B isn't UTF-8.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("rangeBytes", range_bytes).option("payloads", str(payloads).lower()).load(folder)


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that ``write_pages`` has written."""

    def number(column: str):
        return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("bigint")

    wanted = records.filter(F.col("record_type").isin("response", "revisit"))
    return wanted.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
