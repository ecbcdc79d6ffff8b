"""WARC archives: writing, the monolithic gzip normaliser with its offset index, and reading by offset.

``write_archives`` puts records into archives that are one gzip stream each. ``normalise`` inflates
such a stream once, front to back, in chunks; every record is written again as a gzip member of its own,
and its place goes to a sidecar index. ``read_records`` opens members by offset. All three work on archives in the cluster's
shared store (through Arrow's file systems), hold one chunk or one record at a time, and name files by a
fresh token per task attempt: the table of finished files, not the folder, says what counts, so a repeated task
leaves at most an unused file behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankmill.session import cut_lineage, shared_folder

CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20  # payload bytes after which a new archive begins
READ_BYTES = 64 << 20  # packed bytes that one task reads
WARC_DATE = "2020-01-01T00:00:00Z"  # fixed value: record date, so that equal input gives equal archives
BREAK = b"\r\n"
FILES = "archive string, records long"
RECORDS = ("page_id", "url", "payload", "size", "digest", "first")
INDEX = "archive string, number long, offset long, length long, record_id string, record_type string"
RECORD = (
    "page_id long, target_uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, "
    "payload binary"
)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _head(fields: list[tuple[str, object]], first: str) -> bytes:
    clean = (f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}" for k, v in fields if v is not None)
    return "\r\n".join([first, *clean, "", ""]).encode("utf-8", "replace")


def record_id(page_id: int | None) -> str | None:
    return None if page_id is None else f"<urn:page:{page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """A response record, or a revisit (headers only, no payload needed) of the record of page ``first``."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)], "HTTP/1.1 200 OK")
    block = http if first is not None else http + (payload or b"")
    return (
        _head(
            [
                ("WARC-Type", "response" if first is None else "revisit"),
                ("WARC-Record-ID", record_id(page_id) or f"<urn:uuid:{uuid.uuid4()}>"),
                ("WARC-Date", WARC_DATE),
                ("WARC-Target-URI", url),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("WARC-Profile", None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(first)),
                ("Content-Type", "application/http;msgtype=response"),
                ("Content-Length", len(block)),
            ],
            "WARC/1.1",
        )
        + block + BREAK * 2
    )


def fields_of(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def with_revisits(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """(page_id, url, payload, size, digest, first): ``first`` is the smallest page with the same payload, null for that page itself.

    Payloads below ``min_bytes`` and rows without an id are responses. First pages are found from ids and digests alone; the digest's
    aggregate combines before its shuffle, so a payload of a third of all pages is one row per task. Only responses carry their
    payload, and they meet their digest by (digest, id): copies never gather in one task.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    given = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"),
    )
    alone = (F.col("size") < min_bytes) | F.col("page_id").isNull()
    headers = cut_lineage(given.where(~alone).select("page_id", "url", "size", "digest"), "headers")
    firsts = headers.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    none = F.lit(None)
    own = firsts.select(F.col("first").alias("page_id"), "digest")
    responses = given.where(~alone).join(own, ["page_id", "digest"], "left_semi").unionByName(given.where(alone))
    repeated = firsts.where("first != last").select("digest", "first")
    revisits = headers.join(repeated, "digest").where("page_id != first").withColumn("payload", none.cast("binary"))
    columns = ["page_id", "url", "payload", "size", "digest", "first"]
    return responses.withColumn("first", none.cast("long")).select(columns).unionByName(revisits.select(columns))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Records of ``with_revisits`` into archives of one gzip stream each; (archive, records) of the finished ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = stream = None
        count = size = 0
        for batch in batches:
            for page_id, url, payload, length, digest, first in zip(*(batch[c] for c in RECORDS), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, name = _place(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out, stream, count, size = system.open_output_stream(name, compression=None), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                body, digest32 = payload.as_py(), base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                out.write(stream.compress(make_record(page_id.as_py(), url.as_py(), body, length.as_py(), digest32, first.as_py())))
                count, size = count + 1, size + len(body or b"")
                if size >= ARCHIVE_BYTES:
                    out.write(stream.flush())
                    out.close()
                    yield _batch([(path, count)], FILES)
                    out = None
        if out is not None:
            out.write(stream.flush())
            out.close()
            yield _batch([(path, count)], FILES)

    return cut_lineage(records.mapInArrow(run, FILES), "archives")


class Inflated:
    """Front-to-back reader of one gzip stream (or several members after another), a chunk at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.inflate, self.held, self.packed = source, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        packed = self.packed or self.source.read(CHUNK)
        if not packed:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(packed, CHUNK)
        self.packed = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def head(self) -> bytes | None:
        """Bytes up to and with the blank line; None at the end."""
        at = 0
        while (end := self.held.find(BREAK * 2, at)) < 0:
            at = max(0, len(self.held) - 3)
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record")
                return None
        head, self.held = self.held[: end + 4], self.held[end + 4 :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.held:
                if not self.more():
                    raise ValueError("archive ends inside a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with one member per record; the index of all members, also beside each archive as JSON lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                system, name = _place(path)
                system.create_dir(name.rpartition("/")[0], recursive=True)
                old, old_name = _place(archive)
                with old.open_input_stream(old_name, compression=None) as source, system.open_output_stream(
                    name, compression=None
                ) as out, system.open_output_stream(f"{name}.idx", compression=None) as sidecar:
                    reader, offset, number, rows = Inflated(source), 0, 0, []
                    while (head := reader.head()) is not None:
                        fields = fields_of(head)
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        written = out.write(member.compress(head))
                        for part in reader.take(int(fields["content-length"]) + 4):
                            written += out.write(member.compress(part))
                        written += out.write(member.flush())
                        row = (path, number, offset, written, fields["warc-record-id"], fields["warc-type"])
                        sidecar.write(json.dumps(dict(zip(("number", "offset", "length", "id", "type"), row[1:], strict=True))).encode() + b"\n")
                        rows.append(row)
                        offset, number = offset + written, number + 1
                        if len(rows) >= 10_000:
                            yield _batch(rows, INDEX)
                            rows = []
                yield _batch(rows, INDEX)

    # as many tasks as archives; the number is given, so adaptive execution does not fold these tiny rows into one task
    one_each = archives.select("archive").repartitionByRange(max(1, archives.count()), "archive")
    return cut_lineage(one_each.mapInArrow(run, INDEX), "index")


def parse_record(raw: bytes) -> tuple:
    """A row of ``RECORD``; a response whose payload does not have the digest it states is an error."""
    head, _, block = raw.partition(BREAK * 2)
    fields = fields_of(head + BREAK)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(BREAK * 2)
    stated = int(fields_of(http + BREAK)["content-length"])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != stated or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    page = lambda v: int(v.rpartition(":")[2].rstrip(">")) if v and v.startswith("<urn:page:") else None
    return (
        page(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, digest, stated, page(fields.get("warc-refers-to")),
        payload if kind == "response" else None,
    )


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index, each by its offset; payload null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch[c].to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != at:
                    if source is not None:
                        source.close()
                    system, name = _place(archive)
                    at, source = archive, system.open_input_file(name)
                source.seek(offset)
                rows.append(parse_record(zlib.decompress(source.read(length), 31)))
                size += len(rows[-1][-1] or b"")
                if size > 16 * CHUNK:
                    yield _batch(rows, RECORD)
                    rows, size = [], 0
            yield _batch(rows, RECORD)
        if source is not None:
            source.close()

    # index rows are small and stand for many bytes: tasks by the bytes, and no fewer than archives
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_distinct("archive").alias("archives")).first()
    tasks = max(1, size["archives"], -(-size["bytes"] // READ_BYTES))
    ranged = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(run, RECORD)


def archive_pages(
    spark: SparkSession, pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html"
) -> DataFrame:
    """Writes a record per row, normalises the archives and reads every record back (columns of ``RECORD``).

    A null payload is an empty one and a null url leaves its header out. Equal payloads of at least ``min_bytes`` bytes revisit the
    smallest page that has them; repeated rows of that page are responses each, rows without an id always are
    (their record id is a fresh UUID, read back as null). Line breaks in urls become blanks. An empty table gives no archives and no rows.
    """
    folder = shared_folder(spark, "warc")
    files = write_archives(with_revisits(pages, min_bytes, id_col, url_col, text_col), f"{folder}/whole")
    return read_records(normalise(files, f"{folder}/members"))
