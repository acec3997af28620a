"""WARC archives: writing, normalising whole-file gzip streams, and reading by index.

Archives arrive (and are written here) as one gzip stream per file, which can
only be read from its start.  The normaliser inflates such a stream once, in
pieces, and rewrites every record as a gzip member of its own, with a sidecar
index of offsets, so that any record can be read alone afterwards.  Payloads of
at least ``LEAST`` bytes that occur again are written as revisits of the record
with the smallest page id.

Files are named by partition and attempt and only those of finished tasks are
read, so a lost executor costs its own tasks.  A task holds one record at a time.

Defined results: a null page is an empty payload and a response; equal page ids
with equal payloads count as one for choosing the response, and each gets its
record; a null url is left out of the record; columns other than page_id, url and html are
ignored; an empty table writes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm.store import filesystem, fresh_folder, qualified, settle

#: Payloads from this size on are written once; a file is closed after this many bytes of records.
LEAST = 100
FILE_BYTES = 64 << 20

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, blank lines included."""
    revisit = refers_to is not None
    block = _HTTP + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_of(head: bytes) -> dict[str, str]:
    """The named fields of a record head, names in lower case."""
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def stream_records(source, piece: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) of a gzip stream of one or more members, inflated once and piecewise."""
    inflate, held, want, fields = zlib.decompressobj(31), bytearray(), None, {}
    while True:
        data = source.read(piece)
        while data:
            held += inflate.decompress(data)
            data = inflate.unused_data
            if data:
                inflate = zlib.decompressobj(31)
            while True:
                if want is None:
                    end = held.find(b"\r\n\r\n")
                    if end < 0:
                        break
                    fields = header_of(bytes(held[:end]))
                    want = end + 4 + int(fields["content-length"]) + 4
                if len(held) < want:
                    break
                yield fields, bytes(held[:want])
                del held[:want]
                want = None
            if not data:
                break
        else:
            break
    if held:
        raise ValueError("the archive ends inside a record")


def _write(folder: str):
    """Write the records of a partition to archives of one gzip stream each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = filesystem(folder)
        disk.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, stream, size, count, k, path = None, None, 0, 0, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64())], ["path", "records"])

        for batch in batches:
            for page, url, html, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}.warc.gz"
                    stream = disk.open_output_stream(path, compression=None)
                    out, size, count, k = gzip.GzipFile(fileobj=stream, mode="wb", compresslevel=6, mtime=0), 0, 0, k + 1
                whole = record(page, url, (html or "").encode(), digest, first)
                out.write(whole)
                size, count = size + len(whole), count + 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def normalise_file(disk, path: str) -> Iterator[tuple[str, int, int, str]]:
    """Rewrite one archive with a member per record; yields (new path, offset, length, record id) and leaves a sidecar index."""
    new = path.removesuffix(".warc.gz") + ".records.warc.gz"
    at, index = 0, []
    with disk.open_input_stream(path, compression=None) as source, disk.open_output_stream(new, compression=None) as out:
        for fields, whole in stream_records(source):
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            packed = member.compress(whole) + member.flush()
            out.write(packed)
            index.append((new, at, len(packed), fields["warc-record-id"]))
            at += len(packed)
    with disk.open_output_stream(new + ".idx") as side:
        for _, offset, length, name in index:
            side.write(json.dumps({"record": name, "offset": offset, "length": length}).encode() + b"\n")
    yield from index


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(zip(*normalise_file(disk, path), strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["path", "offset", "length", "record_id"])

    return run


def read_record(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index: its fields and its payload."""
    source.seek(offset)
    whole = gzip.decompress(source.read(length))
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = header_of(head)
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = filesystem(folder)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            source, name = None, None
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path != name:
                    if source:
                        source.close()
                    source, name = disk.open_input_file(path), path
                fields, payload = read_record(source, offset, length)
                digest, revisit = fields["warc-payload-digest"].partition(":")[2], fields["warc-type"] == "revisit"
                size = int(fields["warc-payload-length"])
                if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{path} at {offset}: the payload doesn't fit its digest")
                page, first = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                row = (None if page is None else int(page), fields.get("warc-target-uri"), size, digest, fields["warc-type"], None if first is None else int(first))
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            if source:
                source.close()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; one row (path, records) per archive."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    page = page.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    large = page.where(F.octet_length("html") >= LEAST).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = large.join(first, "digest").where("page_id > first").select("page_id", "digest", "first").distinct()
    typed = page.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "first")
    return settle(typed.mapInArrow(_write(folder), "path string, records long"))


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives record by record; one row (path, offset, length, record_id) per record."""
    parts = max(1, archives.sparkSession.sparkContext.defaultParallelism)
    return archives.select("path").repartition(max(parts, archives.rdd.getNumPartitions()), "path").mapInArrow(_normalise(folder), "path string, offset long, length long, record_id string")


def read(index: DataFrame, folder: str) -> DataFrame:
    """What the indexed records say, with every response's payload checked against its digest."""
    return index.mapInArrow(_read(folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives of all pages, normalise them and read every record back."""
    folder = qualified(spark, folder) if folder else fresh_folder(spark, "warc")
    return read(normalise(write(pages, folder), folder), folder)


def oracle() -> str:
    """DuckDB SQL for the digest of every record."""
    return f"""
    WITH p AS (
      SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST} GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first < page_id THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)"""
