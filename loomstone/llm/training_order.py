"""Training-order materialisation of token sequences.

The documents of a scan partition form one token stream, each document closed
by an end id, which is cut into sequences of ``capacity`` ids.  Every possible
sequence has an index: each partition gets a range of as many indices as the
bytes of the largest one allow, so texts are tokenised once and no table of
partitions is gathered.  A keyed Feistel permutation with cycle-walking sends the
index to a place in the training order; shards are ranges of places with fixed
bounds, and a task writes one range.  Each shard is a file of records of one fixed
stride in that order with a sidecar of the records' documents and checksums, so
reading is sequential and may resume at any record.

The same key gives the same order for the same files and split size.  A scan
partition that holds more than was counted fails its task.  Files are renamed into
place when complete, under names of their own per attempt, and only those of
finished tasks are listed.

Defined results: a null or empty text is the end id alone; the last sequence of
a partition is filled up with the end id and its true length is recorded; texts
of any length run on over sequences; equal rows are written each; a null id is
kept as null; other columns of any name are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstone.llm import tokens
from loomstone.llm.store import filesystem, fresh_folder, qualified, settle
from loomstone.llm.words import mix

CAPACITY = 2048
SHARD_BYTES = 32 << 20
END_ID = 50256
_ROUNDS = 4


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """The places of ``index`` under a keyed bijection of range(size)."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = mix(np.uint64(key) + np.arange(1, _ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):  # walk the cycle until the value lies in range
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (mix(right + k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _sequences(vocabulary: str, capacity: int, room: int, size: int, per_shard: int, key: int):
    """Tokenise a scan partition and place its sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * room
        pack = zstandard.ZstdCompressor(level=1)
        held, ids, made = np.zeros(0, np.uint16), [], 0

        def place(seqs: list[tuple[np.ndarray, list[int]]]) -> pa.RecordBatch:
            if made > room:
                raise RuntimeError("a scan partition holds more than was counted")
            slots = permute(np.arange(made - len(seqs), made) + base, size, key)
            cols = [slots // per_shard, slots, [len(s) for s, _ in seqs], [d for _, d in seqs], [zlib.crc32(s.astype("<u4").tobytes()) for s, _ in seqs], [pack.compress(s.astype("<u2").tobytes()) for s, _ in seqs]]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "place", "n_tokens", "doc_ids", "ids_crc32", "body"])

        for batch in batches:
            docs = batch.column(0).to_pylist()
            seqs = []
            stream, owners, at = [held], [(0, d) for d in ids], len(held)
            for i, found in tokens.encode_column(batch.column(1), vocabulary):
                owners.append((at, docs[i]))
                stream += [found.astype(np.uint16), np.array([END_ID], np.uint16)]
                at += len(found) + 1
            flat = np.concatenate(stream)
            begins = np.array([a for a, _ in owners], np.int64)
            full = len(flat) // capacity
            for k in range(full):
                a, b = k * capacity, (k + 1) * capacity
                lo = max(int(np.searchsorted(begins, a, "right")) - 1, 0)
                while lo and begins[lo - 1] == begins[lo] == a:
                    lo -= 1
                seqs.append((flat[a:b], [d for _, d in owners[lo : int(np.searchsorted(begins, b))]]))
            held = flat[full * capacity :]
            lo = max(int(np.searchsorted(begins, full * capacity, "right")) - 1, 0)
            ids = [d for _, d in owners[lo:]] if len(held) else []
            made += len(seqs)
            if seqs:
                yield place(seqs)
        if len(held):
            made += 1
            yield place([(held, ids)])

    return run


def _write(folder: str, capacity: int):
    """Write the shards of a task, whose rows come ordered by shard and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = filesystem(folder)
        disk.create_dir(root, recursive=True)
        attempt, unpack = TaskContext.get().taskAttemptId(), zstandard.ZstdDecompressor()
        now, out, side, n, path = None, None, None, 0, ""

        def close() -> pa.RecordBatch:
            out.close()
            side.close()
            disk.move(path + ".part", path)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([path]), pa.array([n], pa.int64())], ["shard", "path", "records"])

        for batch in batches:
            for shard, _, size, docs, crc, body in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if shard != now:
                    if now is not None:
                        yield close()
                    now, n, path = shard, 0, f"{root}/shard-{shard:08d}-{attempt}.bin"
                    out, side = disk.open_output_stream(path + ".part"), disk.open_output_stream(path + ".idx")
                row = unpack.decompress(body)
                out.write(row + struct.pack("<H", END_ID) * (capacity - size))
                side.write(struct.pack("<iIi" + "?q" * len(docs), size, crc, len(docs), *(x for d in docs for x in (d is not None, d or 0))))
                n += 1
        if now is not None:
            yield close()

    return run


def read_shard(disk, path: str, capacity: int, start: int = 0) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(record, ids, doc ids) from record ``start`` on, read in order and checked."""
    with disk.open_input_stream(path + ".idx") as side, disk.open_input_file(path) as source:
        source.seek(start * capacity * 2)
        index, at, k = side.read(), 0, 0
        while at < len(index):
            size, crc, many = struct.unpack_from("<iIi", index, at)
            owners = struct.unpack_from("<" + "?q" * many, index, at + 12)
            docs = [d if some else None for some, d in zip(owners[0::2], owners[1::2], strict=True)]
            at += 12 + 9 * many
            if k >= start:
                ids = np.frombuffer(source.read(capacity * 2), "<u2")[:size]
                if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                    raise ValueError(f"{path}: record {k} doesn't fit its checksum")
                yield k, ids, docs
            k += 1


def _read(folder: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, _ = filesystem(folder)
        for batch in batches:
            for shard, path, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = [(first + k, shard, k * capacity * 2, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), docs) for k, ids, docs in read_shard(disk, path, capacity)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"])

    return run


def materialise(docs: DataFrame, folder: str, key: int = 1, capacity: int = CAPACITY, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shards; one row (shard, path, records, first_slot) per shard, in training order by first_slot."""
    path = vocabulary or tokens.default_vocabulary()
    folder = qualified(docs.sparkSession, folder)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bytes_of = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    parts = texts.groupBy(F.spark_partition_id().alias("part")).agg(bytes_of.alias("weight")).agg(F.max("part"), F.max("weight"), F.sum("weight")).first()
    last, most, total = (x or 0 for x in parts)
    room = most // capacity + 1  # a byte is at least a token, so this bounds the sequences of a partition
    size = (last + 1) * room
    shards = max(1, -(-total // shard_bytes))
    per_shard = -(-size // shards)
    placed = texts.mapInArrow(_sequences(path, capacity, room, size, per_shard, key), "shard long, place long, n_tokens long, doc_ids array<long>, ids_crc32 long, body binary")
    dealt = placed.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("place")
    written = settle(dealt.mapInArrow(_write(folder, capacity), "shard long, path string, records long"))
    before = F.sum("records").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row per shard
    return written.withColumn("first_slot", F.coalesce(before, F.lit(0).cast("long")))


def round_trip(spark: SparkSession, docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Write the training order of all documents and read it back: slot, shard, byte_offset, n_tokens, ids_crc32, doc_ids."""
    folder = qualified(spark, folder) if folder else fresh_folder(spark, "training-order")
    shards = materialise(docs, folder, capacity=capacity)
    many = max(1, spark.sparkContext.defaultParallelism)
    listed = shards.select("shard", "path", "first_slot").repartition(many)
    return listed.mapInArrow(_read(folder, capacity), "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>")
