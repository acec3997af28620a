"""Packing whole documents into fixed token sequences by the sum-of-squares rule.

A document is its token ids and one end id.  Only a document longer than a
sequence is cut: its last pieces are full and its first piece takes the rest.
Pieces are dealt by a hash of their content and the number of their row to groups
of a bounded number of documents, so that no id or text, however often it stands in
the table, decides the size of a group.  Each group is packed alone, largest piece first: a piece goes to
the residual gap (or to a new sequence) for which the sum of the squared counts
of open sequences per gap becomes smallest.  A new sequence is opened only if
no open one has room, which keeps their number low on finite input; ties go to
the smallest gap.  Full pieces are sequences of their own.

Defined results: a null or empty text is the end id alone; rows with one
doc_id, or without one, are packed each on its own; extra columns are dropped before the
shuffle; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import tokens

#: Documents a packing group holds on average.
GROUP_DOCS = 32_768


def piece_bounds(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of ``length`` ids."""
    first = length % capacity or min(length, capacity)
    starts = [0, *range(first, length, capacity)] if length else []
    return [(a, (b if b is not None else length) - a) for a, b in zip(starts, [*starts[1:], None], strict=True)]


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, for items in the order given."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins per gap; full bins don't count
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, s in enumerate(sizes.tolist()):
        here = count[s:]
        after = count[: capacity + 1 - s]
        # moving a bin from gap g to g - s changes the sum by 2 (N(g - s) - N(g) + 1); gap 0 isn't counted
        change = np.where(here > 0, 2 * (after - here + 1), np.iinfo(np.int64).max)
        if here[0] > 0:
            change[0] = 1 - 2 * here[0]
        g = int(change.argmin()) + s
        if count[g]:
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            b, g, made = made, capacity, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            count[g - s] += 1
            open_bins[g - s].append(b)
    return bins, offsets


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, ids in tokens.encode_column(batch.column(1), vocabulary):
                whole = np.append(ids, end_id).astype("<u4")
                doc = batch.column(0)[i].as_py()
                rows += [(doc, k, a, n, zlib.crc32(whole[a : a + n].tobytes())) for k, (a, n) in enumerate(piece_bounds(len(whole), capacity))]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048) -> DataFrame:
    """Place every piece of every document: its sequence and its offset there."""
    found = pieces(docs, vocabulary or tokens.default_vocabulary(), capacity)
    groups = -(-docs.count() // GROUP_DOCS) or 1

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], ignore_index=True)
        bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity)
        group["sequence_id"] = group["pack_group"].to_numpy() * (1 << 32) + bins
        group["offset"] = offsets
        return group.drop(columns="pack_group")

    # the number of a row is the same whenever its part of the table is read again
    dealt = found.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInPandas(place, out)
