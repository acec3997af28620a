"""Appending columns that an Arrow function computes from one column, beside all the others."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Made = Sequence[pa.Array]


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``most`` bytes, but for the last; 0 leaves them as they come."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def append(df: DataFrame, source: str, fields: Sequence[T.StructField], make: Callable[[pa.Array], Made], keep: Sequence[str] | None = None, gather: int = 0) -> DataFrame:
    """Rows of ``df`` with ``fields`` made from ``source``; like-named columns are replaced, only ``keep`` are carried.

    ``make`` gets batches of at least ``gather`` bytes, where it has something to read for each of them.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, gather):
            made = make(batch.column(len(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + list(made), kept + [f.name for f in fields])

    # the source goes last under a name of its own, so that it may also be kept
    return df.select(*kept, df[source].alias("__source")).mapInArrow(run, schema)
