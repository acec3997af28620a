"""Vector expressions and exact top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to the executors at once or make a tile, and base rows of a tile.
BLOCK = 4096
TILE_ROWS = 32_768
#: Queries and rows whose similarities are held at once.
STEP_QUERIES, STEP_ROWS = 256, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def valid(a: Column, dimensions: int) -> Column:
    """Of the given size, finite and not zero."""
    return (F.size(a) == dimensions) & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(a, lambda x: x != 0)


def unit(a: Column) -> Column:
    """Divided by its length, as single precision."""
    length = norm(a)
    return F.transform(a, lambda x: (x / length).cast("float"))


def _directions(column: pa.Array) -> np.ndarray:
    """Rows of unit length; a zero stays zero."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def _nearest(ids: np.ndarray, wanted: np.ndarray, parts: Iterator[tuple[pa.Array, pa.Array]], k: int, least: float) -> pa.RecordBatch:
    """The k best of all rows (name, vector) for every query; some queries meet some rows at once, and k rows a query are held."""
    score, name = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
    for names, vectors in parts:
        for a in range(0, len(names), STEP_ROWS):
            own, rows = names.slice(a, STEP_ROWS).to_numpy(zero_copy_only=False), _directions(vectors.slice(a, STEP_ROWS))
            kept = []
            for q in range(0, len(ids), STEP_QUERIES):
                near = np.round(wanted[q : q + STEP_QUERIES] @ rows.T, 6)
                s = np.hstack([score[q : q + STEP_QUERIES], near])
                n = np.hstack([name[q : q + STEP_QUERIES], np.broadcast_to(own, near.shape)])
                order = np.lexsort((n, -s), axis=1)[:, :k]
                kept.append((np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)))
            score, name = (np.vstack(x) for x in zip(*kept, strict=True))
    cols = [pa.array(np.repeat(ids, score.shape[1])), pa.array(name.ravel()), pa.array(score.ravel())]
    return pa.RecordBatch.from_arrays(cols, ["query_id", "vec_id", "similarity"]).filter(pa.array(score.ravel() >= least))


FOUND = "query_id long, vec_id long, similarity double"


def _beside(queries: DataFrame, base: DataFrame, k: int, least: float) -> DataFrame:
    """At most BLOCK queries go to every task of the base, which isn't shuffled."""
    part = queries.select("query_id", "vector").toArrow().combine_chunks()
    if not part.num_rows:
        return base.sparkSession.createDataFrame([], FOUND)
    sent = base.sparkSession.sparkContext.broadcast((part["query_id"].to_numpy(), _directions(part["vector"].combine_chunks())))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _nearest(*sent.value, ((batch.column(0), batch.column(1)) for batch in batches if batch.num_rows), k, least)

    return base.select("vec_id", "embedding").mapInArrow(search, FOUND)


def _tiled(queries: DataFrame, base: DataFrame, n_queries: int, k: int, least: float) -> DataFrame:
    """Queries and base rows are dealt to a grid of tiles of a bounded size; each is one task's group."""
    across, down = -(-n_queries // BLOCK), max(1, -(-base.count() // TILE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("int").alias("x"), every(down).alias("y"), "query_id", "vector")
    rows = base.select(every(across).alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int").alias("y"), "vec_id", "embedding")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())])
        if not asked.num_rows or not held.num_rows:
            return out.empty_table()
        ids, wanted = asked["query_id"].to_numpy(), _directions(asked["vector"].combine_chunks())
        parts = ((b.column("vec_id"), b.column("embedding")) for b in held.to_batches())
        return pa.Table.from_batches([_nearest(ids, wanted, parts, k, least)], out)

    return dealt.groupBy("x", "y").cogroup(rows.groupBy("x", "y")).applyInArrow(search, FOUND)


def top_k(queries: DataFrame, base: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar base rows of every query, ties by id.

    Up to BLOCK queries are sent beside the base; more meet it in a grid of tiles and never lie in the driver.  A task keeps k rows for
    each of its queries, so only those are shuffled.  No vector or id may be null.
    """
    n = queries.count()
    found = _beside(queries, base, k, least) if n <= BLOCK else _tiled(queries, base, n, k, least)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
