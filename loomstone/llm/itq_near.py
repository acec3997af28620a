"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Rows with the same vector become one class with its number of rows.
2. Iterative quantisation is fitted on at most ``SAMPLE`` classes (those with the smallest hashes): the sample is centred,
   turned to its principal axes, and a rotation is learned that brings it nearest to the corners of a cube, so that the
   bits are balanced.  Each restart gives one more code of as many bits as the vectors have components.
3. The bits are cut into substrings, one table each.  Their width follows the logarithm of the number of classes, so that
   buckets stay small, and their number follows from the chance that two vectors at the threshold agree in one substring:
   a pair at the threshold meets with probability ``RECALL`` at least, a nearer one more often.
4. The vectors of one bucket are compared by their original components in double precision.  A bucket of more than
   ``BLOCK`` vectors is dealt to blocks, and every pair of blocks is a group of its own, so no group grows with the table.
   A pair counts in the first table it meets in; a task returns counts and a spanning forest, never pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of
different lengths never link; a null id takes part in links and never names a component, and its row is kept only if it
links with nothing; rows of one id are vectors of their own; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.graph import components
from loomstone.llm.store import settle, settle_table

#: Classes that the rotation is fitted on, and the rounds and bits' balance of the fit.
SAMPLE = 20_000
ROUNDS = 30
#: Chance that a pair at the threshold meets in a table.
RECALL = 0.99
#: Vectors that a bucket holds undivided, and pairs that are compared at once.
BLOCK = 512
PAIRS = 1 << 16
#: Of the centred sample, so much of the unit length must remain; else the codes are taken about the origin.
SHORTEST = 0.5


@dataclass(frozen=True)
class Codes:
    """Fitted codes: signs of (x - centre) @ axes, cut into ``tables`` substrings of ``width`` bits."""

    centre: np.ndarray
    axes: np.ndarray
    width: int
    tables: int

    def bits(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables, width) booleans."""
        signs = (units - self.centre) @ self.axes > 0
        return signs[:, : self.tables * self.width].reshape(len(units), self.tables, self.width)

    def substrings(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables) integers."""
        return self.bits(units) @ (1 << np.arange(self.width, dtype=np.int64))


def units(flat: np.ndarray, width: int) -> np.ndarray:
    """Rows of unit length in double precision, safe against overflow."""
    rows = flat.astype(np.float64).reshape(-1, width)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def rotation(turned: np.ndarray, seed: int) -> np.ndarray:
    """The orthogonal matrix that brings the rows nearest to their own signs."""
    n = turned.shape[1]
    now = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    for _ in range(ROUNDS):
        corners = np.where(turned @ now > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(turned.T @ corners)
        now = left @ right
    return now


def fit(sample: np.ndarray, n: int, threshold: float) -> Codes:
    """Codes for ``n`` vectors, learned on unit vectors of the sample."""
    centre = sample.mean(axis=0)
    length = float(np.quantile(np.linalg.norm(sample - centre, axis=1), 0.05))
    if length < SHORTEST:
        centre, length = np.zeros_like(centre), 1.0
    # angle, seen from the centre, between two unit vectors at the threshold
    chord = math.sqrt(2 - 2 * threshold)
    flip = 2 * math.asin(min(1.0, chord / (2 * length))) / math.pi
    width = min(40, max(8, math.ceil(math.log2(n + 1)) - 2))
    meets = (1 - flip) ** width
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meets))
    about = sample - centre
    _, axes = np.linalg.eigh(about.T @ about)
    turned = about @ axes
    restarts = math.ceil(width * tables / sample.shape[1])
    return Codes(centre, np.hstack([axes @ rotation(turned, seed) for seed in range(restarts)]), width, tables)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows by class key, classes): equal vectors are one class; ``key`` is null where a vector can't link."""
    x = F.col("embedding")
    fine = F.coalesce((F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    key = F.when(fine, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("key", key)
    # one row for each key and task before the shuffle, whatever the number of copies
    kinds = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("x"))
    return rows.select("vec_id", "key"), settle(kinds.withColumn("node", F.monotonically_increasing_id()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return units(column.flatten().to_numpy(zero_copy_only=False), width)


def postings(kinds: DataFrame, codes: Codes, width: int, wide: bool) -> DataFrame:
    """A row for each class and table: the bucket and, if ``wide``, all that the comparison needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                found = codes.substrings(_matrix(batch.column("x"), width))
                buckets = (found + (np.arange(codes.tables, dtype=np.int64) << 40)).ravel()
                if not wide:
                    yield pa.RecordBatch.from_arrays([pa.array(buckets)], ["bucket"])
                    continue
                at = pa.array(np.repeat(np.arange(batch.num_rows), codes.tables))
                code = pa.array([row.tobytes() for row in np.packbits(codes.bits(_matrix(batch.column("x"), width)).reshape(batch.num_rows, -1), axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(buckets), *(batch.column(c).take(at) for c in ("node", "n", "x")), code.take(at)], ["bucket", "node", "n", "x", "code"])

    kind = dict(kinds.dtypes)["x"]
    return kinds.select("node", "n", "x").mapInArrow(run, "bucket long" + (f", node long, n long, x {kind}, code binary" if wide else ""))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of a symmetric boolean matrix."""
    left, out = linked.any(axis=1), []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        front = np.array([root])
        left[root] = False
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            out += [(int(root), int(v)) for v in front]
    return out


class Comparer:
    """Compares the vectors of groups; gathers (node, links, other) rows."""

    def __init__(self, codes: Codes, width: int, threshold: float) -> None:
        self.codes, self.width, self.threshold = codes, width, threshold
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = []

    def fresh(self, table: int, code: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the pairs (i, j) meet in no earlier table."""
        c = self.codes
        out = np.zeros(len(i), bool)
        for a in range(0, len(i), PAIRS):
            differ = np.unpackbits(code[i[a : a + PAIRS]] ^ code[j[a : a + PAIRS]], axis=1)[:, : table * c.width]
            out[a : a + PAIRS] = differ.reshape(len(differ), table, c.width).any(axis=2).all(axis=1) if table else True
        return out

    def count(self, tables: np.ndarray, batch: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        """Counts linked pairs at the ends of the first table they meet in."""
        node, n, code = batch
        for table in np.unique(tables):
            here = tables == table
            a, b = i[here], j[here]
            new = self.fresh(int(table), code, a, b)
            a, b = a[new], b[new]
            both = np.concatenate([a, b])
            sums = np.bincount(both, np.concatenate([n[b], n[a]]).astype(np.float64), len(node))
            at = np.unique(both)
            self.rows.append((node[at], sums[at].astype(np.int64), None))

    def edges(self, a: np.ndarray, b: np.ndarray) -> None:
        self.rows.append((a, np.zeros(len(a), np.int64), b))

    def small(self, bucket: np.ndarray, x: np.ndarray, batch: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, sizes: np.ndarray) -> None:
        """Many groups of a few vectors each: their pairs, some at a time."""
        where = np.concatenate([np.arange(s, s + k) for s, k in zip(starts, sizes, strict=True)])
        left = np.concatenate([np.arange(k - 1, -1, -1) for k in sizes])  # partners that follow each vector
        total = np.concatenate(([0], np.cumsum(left)))
        a = 0
        while a < len(where):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
            i = np.repeat(where[a:b], left[a:b])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[a:b] - total[a], left[a:b])
            good = np.einsum("ij,ij->i", x[i], x[j]) >= self.threshold
            i, j = i[good], j[good]
            if len(i):
                self.count(bucket[i] >> 40, batch, i, j)
                self.edges(batch[0][i], batch[0][j])
            a = b

    def large(self, table: int, x: np.ndarray, batch: tuple[np.ndarray, np.ndarray, np.ndarray], own: np.ndarray) -> None:
        """One group; ``own`` tells the two blocks of a pair of blocks apart (all alike: one block with itself)."""
        linked = x @ x.T >= self.threshold
        np.fill_diagonal(linked, False)
        if own.any() and not own.all():
            linked &= own[:, None] ^ own[None, :]
        i, j = np.nonzero(np.triu(linked))
        if len(i):
            self.count(np.full(len(i), table), batch, i, j)
            found = np.array(forest(linked))
            self.edges(batch[0][found[:, 0]], batch[0][found[:, 1]])

    def flush(self) -> pa.RecordBatch:
        node = np.concatenate([r[0] for r in self.rows] or [np.zeros(0, np.int64)])
        links = np.concatenate([r[1] for r in self.rows] or [np.zeros(0, np.int64)])
        other = pa.concat_arrays([pa.nulls(len(r[0]), pa.int64()) if r[2] is None else pa.array(r[2], pa.int64()) for r in self.rows] or [pa.nulls(0, pa.int64())])
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), other], ["node", "links", "other"])


def compared(kinds: DataFrame, codes: Codes, width: int, threshold: float) -> DataFrame:
    """(node, links, other): counts to be summed, and spanning edges where ``other`` is set."""
    crowded = postings(kinds, codes, width, wide=False).groupBy("bucket").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    # a block meets itself (once) and every other block (once)
    groups = F.when(F.col("held").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("own")))).otherwise(
        F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, own).alias("p"), F.greatest(k, own).alias("q"), own.alias("own")))
    )
    dealt = postings(kinds, codes, width, wide=True).join(crowded, "bucket", "left").withColumn("g", F.explode(groups))
    order = ["bucket", "p", "q"]
    dealt = dealt.select("bucket", "g.p", "g.q", "g.own", "node", "n", "code", "x").repartition(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Comparer(codes, width, threshold)

        def one(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            bucket, p, q, mine, node, n = (table[c].to_numpy() for c in ("bucket", "p", "q", "own", "node", "n"))
            x = units(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), width)
            code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(x), -1)
            cuts = np.flatnonzero(np.concatenate(([True], (np.diff(bucket) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0), [True])))
            starts, sizes = cuts[:-1], np.diff(cuts)
            few = (sizes > 1) & (sizes <= 32) & (p[starts] == q[starts])
            if few.any():
                work.small(bucket, x, (node, n, code), starts[few], sizes[few])
            for s, k in zip(starts[~few], sizes[~few], strict=True):
                if k > 1:
                    e = s + k
                    work.large(int(bucket[s]) >> 40, x[s:e], (node[s:e], n[s:e], code[s:e]), (mine[s:e] == p[s]) & (p[s] != q[s]))
            return work.flush()

        rest = None
        for batch in batches:
            table = pa.table(batch) if rest is None else pa.concat_tables([rest, pa.table(batch)])
            last = tuple(table[c][-1].as_py() for c in order)
            same = (table["bucket"].to_numpy() == last[0]) & (table["p"].to_numpy() == last[1]) & (table["q"].to_numpy() == last[2])
            cut = int(np.argmax(same))
            if cut:
                yield one(table.slice(0, cut))
            rest = table.slice(cut)
        if rest is not None:
            yield one(rest)

    return dealt.mapInArrow(run, "node long, links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, kinds = classes(vectors)
    found = None
    for (width,) in sorted(kinds.select(F.size("x")).distinct().collect()):
        some = kinds.where(F.size("x") == width)
        sample = some.orderBy("key.a", "key.b").limit(SAMPLE).select("x").toArrow()["x"].combine_chunks()
        codes = fit(_matrix(sample, width), some.count(), threshold)
        part = compared(some, codes, width, threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "node long, links long, other long")
    found = settle_table(found, "itq-links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = kinds.select("node", "key", "n", "low").join(sums, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(lows, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = rows.join(known, "key", "left")
    n_links = F.coalesce("links", F.lit(0)).cast("long")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    kept = F.when(F.col("vec_id").isNull(), n_links == 0).otherwise(F.col("vec_id") == component)
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def oracle(threshold: float = 0.95) -> str:
    """Every pair by brute force, and what can be reached from each vector; for small tables."""
    return f"""
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x, coalesce(len(embedding) > 0
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0, false) AS fine
    FROM embeddings),
pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE a.fine AND b.fine AND list_cosine_similarity(a.x, b.x) >= {threshold}),
reached(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b),
lows AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT v.vec_id, coalesce(links.n, 0)::BIGINT AS n_links, lows.low AS component_id, v.vec_id = lows.low AS kept
FROM v JOIN lows ON lows.a = v.vec_id LEFT JOIN links ON links.a = v.vec_id"""
