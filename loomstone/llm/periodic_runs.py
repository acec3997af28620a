"""Runs of repeated words, found by a suffix automaton whose links are a link-cut forest.

Words are appended one after another.  Each suffix-link path carries the place where its strings ended last; the access of
the new prefix recolours its path, segment by segment.  A segment whose strings ended last at ``e`` and whose longest string
has ``n`` words tells that the ``n`` words before the new end and before ``e`` are the same: if their distance is at most
``n``, a square ends here, and it and the words before it that go on alike are one run.  The run grows while the same start
and distance are found again.  The distance is the smallest period, since the last place is the nearest.

Only stretches that can hold a run are appended: of a run of at least ``least`` words and ``times`` periods, every word lies in
a ``GRAM`` of words that stands again within the period, and the run lies in one stretch of such words, of which the period is
at most a part in ``times``.  Stretches are narrowed until nothing changes; the test is exact but for what it lets through.

Each text is one unit of one task: no join, no shuffle, no state between texts; memory follows the longest text.

Defined results: null and empty texts have no words and no runs; rows of one id, or without id, are texts of their own; an empty
table gives an empty table; other columns stay, like-named ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
LEAST, TIMES = 24, 3
#: Words that must stand again: a run keeps LEAST * (1 - 1 / TIMES) words when one period is taken away.
GRAM = 16
ROWS = 512


class Forest:
    """Suffix links as a link-cut forest; every preferred path has one colour, kept at the root of its splay tree.

    Node 0 is none.  The automaton's initial state is left out, so that paths end below it.
    """

    def __init__(self) -> None:
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]

    def leaf(self, above: int) -> None:
        self.left.append(0)
        self.right.append(0)
        self.up.append(above)
        self.colour.append(-1)

    def rotate(self, x: int) -> None:
        """Lifts x above its parent in their splay tree."""
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            up[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[p], up[x] = x, g

    def splay(self, x: int) -> int:
        """Brings a node to the root of its splay tree; returns the colour of its path."""
        left, right, up = self.left, self.right, self.up
        y, p = x, up[x]
        while p and (left[p] == y or right[p] == y):
            y, p = p, up[p]
        colour = self.colour[x] = self.colour[y]
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return colour
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self.rotate(p if (left[p] == x) == (left[g] == p) else x)
            self.rotate(x)

    def between(self, low: int) -> int:
        """A new node right above ``low``, on the same path."""
        new = len(self.up)
        colour = self.splay(low)
        above = self.left[low]
        self.leaf(self.up[low])
        self.left[new], self.right[new], self.colour[new] = above, low, colour
        if above:
            self.up[above] = new
        self.left[low], self.up[low] = 0, new
        return new

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Colours the path from x upwards; returns (deepest node on the path, colour before) of each segment."""
        segments, below, at = [], 0, x
        while at:
            old = self.splay(at)
            if old >= 0:
                segments.append((at, old))
            rest = self.right[at]
            if rest:
                self.colour[rest] = old
            self.right[at] = below
            below, at = at, self.up[at]
        self.colour[below] = colour
        self.splay(x)
        return segments


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    forest = Forest()
    follow: list[dict[int, int]] = [{}, {}]
    link, longest, last = [0, 0], [0, 0], 1
    ends: dict[tuple[int, int], int] = {}
    for i, word in enumerate(words):
        now = len(link)
        follow.append({})
        link.append(1)
        longest.append(i + 1)
        forest.leaf(0)
        at = last
        while at and word not in follow[at]:
            follow[at][word] = now
            at = link[at]
        if at:
            old = follow[at][word]
            if longest[at] + 1 != longest[old]:
                new = forest.between(old)
                follow.append(follow[old].copy())
                link.append(link[old])
                longest.append(longest[at] + 1)
                link[old] = new
                while at and follow[at].get(word) == old:
                    follow[at][word] = new
                    at = link[at]
                old = new
            link[now] = forest.up[now] = old
        last = now
        for node, end in forest.access(now, i):
            if i - end <= longest[node]:
                ends[end - longest[node] + 1, i - end] = i
    found = [(start, end - start + 1, period) for (start, period), end in ends.items()]
    return sorted((s, n, p) for s, n, p in found if n >= max(least, times * p))


def _mixed(words: np.ndarray) -> np.ndarray:
    """A hash of each GRAM of words, by doubling."""
    h, k = words.astype(np.uint64), 1
    while k < GRAM:
        h = h[:-k] * np.uint64(0x9E3779B97F4A7C15) ^ h[k:]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    return h ^ (h >> np.uint64(32))


def stretches(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside which no run of ``least`` words and ``times`` periods lies."""
    if len(words) < least:
        return []
    grams = _mixed(words)
    order = np.argsort(grams, kind="stable")
    again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(again):
        return []
    a, b = order[again], order[again + 1]
    near = np.full(len(grams), len(words), np.int64)
    near[a] = b - a
    near[b] = np.minimum(near[b], b - a)
    places = np.flatnonzero(near < len(words))
    near, most = near[places], np.full(len(places), len(words) // times)
    while True:
        good = near <= most
        places, near = places[good], near[good]
        if not len(places):
            return []
        cuts = np.flatnonzero(np.diff(places) > GRAM)
        starts = places[np.concatenate(([0], cuts + 1))]
        ends = places[np.concatenate((cuts, [len(places) - 1]))] + GRAM
        sizes = ends - starts
        if good.all() and (sizes >= least).all():
            return list(zip(starts.tolist(), ends.tolist(), strict=True))
        sizes[sizes < least] = 0
        most = np.repeat(sizes // times, np.diff(np.concatenate(([0], cuts + 1, [len(places)]))))


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's loops: the original word at each place of a text of n words; None where nothing changes."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    at = np.arange(n)
    at[start:] = start + (at[start:] - start) % period
    return at


def collapse(text: bytes, at: np.ndarray | None = None, least: int = LEAST, times: int = TIMES) -> tuple[list[tuple[int, int, int]], bytes]:
    """The runs of a text's words and the words that they leave; ``at`` puts other words in their places."""
    words = text.split()  # of bytes: at spaces and 09 to 0D, nothing else
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, words, count()), np.int64, len(words))
    ids = ids if at is None else ids[at]
    runs = []
    for a, b in stretches(ids, least, times):
        runs += [(a + s, n, p) for s, n, p in runs_of(ids[a:b].tolist(), least, times)]
    if at is None and not runs:
        return runs, b" ".join(words)
    kept = np.ones(len(ids), bool)
    for s, n, p in runs:
        kept[s + p : s + n] = False
    places = np.flatnonzero(kept) if at is None else at[kept]
    return runs, b" ".join([words[k] for k in places.tolist()])


def collapsed(docs: DataFrame, loops: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Rows with ``runs`` (start, length, period; by start and period) and ``collapsed``, the text without repeated periods.

    ``loops`` puts the contract's loops into the texts first.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    spans = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                texts = batch.column(len(kept)).cast(pa.binary()).to_pylist()
                ids = batch.column(len(kept) + 1).to_pylist()
                found, left = [], []
                for text, doc_id in zip(texts, ids, strict=True):
                    text = text or b""
                    runs, rest = collapse(text, looped(len(text.split()), doc_id) if loops else None)
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    left.append(rest)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), pa.array(found, spans), pa.array(left, pa.binary()).cast(pa.string())], [*kept, "runs", "collapsed"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema = (fields + ", " if fields else "") + "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    source = docs.select(*(docs[c] for c in kept), docs["text"].alias("__text"), docs["doc_id"].cast("long").alias("__id"))
    return source.mapInArrow(run, schema)


def _strongest(runs: Column) -> Column:
    """The run of the greatest exponent; the first of equal ones."""
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run and the hashes of the runs and of the words left."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = found.withColumn("best", _strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
