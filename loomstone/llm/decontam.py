"""Benchmark decontamination with suffix arrays of the training shards.

Every task takes its documents shard by shard and sorts the word suffixes that
could hold a test window.  All test suffixes are then searched in that suffix
array word by word with binary search, which yields their places and, by
joining neighbouring windows, the longest verbatim matches.  The test side is
cut into blocks of a bounded size, built in tasks and written to the shared
folder; a task holds one block at a time while all of them pass over its shard,
so a benchmark of any size is searched whole in one scan of the documents.

Defined results: a null or empty text has no words and is clean; an item
without words matches nothing; item ids of any type are named by their text, equal
ones count once, and null is the empty name; an empty benchmark leaves every
document clean, and an empty table stays empty; very long texts and items are
searched whole, an item is never cut; rows with equal ids stand for themselves;
columns beside the text are carried on, like-named ones are replaced.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.columns import append
from loomstone.llm.store import filesystem, fresh_folder, settle
from loomstone.llm.words import LETTERS_DIGITS, lower_ascii, prefix_hash, ragged, slices, span_hash, spans

#: Words of a window, and the test bytes after which a block is closed.
WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Bytes of documents that one reading of the blocks serves.
GATHER_BYTES = 64 << 20

FIELDS = (
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest_match", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(data)
    s, e, first = spans(low, offsets, LETTERS_DIGITS)
    return (span_hash(prefix_hash(low), s, e) if len(s) else np.zeros(0, np.uint64)), first


class Suffixes:
    """The windows of a block of test items, as rows of word codes."""

    def __init__(self, vocabulary: np.ndarray, rows: np.ndarray, size: np.ndarray, at: np.ndarray, owner: np.ndarray, names: np.ndarray):
        self.vocabulary, self.rows, self.size, self.at, self.owner, self.names = vocabulary, rows, size, at, owner, names
        self.window = rows.shape[1]
        self.least = int(size.min()) if len(size) else 0

    @classmethod
    def build(cls, names: Sequence[str], texts: pa.Array, window: int) -> Suffixes:
        parts = [_words(data, offsets) for _, _, data, offsets in slices(texts)]
        hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
        words = np.concatenate([np.diff(first) for _, first in parts]) if parts else np.zeros(0, np.int64)
        begin = np.concatenate(([0], np.cumsum(words)))[:-1]
        vocabulary, code = np.unique(hashes, return_inverse=True)
        count = np.where(words > 0, np.maximum(words - window + 1, 1), 0)  # windows of each item
        owner = np.repeat(np.arange(len(words)), count)
        start = ragged(begin, count)
        size = np.minimum(words, window)[owner]
        column = np.arange(window)
        rows = np.where(column < size[:, None], code[np.minimum(start[:, None] + column, max(len(code) - 1, 0))] if len(code) else -1, -1).astype(np.int32)
        return cls(vocabulary, rows.reshape(-1, window), size, start - begin[owner], owner, np.array(list(names), str))

    def save(self, out) -> None:
        held = io.BytesIO()
        np.savez(held, vocabulary=self.vocabulary, rows=self.rows, size=self.size, at=self.at, owner=self.owner, names=self.names)
        out.write(held.getvalue())

    def search(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence in a shard whose rows begin at ``first``."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(hashes):
            return none, none
        code = np.searchsorted(self.vocabulary, hashes)
        code[code == len(self.vocabulary)] = 0
        code[self.vocabulary[code] != hashes] = -1
        # how many words of the vocabulary follow from each position inside its row
        stop = np.flatnonzero(code < 0)
        stop = np.unique(np.concatenate([stop, first[1:]]))
        index = np.arange(len(code))
        run = stop[np.searchsorted(stop, index, "right")] - index
        run[code < 0] = 0
        # a position that begins a row is in ``stop`` as the end of the row before: "right" skips it
        suffix = np.flatnonzero(run >= self.least)
        if not len(suffix):
            return none, none
        room = np.minimum(run[suffix], self.window)
        cols = np.full((self.window, len(suffix)), -1, np.int64)
        for k in range(self.window):
            has = room > k
            cols[k, has] = code[suffix[has] + k]
        order = np.lexsort(cols[::-1])  # the shard's suffix array
        suffix, cols = suffix[order], cols[:, order]
        width = len(self.vocabulary) + 1
        group, want = np.zeros(len(suffix), np.int64), np.zeros(len(self.rows), np.int64)
        alive = np.ones(len(self.rows), bool)
        low = np.zeros(len(self.rows), np.int64)
        high = np.full(len(self.rows), len(suffix), np.int64)
        for k in range(self.window):
            active = np.flatnonzero(alive & (self.size > k))
            if not len(active):
                break
            key = group * width + cols[k] + 1
            target = want[active] * width + self.rows[active, k] + 1
            a, b = np.searchsorted(key, target, "left"), np.searchsorted(key, target, "right")
            low[active], high[active] = a, b
            alive[active] = b > a
            new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            want[active] = new[np.minimum(a, len(new) - 1)]
            group = new
        hit = np.flatnonzero(alive & (self.size > 0))
        times = high[hit] - low[hit]
        where = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(int(times.sum()))
        return np.repeat(hit, times), suffix[where]

    def longest(self, win: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """For every occurrence, the words of the verbatim match up to its end that windows on one diagonal of one item form."""
        diagonal = pos - self.at[win]
        order = np.lexsort((pos, diagonal, self.owner[win]))
        o, d, p = self.owner[win][order], diagonal[order], pos[order]
        fresh = np.concatenate(([True], (o[1:] != o[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)))
        out = np.empty(len(win), np.int64)
        out[order] = p - p[fresh][np.cumsum(fresh) - 1] + self.size[win][order]
        return out


@functools.lru_cache(maxsize=1)
def _load(path: str) -> Suffixes:
    """A block by its path; a worker keeps the last one."""
    disk, name = filesystem(path)
    with disk.open_input_stream(name) as source, np.load(io.BytesIO(source.read())) as held:
        return Suffixes(*(held[k] for k in ("vocabulary", "rows", "size", "at", "owner", "names")))


def blocks(benchmark: DataFrame, window: int, block_bytes: int) -> list[str]:
    """Write the test side in blocks of about ``block_bytes`` (or one longer item); only their paths come back."""
    folder = fresh_folder(benchmark.sparkSession, "benchmark")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = filesystem(folder)
        disk.create_dir(root, recursive=True)
        names, texts, held, made = [], [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"block-{TaskContext.get().taskAttemptId()}-{made}.npz"
            with disk.open_output_stream(f"{root}/{path}") as out:
                Suffixes.build(names, pa.array(texts, pa.string()), window).save(out)
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{path}"])], ["path"])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                texts.append(text)
                held += len(text)
                if held >= block_bytes:
                    yield close()
                    names, texts, held, made = [], [], 0, made + 1
        if names:
            yield close()

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return sorted(r.path for r in settle(items.mapInArrow(build, "path string")).collect())


def annotate(texts: pa.Array, paths: Sequence[str]) -> list[pa.Array]:
    """n_words, n_hit, longest match, hit spans and item names of every text of a shard."""
    parts = [(b - a, *_words(data, offsets)) for a, b, data, offsets in slices(texts)]
    flags = [np.zeros(len(h) + 1, np.int64) for _, h, _ in parts]
    longest = [np.zeros(n, np.int64) for n, _, _ in parts]
    items: list[dict[int, set[str]]] = [{} for _ in parts]
    for path in paths:
        tests = _load(path)
        for k, (_, hashes, first) in enumerate(parts):
            win, pos = tests.search(hashes, first)
            if not len(win):
                continue
            np.add.at(flags[k], pos, 1)
            np.add.at(flags[k], pos + tests.size[win], -1)
            row = np.searchsorted(first, pos, "right") - 1
            np.maximum.at(longest[k], row, tests.longest(win, pos))
            for r, o in np.unique(np.stack([row, tests.owner[win]]), axis=1).T.tolist():
                items[k].setdefault(r, set()).add(str(tests.names[o]))
    out: list[list] = [[], [], [], [], []]
    for (n, hashes, first), flag, most, found in zip(parts, flags, longest, items, strict=True):
        hit = np.cumsum(flag[:-1]) > 0
        hits = np.diff(np.concatenate(([0], np.cumsum(hit)))[first])
        for r in range(n):
            turn = np.flatnonzero(np.diff(np.concatenate(([0], hit[first[r] : first[r + 1]], [0])).astype(np.int8))).tolist() if hits[r] else []
            for col, value in zip(out, (int(first[r + 1] - first[r]), int(hits[r]), int(most[r]), turn, sorted(found.get(r, ()))), strict=True):
                col.append(value)
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64()), pa.list_(pa.string())]
    return [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: Sequence[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Append to every document its words, hit words, hit spans and the items found in it."""
    paths = blocks(benchmark, window, block_bytes)
    # with one block it stays in the worker; with more, each is read once for so many bytes of documents
    return append(docs, "text", FIELDS, lambda texts: annotate(texts, paths), keep, GATHER_BYTES if len(paths) > 1 else 0)


def digest(found: DataFrame) -> DataFrame:
    """The counts and a hash of the item ids, sorted as strings."""
    ids = F.array_join(F.sort_array("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    kept = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return matches(kept, benchmark, window, ["__row"]).where("n_hit = 0").select("__row.*")


def oracle() -> str:
    """DuckDB SQL for the digest."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{word}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({low}, '{word}') AS w FROM benchmark),
    wins AS (
      SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS win
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT n FROM wins),
    places AS (
      SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    found AS (SELECT doc_id, item_id, i, n FROM places JOIN wins USING (n, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
    ids AS (
      SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h
      FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""
