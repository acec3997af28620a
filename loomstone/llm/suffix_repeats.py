"""Exact removal of long repeated byte strings with common-prefix interval trees.

Every string of ``LENGTH`` bytes is represented by the gram of ``GRAM`` bytes
that hashes lowest in it, its anchor: equal strings have equal anchors at the
same place.  Only suffixes at anchors enter a suffix array, one for each
distinct anchor, over the distinct surroundings in which it occurs.  A stack
scan of the array's common prefixes gives its interval tree.  The members of an
interval share that prefix; a second tree, over what stands before them, tells
where their left extension becomes diverse.  Each of its nodes is a maximal
repeat with all its members, and each member is covered by the outermost of its
repeats.

Surroundings that are equal are folded before the array is built, so groups of
copies cost one row.  An anchor with more than ``GROUP`` distinct surroundings
is split by longer cores: two of them that share ``LENGTH`` bytes share either
half of the missing bytes on the right of the core or the rest on the left, so
both cores take the place of the one.  A longer core needs narrower
surroundings, more of which are equal and are folded again, until the groups are
small enough for an array; a core of ``LENGTH`` bytes has one kind of
surroundings, itself.

Defined results: a null or empty text has no bytes; texts under ``LENGTH``
bytes repeat nothing; repeats may overlap and may lie in one text; matches
never cross texts; removed bytes may leave invalid UTF-8 only where a repeat
cut a character, and the kept text then lacks the broken character; every row
stands for itself, whether its id is null, repeated or its own; extra columns of
any name are ignored by ``digest`` and carried by ``remove``; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.store import keyed, settle, settle_table
from loomstone.llm.words import NOT_SPACE, mix, prefix_hash, ragged, slices, span_hash, spans

LENGTH = 400
GRAM = 128
#: Most distinct surroundings that one suffix array takes.
GROUP = 4096
#: Rows of surroundings, texts, and bytes of text that a task works on at once.
CHUNK = 4096
TEXTS = 512
SLICE = 1 << 20
#: Slots of the table that tells texts without any repeated anchor from the others before a shuffle.
SLOTS = 1 << 20

_CONTEXT = "anchor long, around long, doc_id long, place int, left int, times long, core_left int, core_right int, crowded boolean, body binary"


def anchors(data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending anchor positions of a slice and their gram hashes."""
    n = len(data)
    rooms = np.diff(offsets) - length + 1
    if not (rooms > 0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    wide, span = length - gram + 1, 1
    while span < wide:  # minima over windows of doubling width
        step = min(span, wide - span)
        np.minimum(low[: len(low) - step], low[step:], out=low[: len(low) - step])
        span += step
    valid = np.zeros(n + 1, np.int64)
    some = rooms > 0
    np.add.at(valid, offsets[:-1][some], 1)
    np.add.at(valid, offsets[:-1][some] + rooms[some], -1)
    starts = np.flatnonzero(np.cumsum(valid)[:n] > 0)
    picked = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    picked = np.unique(picked)
    return picked, hashes[picked]


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, which bounds what a task holds as Python values."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _scan(length: int, gram: int):
    """Anchors of every document by surroundings: equal ones of a document share a row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, _, data, offsets in slices(batch.column(1), SLICE):
                sums = prefix_hash(data)
                pos, key = anchors(data, offsets, sums, length, gram)
                if not len(pos):
                    continue
                row = np.searchsorted(offsets, pos, "right") - 1
                lo, hi = np.maximum(offsets[row], pos - (length - gram)), np.minimum(offsets[row + 1], pos + length)
                around = mix(span_hash(sums, lo, hi) + (pos - lo).astype(np.uint64))
                order = np.lexsort((pos, around, key, row))
                pos, key, row, around, lo, hi = (x[order] for x in (pos, key, row, around, lo, hi))
                fresh = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (around[1:] != around[:-1]))))
                ends = np.append(fresh, len(pos)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(ends), pa.array((pos - offsets[row]).astype(np.int32)))
                cols = [
                    pa.array(key[fresh].view(np.int64)), pa.array(around[fresh].view(np.int64)), ids.take(pa.array(row[fresh] + a)),
                    pa.array((pos - lo)[fresh].astype(np.int32)), pa.array((hi - pos)[fresh].astype(np.int32)), places,
                ]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "around", "doc_id", "left", "right", "places"])

    return scan


def _cut(length: int, gram: int):
    """The surroundings themselves, for the wanted anchors of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, TEXTS):
            rows = []
            for doc, text, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = text.encode()
                for w in want:
                    lo = max(0, w["place"] - (length - gram))
                    rows.append((w["anchor"], w["around"], doc, w["place"], w["place"] - lo, w["times"], 0, gram, w["crowded"], body[lo : w["place"] + length]))
                    if len(rows) == CHUNK:
                        yield _contexts(rows)
                        rows = []
            yield _contexts(rows)

    return cut


def _contexts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
    names = ["anchor", "around", "doc_id", "place", "left", "times", "core_left", "core_right", "crowded", "body"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 10, kinds, strict=True)], names)


def _split(length: int):
    """Surroundings under the two longer cores, one of which any two of them that share ``length`` bytes have in common."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, CHUNK // 2):
            rows = []
            for key, _, doc, place, left, times, back, on, _, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                missing = length - back - on
                right = (missing + 1) // 2
                before = missing - right + 1
                for side, a, b in ((0, back, on + right), (1, back + before, on)):
                    lo, hi = max(0, left - length + b), min(len(body), left + length - a)  # what a repeat around the core may reach
                    if a <= left and left + b <= len(body) and hi - lo >= length:
                        name = xxhash.xxh3_64_intdigest(body[left - a : left + b], (key * 2 + side) & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
                        around = xxhash.xxh3_64_intdigest(body[lo:hi], left - lo) - (1 << 63)
                        rows.append((name, around, doc, place, left - lo, times, a, b, False, body[lo:hi]))
            yield _contexts(rows)

    return split


def interval_tree(common: list[int]) -> list[tuple[int, int, int]]:
    """(prefix, first, last) of every common-prefix interval, inner ones first, by one stack scan.

    ``common[i]`` is what members i - 1 and i of the suffix array share; entry 0 is not read.
    """
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for i in range(1, len(common) + 1):
        value = common[i] if i < len(common) else -1
        first = i - 1
        while stack and stack[-1][0] > value:
            prefix, first = stack.pop()
            if i - 1 > first:
                out.append((prefix, first, i - 1))
        if value >= 0 and (not stack or stack[-1][0] < value):
            stack.append((value, first))
    return out


def _sorted_rows(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each group in the order of their bytes, and how many leading bytes each shares with the row before it."""
    wide = int(size.max()) if len(size) and size.max() else 1
    column = np.arange(wide)
    # no byte of UTF-8 is 255: one is added to each, so that the filling differs from all of them
    table = np.zeros((len(size), wide), np.uint8)
    table[(column >= wide - size[:, None]) if backwards else (column < size[:, None])] = data[ragged(start, size)] + 1
    if backwards:
        table = np.ascontiguousarray(table[:, ::-1])
    order = np.lexsort((table.view(f"S{wide}").ravel(), group))
    common = np.zeros(len(size), np.int64)
    differ = table[order[1:]] != table[order[:-1]]
    common[1:] = np.where(differ.any(1), differ.argmax(1), size[order[1:]])
    return order, common


def maximal_groups(body: pa.Array, left: np.ndarray, edge: np.ndarray, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(bytes left, bytes right, members) of every maximal repeat of at least ``least`` bytes, one at a time.

    The rows are distinct surroundings of an anchor, which stands ``left`` bytes behind their start; those of group k have one
    anchor and are the rows from ``edge[k]`` on.
    """
    size = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4).astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8) if body.buffers()[2] else np.zeros(0, np.uint8)
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    array, right_common = _sorted_rows(data, size[:-1] + left, np.diff(size) - left, group, False)  # the suffix array
    before, left_common = _sorted_rows(data, size[:-1], left, group, True)
    rank, place = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
    rank[before] = place[array] = np.arange(len(left))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a == 2:  # the tree of two members is one interval
            x, y = int(left_common[a + 1]), int(right_common[a + 1])
            if x + y >= least:
                yield x, y, array[a:b]
            continue
        for prefix, first, last in interval_tree(right_common[a:b].tolist()) if b - a > 2 else ():
            ranks = np.sort(rank[array[a + first : a + last + 1]])
            shared = np.minimum.reduceat(left_common[: ranks[-1] + 1], ranks[:-1] + 1)
            if shared.max() + prefix < least:
                continue
            for back, i, j in interval_tree([0, *shared.tolist()]):  # where the left extension becomes diverse
                if back + prefix >= least:
                    members = before[ranks[i : j + 1]]
                    lo, hi = place[members].min(), place[members].max()
                    if right_common[lo + 1 : hi + 1].min() == prefix:  # else an inner interval has them
                        yield back, prefix, members


def _by_anchor(solve):
    """Apply ``solve`` to whole anchors of a partition that is sorted by anchor; an anchor may run on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _sliced(batches, CHUNK // 2):
            last = batch.column(0)[-1].as_py()
            cut = int(np.searchsorted(batch.column(0).to_numpy(), last))  # the last anchor may run on
            if cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(0)[-1].as_py() != last:
                yield from solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _groups_of(table: pa.Table, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    key = table["anchor"].to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    return maximal_groups(table["body"].combine_chunks(), table["left"].to_numpy().astype(np.int64), edge, length)


def _cover(length: int):
    """The bytes around each anchor that its maximal repeats cover."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        far = np.zeros((2, table.num_rows), np.int64)
        for x, y, members in _groups_of(table, length):
            far[0, members] = np.maximum(far[0, members], x)
            far[1, members] = np.maximum(far[1, members], y)
        place = table["place"].to_numpy().astype(np.int64)
        some = pa.array((far.sum(0) > 0) & (table["times"].to_numpy() == 1))
        cols = [table["doc_id"].combine_chunks(), pa.array(place - far[0]), pa.array(place + far[1])]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "stop"]).filter(some)

    return _by_anchor(solve)


def _report(length: int):
    """The maximal repeats themselves, a row for each."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, doc, place = (table[c].to_numpy() for c in ("anchor", "doc_id", "place"))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("doc_id", pa.int64()), ("place", pa.int64())])))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "back", "on", "members"])

        rows, held = [], 0
        for x, y, m in _groups_of(table, length):
            rows.append((int(key[m[0]]), x, y, [{"doc_id": int(doc[i]), "place": int(place[i])} for i in m.tolist()]))
            held += len(m)
            if held >= CHUNK:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    return _by_anchor(solve)


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")


def _touched(texts: DataFrame, slots: DataFrame, how: str = "left_semi") -> DataFrame:
    """The texts whose slot is (or, by left_anti, is not) taken; at most ``SLOTS`` numbers are broadcast."""
    return texts.withColumn("slot", _slot()).join(F.broadcast(slots), "slot", how).drop("slot")


class Anchored:
    """The repeated anchors of texts (doc_id, text), whose ids are their own.

    Joins by an anchor or its surroundings read written tables, so that a key with very many rows can be split.
    """

    def __init__(self, texts: DataFrame, length: int, gram: int, group: int):
        self.texts, self.length, self.gram, self.group = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), length, gram, group
        rows = settle_table(self.texts.mapInArrow(_scan(length, gram), "anchor long, around long, doc_id long, left int, right int, places array<int>"), "anchors")
        totals = rows.groupBy("anchor").agg(F.sum(F.size("places")).alias("total"), (F.min("around") != F.max("around")).alias("mixed")).where("total > 1").drop("total")
        self.hits = settle_table(rows.join(settle_table(totals, "anchor-totals"), "anchor"), "repeated-anchors")
        self.slots = self.hits.select(_slot()).distinct()
        rep = F.min(F.struct("doc_id", F.element_at("places", 1).alias("place"))).alias("rep")
        kinds = self.hits.groupBy("anchor", "around").agg(F.sum(F.size("places")).alias("times"), F.first("mixed").alias("mixed"), rep)
        self.kinds = settle_table(kinds, "surroundings")

    def whole(self) -> DataFrame:
        """Spans of surroundings that occur again as they are."""
        again = self.kinds.where("times > 1").select("anchor", "around")
        found = self.hits.where(F.col("left") + F.col("right") >= self.length).join(again, ["anchor", "around"])
        found = found.select("doc_id", F.explode("places").alias("p"), "left", "right")
        return found.select("doc_id", (F.col("p") - F.col("left")).cast("long").alias("start"), (F.col("p") + F.col("right")).cast("long").alias("stop"))

    def contexts(self) -> tuple[DataFrame, DataFrame | None]:
        """One text of each of the distinct surroundings of an anchor, in groups of at most ``group``; and spans that are sure already."""
        reps = self.kinds.where("mixed").select("anchor", "around", "times", "rep.doc_id", "rep.place")
        crowds = settle_table(self._sizes(reps).where(F.col("n") > self.group).select("anchor", F.lit(True).alias("crowded")), "crowds")
        if not crowds.limit(1).count():
            return self._cut(reps.withColumn("crowded", F.lit(False))), None
        told = reps.join(crowds, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        cut = settle_table(self._cut(told), "contexts")  # the texts move once for both
        every, sure = cut.where("NOT crowded"), None
        crowded: DataFrame | None = cut.where("crowded")
        while crowded is not None:
            cores = settle_table(crowded.mapInArrow(_split(self.length), _CONTEXT), "cores")
            first = [F.first(c).alias(c) for c in ("left", "core_left", "core_right", "crowded", "body")]  # equal in all of a kind
            kinds = cores.groupBy("anchor", "around").agg(F.min(F.struct("doc_id", "place")).alias("rep"), F.sum("times").alias("times"), *first)
            kinds = settle_table(kinds.select("anchor", "around", "rep.doc_id", "rep.place", "left", "times", "core_left", "core_right", "crowded", "body"), "kinds")
            again = cores.where("times = 1").join(kinds.where("times > 1").select("anchor", "around"), ["anchor", "around"])
            start = (F.col("place") - F.col("left")).cast("long")
            spans = again.select("doc_id", start.alias("start"), (start + F.octet_length("body")).alias("stop"))
            sure = spans if sure is None else sure.unionByName(spans)
            sizes = settle_table(self._sizes(kinds).where("n > 1"), "sizes")  # an anchor of one kind has nothing to share
            sized = kinds.join(sizes, "anchor")
            every = every.unionByName(sized.where(F.col("n") <= self.group).drop("n"))
            many = sizes.where(F.col("n") > self.group).limit(1).count() > 0
            crowded = sized.where(F.col("n") > self.group).drop("n") if many else None
        return every, sure

    def _sizes(self, kinds: DataFrame) -> DataFrame:
        return kinds.groupBy("anchor").agg(F.count("*").alias("n"))

    def _cut(self, reps: DataFrame) -> DataFrame:
        wanted = reps.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "around", "place", "times", "crowded")).alias("want"))
        return _touched(self.texts, self.slots).join(wanted, "doc_id").select("doc_id", "text", "want").mapInArrow(_cut(self.length, self.gram), _CONTEXT)


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, spans) with the bytes that repeats cover, as (start, stop) pairs that may overlap; and the slots of all such texts."""
    found = Anchored(texts, length, gram, group)
    contexts, sure = found.contexts()
    covered = contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_cover(length), "doc_id long, start long, stop long")
    spans = found.whole().unionByName(covered)
    spans = spans if sure is None else spans.unionByName(sure)
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), found.slots


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """The maximal repeats around every anchor that differ in their surroundings: (anchor, back, on, members).

    A repeat reaches ``back`` bytes before and ``on`` bytes behind each place of its members; of members with equal
    surroundings the smallest is listed.
    """
    contexts, _ = Anchored(keyed(docs).select("doc_id", "text"), length, gram, group).contexts()
    schema = "anchor long, back int, on int, members array<struct<doc_id: long, place: long>>"
    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_report(length), schema)


def _short(words: int, length: int):
    """Hashes of all runs of ``words`` whole words that have under ``length`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1), SLICE):
                s, e, first = spans(data, offsets, NOT_SPACE)
                if len(s) < words:
                    continue
                row = np.repeat(np.arange(b - a), np.diff(first))
                lo, hi = s[: len(s) - words + 1], e[words - 1 :]
                at = np.flatnonzero((row[: len(lo)] == row[words - 1 :]) & (hi - lo < length))
                if not len(at):
                    continue
                window = span_hash(prefix_hash(data), lo[at], hi[at])
                row = row[at]
                for x in range(0, len(at), 1 << 16):
                    y = slice(x, x + (1 << 16))
                    start = lo[at[y]] - offsets[row[y]]
                    cols = [pa.array(window[y].view(np.int64)), batch.column(0).take(pa.array(a + row[y])), pa.array(start), pa.array(start + hi[at[y]] - lo[at[y]])]
                    yield pa.RecordBatch.from_arrays(cols, ["window", "doc_id", "start", "stop"])

    return run


def short_repeats(texts: DataFrame, words: int, length: int) -> DataFrame:
    """(doc_id, spans) of runs of ``words`` words under ``length`` bytes that start anywhere else too; longer runs are found by bytes."""
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    windows = settle_table(texts.mapInArrow(_short(words, length), "window long, doc_id long, start long, stop long"), "short-windows")
    place = F.struct("doc_id", "start")
    twice = windows.groupBy("window").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("window")
    return windows.join(settle_table(twice, "repeated-windows"), "window").groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def with_spans(rows: DataFrame, length: int, gram: int, words: int | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, text, row) with a column of spans, null where nothing repeats; texts that no repeat touches aren't shuffled."""
    found, slots = repeats(rows, length, gram, group)
    if words:
        short = settle(short_repeats(rows, words, length))
        found = found.unionByName(short).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        slots = slots.union(short.select(_slot())).distinct()
    none = F.lit(None).cast(found.schema["spans"].dataType).alias("spans")
    rest = _touched(rows, slots, "left_anti").select("text", "row", none)
    return _touched(rows, slots).join(found, "doc_id", "left").select("text", "row", "spans").unionByName(rest)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that some span covers."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def kept_bytes(body: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for r in runs for x in r], len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True))


def digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, the hash of what is kept and the kept text, for every document."""
    rows = keyed(docs.select("doc_id", "text"))

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, TEXTS):
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                body, runs = (text or "").encode(), merged(spans)
                kept = kept_bytes(body, runs)
                row = (len(body), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if runs else text or "")
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    found = with_spans(rows, length, gram, group=group).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "spans")
    return found.mapInArrow(sum_up, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None, group: int = GROUP) -> DataFrame:
    """The documents without the bytes that repeats of ``length`` bytes, or of ``words`` words if given, cover; other columns are carried on."""
    found = with_spans(keyed(docs), length, gram, words, group)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, TEXTS):
            texts = []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                texts.append(kept_bytes(text.encode(), merged(spans)).decode(errors="ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "row"])

    out = found.mapInArrow(rewrite, found.drop("spans").schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
