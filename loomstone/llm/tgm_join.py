"""Exact Jaccard self-join of word shingles by a token-group matrix.

Texts become sets of hashed word n-grams.  Equal sets are folded to one
representative.  Of every set only a prefix can decide whether a link is
possible: a link at t needs ceil(t n) common tokens, so two linked sets share
one of their first n - ceil(t n) + 1 tokens in any order that all sets use.
The order here goes by the corpus count of a token's rarest word, then by hash,
so prefixes hold tokens that few other texts have.

Sets that share a prefix token are partitioned into bounded groups of similar
ones by their min-hashes; inside a group linked sets are joined to cells, which
are bounded too.  The token-group matrix holds which token occurs in which cell.
A set is a query to every cell of another component, of sizes that allow a link,
with which it has a matrix entry in common; the cell's token union bounds the
overlap, and only cells whose bound reaches ceil(t n) are opened and compared set
by set.  The links found give the components.

Large groups of copies cost no pairs: equal sets are folded before, similar
ones are joined through their cells and a few pivots that every cell of a
crowded min-hash holds, and tokens of one component only are dropped.

Defined results: texts without words (null, empty, white space) have no
shingle and are linked with nothing; a text of fewer words than a shingle is
one shingle; rows of one id or without id are rows of their own, and a missing
id never names a component; a text of any length is used whole;
extra columns of any name are ignored, and carried by ``keep_one``; an empty
table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.graph import components
from loomstone.llm.store import clashing, keyed, settle
from loomstone.llm.words import NOT_SPACE, lower_ascii, mix, prefix_hash, slices, span_hash, spans

#: Sets a group or cell holds on average, queries opened in one task's group, and slots of the table of word counts.
GROUP = 64
QUERIES = 256
SLOTS = 1 << 20
#: Bytes of text that are cut to shingles at once; a worker's arrays take some fifty times as much.
SLICE = 1 << 20

_U = np.uint64
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SEEDS = (_U(0x243F6A8885A308D3), _U(0x13198A2E03707344), _U(0xA4093822299F31D0))


def shingle_sets(column: pa.Array, size: int, counts: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each row, their rarest words' counts) for every slice of a text column."""
    for a, b, data, offsets in slices(column, SLICE):
        low = lower_ascii(data)
        s, e, first = spans(low, offsets, NOT_SPACE)
        none = np.zeros(0, np.uint64)
        if not len(s):
            yield a, [none] * (b - a), [none.view(np.int64)] * (b - a)
            continue
        word = span_hash(prefix_hash(low), s, e)
        grams = np.zeros(len(word), np.uint64)
        times = rare = counts[word & _U(len(counts) - 1)] if counts is not None else np.zeros(len(word), np.int64)
        rare = rare.copy()
        for k in range(min(size, len(word))):
            grams[: len(word) - k] += word[k:] * _MULTIPLIERS[k]
            np.minimum(rare[: len(word) - k], times[k:], out=rare[: len(word) - k])
        grams = mix(grams)
        out, rarity = [], []
        for i in range(b - a):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= size:
                x, at = np.unique(grams[lo : hi - size + 1], return_index=True)
                out.append(x), rarity.append(rare[lo + at])
            elif hi > lo:
                few = (word[lo:hi] * _MULTIPLIERS[: hi - lo]).sum(dtype=np.uint64)
                out.append(mix(np.array([few + _U(int(hi - lo))], np.uint64))), rarity.append(rare[lo : lo + 1])
            else:
                out.append(none), rarity.append(none.view(np.int64))
        yield a, out, rarity


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Jaccard:
    """A threshold as a fraction of integers."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator

    def need(self, n: int) -> int:
        """Common tokens that any link of a set of ``n`` needs."""
        return -(-self.numerator * n // self.denominator)

    def linked(self, x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) > len(y):
            x, y = y, x
        if len(x) * self.denominator < len(y) * self.numerator:
            return False
        common = overlap(x, y)
        return self.denominator * common >= self.numerator * (len(x) + len(y) - common)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if not len(x) or not len(y):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def word_counts(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How often words of each hash slot occur in the whole corpus; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE):
                low = lower_ascii(data)
                s, e, _ = spans(low, offsets, NOT_SPACE)
                if len(s):
                    total += np.bincount((span_hash(prefix_hash(low), s, e) & _U(slots - 1)).astype(np.int64), minlength=slots)
        slot = np.flatnonzero(total)
        for at in range(0, len(slot), 1 << 16):
            part = slot[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "times"])

    counted = docs.select("text").mapInArrow(count, "slot int, times long").groupBy("slot").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(slots, np.int64)
    out[counted["slot"].to_numpy()] = counted["times"].to_numpy()
    return out


def signatures(docs: DataFrame, size: int, level: Jaccard, counts: np.ndarray) -> DataFrame:
    """doc_id, n, a 128-bit set fingerprint, two min-hashes and the prefix of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets, rarity in shingle_sets(batch.column(1), size, sent.value):
                n = np.array([len(x) for x in sets], np.int64)
                fields = np.zeros((4, len(sets)), np.uint64)
                prefixes = []
                for i, x in enumerate(sets):
                    if not len(x):
                        prefixes.append(_signed(x))
                        continue
                    fields[0, i], fields[1, i] = x.sum(dtype=np.uint64), mix(x ^ _SEEDS[0]).sum(dtype=np.uint64)
                    fields[2, i], fields[3, i] = mix(x ^ _SEEDS[1]).min(), mix(x ^ _SEEDS[2]).min()
                    take = len(x) - level.need(len(x)) + 1
                    # the sets are sorted by hash, so a stable sort orders by (rarity, hash)
                    prefixes.append(_signed(x[np.argsort(rarity[i], kind="stable")[:take]]))
                sizes = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                flat = np.concatenate(prefixes)
                cols = [batch.column(0).slice(a, len(sets)), pa.array(n), *(pa.array(_signed(f)) for f in fields), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp_a", "fp_b", "mh_a", "mh_b", "prefix"])

    schema = "doc_id long, n long, fp_a long, fp_b long, mh_a long, mh_b long, prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def _cells(level: Jaccard, size: int, most: int):
    """Join the linked sets of one group into cells of at most ``most`` own members.

    A cell is named by its smallest own member: a set is own in one group only, so a cell stays inside its group.  Rows that
    aren't own link the pivots, and the cells that a larger one was cut into, to its first cell.
    """

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("own", "descending")])
        ids, own = table["doc_id"].to_numpy(), table["own"].to_numpy()
        first = np.concatenate(([True], ids[1:] != ids[:-1]))
        table, ids, own = table.filter(pa.array(first)), ids[first], own[first]
        sets = [x for _, part, _ in shingle_sets(table["text"].combine_chunks(), size) for x in part]
        cells: list[list[int]] = []
        for i, x in enumerate(sets):
            joined = [c for c in cells if any(level.linked(x, sets[j]) for j in c)]
            cells = [c for c in cells if c not in joined] + [sorted([j for c in joined for j in c] + [i])]
        member, name, mine = [], [], []
        for c in cells:
            held = [j for j in c if own[j]]
            lead = (held or c)[0]
            for at in range(0, len(held), most):
                block = held[at : at + most]
                member += block + [block[0]]
                name += [block[0]] * len(block) + [lead]
                mine += [True] * len(block) + [False]
            pivots = [j for j in c if not own[j]]
            member += pivots
            name += [lead] * len(pivots)
            mine += [False] * len(pivots)
        return pa.table({"doc_id": ids[member], "cell": ids[name], "own": pa.array(mine, pa.bool_())})

    return join


def _open(level: Jaccard, size: int):
    """Bound every query of a cell by the cell's token union; open the cell for those that reach the bound."""

    def look(table: pa.Table) -> pa.Table:
        ids, query = table["doc_id"].to_numpy(), table["query"].to_numpy()
        sets = [x for _, part, _ in shingle_sets(table["text"].combine_chunks(), size) for x in part]
        members = [i for i in range(len(ids)) if not query[i]]
        a, b = [], []
        if members:
            union = np.unique(np.concatenate([sets[i] for i in members]))
            for i in np.flatnonzero(query):
                if overlap(sets[i], union) >= level.need(len(sets[i])):
                    hit = next((j for j in members if level.linked(sets[i], sets[j])), None)
                    if hit is not None:
                        a.append(ids[i]), b.append(ids[hit])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return look


def _grouped(cand: DataFrame, group: int) -> DataFrame:
    """Deal sets to groups by min-hash; crowded min-hashes are split, and their pivots go to every part."""
    by_hash = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    # both sides of the join that meets a crowded min-hash are written, so that it can be split
    pair = settle(cand.groupBy("mh_a", "mh_b").agg(F.count("*").alias("n_b"), F.min("doc_id").alias("p1"), F.max("doc_id").alias("p2"), F.min(by_hash).alias("p3"), F.max(by_hash).alias("p4")))
    by_a = pair.groupBy("mh_a").agg(F.sum("n_b").alias("n_a"), F.min("p1").alias("p1"), F.max("p2").alias("p2"), F.min("p3").alias("p3"), F.max("p4").alias("p4"))
    counts = settle(pair.select("mh_a", "mh_b", "n_b").join(settle(by_a), "mh_a"))
    part = F.pmod("mh_b", F.ceil(F.col("n_a") / group))
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_b") / group))
    dealt = settle(cand.join(counts, ["mh_a", "mh_b"]).select("doc_id", "mh_a", part.alias("part"), salt.alias("salt"), "n_a", "p1", "p2", F.col("p3.doc_id").alias("p3"), F.col("p4.doc_id").alias("p4")))
    own = dealt.select("doc_id", "mh_a", "part", "salt", F.lit(True).alias("own"))
    crowded = dealt.where(F.col("n_a") > group).select("mh_a", "part", "salt", "p1", "p2", "p3", "p4").distinct()
    pivots = crowded.select(F.explode(F.array_distinct(F.array("p1", "p2", "p3", "p4"))).alias("doc_id"), "mh_a", "part", "salt", F.lit(False).alias("own"))
    return own.union(pivots)


def jaccard_components(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest linked id) of every row; rows without id, or of one id, link as any others."""
    if not clashing(docs):
        return _components(docs, size, numerator, denominator, group)
    rows = keyed(docs.select("doc_id", "text"))
    given = rows.select("doc_id", F.col("row.doc_id").cast("long").alias("given"))
    found = settle(_components(rows, size, numerator, denominator, group).join(given, "doc_id"))
    named = found.groupBy("component_id").agg(F.min("given").alias("low"))
    return found.join(named, "component_id").select(F.col("given").alias("doc_id"), "n_shingles", F.col("low").alias("component_id"))


def _components(docs: DataFrame, size: int, numerator: int, denominator: int, group: int = GROUP) -> DataFrame:
    """The same where every row has an id of its own."""
    level = Jaccard(numerator, denominator)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = settle(signatures(texts, size, level, word_counts(texts)))
    classes = signed.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(F.min("doc_id").alias("rep"))
    classes = settle(classes)
    folded = signed.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"]).where("n > 0")

    tokens = folded.select("doc_id", F.posexplode("prefix").alias("place", "token"))
    shared = tokens.groupBy("token").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("token")
    matrix = settle(tokens.join(shared, "token"))
    cand = folded.select("doc_id", "mh_a", "mh_b").join(matrix.select("doc_id").distinct(), "doc_id", "left_semi")
    groups = settle(_grouped(settle(cand), group))

    wanted = texts.join(groups, "doc_id")
    joined = settle(wanted.groupBy("mh_a", "part", "salt").applyInArrow(_cells(level, size, 2 * group), "doc_id long, cell long, own boolean"))
    near = components(joined.select(F.col("doc_id").alias("a"), F.col("cell").alias("b")))
    cells = joined.where("own").select("doc_id", "cell").join(folded.select("doc_id", "n"), "doc_id")

    # the matrix again, with the component of every set; tokens of one component only can't add a link. Sets of the smaller
    # of two components are the queries: a crowd of linked sets is asked by cell, and doesn't ask for each of its sets
    roots = cells.join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", "cell", F.coalesce("root", "doc_id").alias("root"))
    roots = settle(roots)
    weight = roots.groupBy("root").agg(F.count("*").alias("weight"))
    placed = settle(matrix.join(roots.join(weight, "root"), "doc_id"))
    across = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    open_rows = settle(placed.join(across, "token"))
    entry = (F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("first"))
    # linked sizes differ by 1 / t at the most, so they lie in the same band of sizes or in neighbouring ones
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / math.log(denominator / numerator * 1.000001)) if numerator < denominator else F.col(n)
    columns = open_rows.groupBy("token", F.col("cell").alias("to_cell"), F.col("root").alias("to_root"), F.col("weight").alias("to_weight")).agg(*entry)
    # a pair's first common token leaves room for t / (1 + t) of both sizes behind it on either side
    needed = (F.col("n") + F.col("least")) * numerator
    fits = (F.col("n") * denominator >= F.col("least") * numerator) & (F.col("most") * denominator >= F.col("n") * numerator)
    for room in (F.col("n") - F.col("place"), F.col("most") - F.col("first")):
        fits = fits & (room * (numerator + denominator) >= needed)
    columns = columns.withColumn("band", F.explode(F.sequence(band("least") - 1, band("most") + 1)))
    asked = open_rows.withColumn("band", band("n")).join(columns, ["token", "band"]).where((F.struct("weight", "root") < F.struct("to_weight", "to_root")) & fits).select("doc_id", "to_cell").distinct()
    asked = settle(asked)
    sizes = asked.groupBy("to_cell").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
    ask = asked.join(sizes, "to_cell").select("doc_id", "to_cell", F.pmod(F.xxhash64("doc_id"), "chunks").alias("chunk"), F.lit(True).alias("query"))
    members = cells.withColumnRenamed("cell", "to_cell").join(sizes, "to_cell").select("doc_id", "to_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"))
    opened = texts.join(ask.union(members), "doc_id").groupBy("to_cell", "chunk").applyInArrow(_open(level, size), "a long, b long")

    links = settle(opened)
    bridges = links.join(roots.select(F.col("doc_id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("doc_id").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = components(bridges)
    final = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select(F.col("doc_id").alias("rep"), F.coalesce("top", "root").alias("component_id"))
    # a class of very many equal sets meets its name in one join, both sides of which are written
    named = settle(classes.join(final, "rep", "left").select("n", "fp_a", "fp_b", F.coalesce("component_id", "rep").alias("component_id")))
    member = signed.select("doc_id", "n", "fp_a", "fp_b").join(named, ["n", "fp_a", "fp_b"], "left")
    return member.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row of every component: the one with the smallest id, null last; rows of one id are rows of their own, copies as any others."""
    rows = keyed(docs)
    given = F.col("row.doc_id")
    order = F.struct(given.isNull().alias("none"), given.alias("given"), "doc_id")
    found = _components(rows.select("doc_id", "text"), size, numerator, denominator)
    best = found.join(rows.select("doc_id", order.alias("order")), "doc_id").groupBy("component_id").agg(F.min("order").alias("best"))
    kept = rows.join(best.select(F.col("best.doc_id").alias("doc_id")), "doc_id", "left_semi")
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
