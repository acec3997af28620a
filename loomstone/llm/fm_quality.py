"""A factorisation machine that scores the quality of texts.

Features are hashed words (by frequency), bands of structure statistics and
bands of length; each has a weight and a short factor vector.  Pairwise
interactions of all features of a text cost one pass over its features by the
identity  sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i x_i v_i|^2 - sum_i |x_i v_i|^2) / 2.

Labels, languages, sources and ids are never inputs.  The machine is fitted on
at most ``TRAIN_ROWS`` labelled rows outside the held-out fold, taken by the
order of a hash of their ids and hashed in the tasks; every text, however long, is
scored whole.

Defined results: a null or empty text has only its length and structure bands
and still gets a score; without usable labels every score is 0.5; repeated
texts get equal scores; labels of one document that disagree count by their
rounded mean; an empty table stays empty; other columns are carried on,
like-named ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.llm.columns import append
from loomstone.llm.words import NOT_SPACE, byte_class, lower_ascii, prefix_hash, slices, span_hash, spans

#: Most labelled rows that are gathered for fitting, hashed word slots, factors, folds and the decision threshold.
TRAIN_ROWS = 6_000
SLOTS = 1 << 15
FACTORS = 8
FOLDS = 5
THRESHOLD = 0.3

_BANDS = 12
_SYMBOL = byte_class((0x21, 0x2B), (0x2F, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_DIGIT, _UPPER, _HIGH = byte_class((0x30, 0x39)), byte_class((0x41, 0x5A)), byte_class((0xC0, 0xFF))
_LINE, _STOP = byte_class((0x0A, 0x0A)), byte_class((0x2E, 0x2E))
_CLASSES = (_SYMBOL, _DIGIT, _UPPER, _HIGH, _LINE, _STOP)
#: Statistics by band: six byte classes, word length, its spread, distinct-word share, most frequent word's share, words.
N_STATS = len(_CLASSES) + 5
WIDTH = SLOTS + N_STATS * _BANDS


def _band(share: np.ndarray) -> np.ndarray:
    """Shares of 1 on a scale of halvings."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(_BANDS + np.log2(np.maximum(share, 1e-9))), 0, _BANDS - 1).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of a slice's texts, ordered by row."""
    rows = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    low = lower_ascii(data)
    s, e, first = spans(low, offsets, NOT_SPACE)
    n = np.diff(first)
    many = np.maximum(n, 1)
    row_of = np.repeat(np.arange(rows), n)
    stats = np.zeros((N_STATS, rows), np.int64)
    for k, table in enumerate(_CLASSES):
        sums = np.concatenate(([0], np.cumsum(table[data])))
        stats[k] = _band((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    length = (e - s).astype(float)
    mean = np.bincount(row_of, length, rows) / many
    spread = np.sqrt(np.maximum(np.bincount(row_of, length**2, rows) / many - mean**2, 0))
    slot = (span_hash(prefix_hash(low), s, e) % np.uint64(SLOTS)).astype(np.int64) if len(s) else np.zeros(0, np.int64)
    pair, times = np.unique(row_of * SLOTS + slot, return_counts=True)
    pair_row, pair_slot = pair // SLOTS, pair % SLOTS
    distinct = np.bincount(pair_row, minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, pair_row, times)
    k = len(_CLASSES)
    stats[k] = np.clip(mean, 0, _BANDS - 1).astype(np.int64)
    stats[k + 1] = np.clip(spread, 0, _BANDS - 1).astype(np.int64)
    stats[k + 2] = np.clip(distinct / many * (_BANDS - 1), 0, _BANDS - 1).astype(np.int64)
    stats[k + 3] = np.clip(top / many * (_BANDS - 1) * 2, 0, _BANDS - 1).astype(np.int64)
    stats[k + 4] = np.clip(np.log2(n + 1), 0, _BANDS - 1).astype(np.int64)
    fixed = SLOTS + np.arange(N_STATS)[:, None] * _BANDS + stats
    row = np.concatenate([pair_row, np.tile(np.arange(rows), N_STATS)])
    feature = np.concatenate([pair_slot, fixed.ravel()])
    norm = np.sqrt(np.bincount(pair_row, times.astype(float) ** 2, rows))
    value = np.concatenate([times / norm[pair_row], np.full(N_STATS * rows, 1 / np.sqrt(N_STATS))])
    order = np.argsort(row, kind="stable")
    return row[order], feature[order], value[order].astype(np.float32)


@dataclass
class Machine:
    """Bias, weights and factors."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's output and the factor sums of every row; linear in the features."""
        edge = np.searchsorted(row, np.arange(rows))
        linear = np.add.reduceat(self.weight[feature] * value, edge)
        scaled = self.factor[feature] * value[:, None]
        sums = np.add.reduceat(scaled, edge, axis=0)
        squares = np.add.reduceat((scaled**2).sum(1), edge)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def score_column(self, column: pa.Array) -> list[pa.Array]:
        out = [np.zeros(0)]
        for a, b, data, offsets in slices(column):
            z, _ = self.raw(*features(data, offsets), b - a)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return [pa.array(np.concatenate(out).astype(np.float64))]


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.1, batch: int = 64, decay: float = 1e-5) -> Machine:
    """Adaptive gradient descent on the logistic loss over the features of each row; classes weigh the same and the seed is fixed."""
    rng = np.random.default_rng(7)
    model = Machine(0.0, np.zeros(WIDTH, np.float32), (rng.standard_normal((WIDTH, FACTORS)) * 0.01).astype(np.float32))
    if len(labels) == 0:
        return Machine(0.0, model.weight, np.zeros_like(model.factor))
    edge = np.searchsorted(row, np.arange(len(labels) + 1))
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    importance = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
    gw, gv, gb = np.full(WIDTH, 1e-6), np.full((WIDTH, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            n = edge[pick + 1] - edge[pick]
            index = np.repeat(edge[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            r, f, x = np.repeat(np.arange(len(pick)), n), feature[index], value[index]
            z, sums = model.raw(r, f, x, len(pick))
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * importance[pick] / len(pick)).astype(np.float32)
            used, back = np.unique(f, return_inverse=True)
            dw = np.bincount(back, slope[r] * x) + decay * model.weight[used]
            own = model.factor[f] * x[:, None]
            step = (slope[r] * x)[:, None] * (sums[r] - own)
            dv = np.stack([np.bincount(back, step[:, k]) for k in range(FACTORS)], 1) + decay * model.factor[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += float(slope.sum()) ** 2
            model.weight[used] -= rate * dw / np.sqrt(gw[used])
            model.factor[used] -= 0.2 * rate * dv / np.sqrt(gv[used])
            model.bias -= rate * float(slope.sum()) / gb**0.5
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that never teaches: crc32 of the id as text divides by the number of folds."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fit on a bounded sample of labelled documents outside the held-out fold."""
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most ``rows`` ids and labels are sent to the scan; what comes back is hashed there, at most ``WIDTH`` features a row
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    made = found.mapInArrow(_hashed, "doc_id long, label int, feature array<int>, value array<float>").toArrow()
    order = sorted(enumerate(zip(made["doc_id"].to_pylist(), made["feature"].to_pylist(), strict=True)), key=lambda x: x[1])
    made = made.take(pa.array([i for i, _ in order], pa.int64()))
    size = np.array([len(x) for x in made["feature"]], np.int64)
    flat = [np.concatenate([np.zeros(0, kind), *(x.values.to_numpy() for x in made[name])]) for name, kind in (("feature", np.int32), ("value", np.float32))]
    return fit(np.repeat(np.arange(len(size)), size), *flat, made["label"].to_numpy().astype(np.float64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column(1)):
            row, feature, value = features(data, offsets)
            edge = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x)) for x in (feature.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *lists], ["doc_id", "label", "feature", "value"])


def score(docs: DataFrame, machine: Machine, keep: Sequence[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Append ``score`` and ``predicted`` to every document; the machine, of a fixed size, goes to the tasks once."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    out = append(docs, "text", (T.StructField("score", T.DoubleType()),), lambda column: sent.value.score_column(column), keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
