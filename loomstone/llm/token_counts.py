"""Word-piece lengths of whole texts by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of
pieces popped on the way there, so greedy longest-match-first segmentation of a
word costs one step per byte and builds no pieces.  A word is read with the
vocabulary's leading space, so pieces that begin a word and pieces that continue
one are told apart by the trie itself.  A byte-level vocabulary holds every
byte, so every word has a segmentation.  Each slice of texts counts its
distinct words once, apart by a 64-bit hash.

Defined results: a null or empty text, or one of white space, has no words and
no tokens; a very long word costs time in proportion to its length; repeated
rows get equal counts; other columns are carried on, like-named ones replaced;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomstone.llm.columns import append
from loomstone.llm.tokens import default_vocabulary
from loomstone.llm.words import NOT_SPACE, prefix_hash, slices, span_hash, spans

FIELDS = (T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("max_word_tokens", T.LongType()))


class Automaton:
    """A trie over bytes with failure links and popped-piece counts."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            at = 0
            for byte in piece:
                to = self.next[at].get(byte)
                if to is None:
                    to = self.next[at][byte] = len(self.next)
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at > 0
        self.fail: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0]
        while level:
            below = []
            for up in level:
                for byte, node in self.next[up].items():
                    below.append(node)
                    if ends[node]:
                        self.fail[node], self.popped[node] = 0, 1
                        continue
                    back, count = self.fail[up], self.popped[up]
                    while back >= 0 and byte not in self.next[back]:
                        count += self.popped[back]
                        back = self.fail[back]
                    self.fail[node] = self.next[back][byte] if back >= 0 else -1
                    self.popped[node] = count
            level = below

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match cuts ``word`` into; -1 if it can't be cut."""
        following, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for byte in word:
            to = following[node].get(byte)
            while to is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return -1
                to = following[node].get(byte)
            node = to
        while node > 0:
            total += popped[node]
            node = fail[node]
        return total if node == 0 else -1


@functools.cache
def automaton(path: str) -> Automaton:
    with open(path, "rb") as lines:
        return Automaton(base64.b64decode(line.split()[0]) for line in lines)


def count_column(column: pa.Array, path: str) -> list[pa.Array]:
    """Words, tokens and the most tokens of a word, for every text."""
    machine = automaton(path)
    parts: list[list[np.ndarray]] = [[], [], []]
    for a, b, data, offsets in slices(column):
        s, e, first = spans(data, offsets, NOT_SPACE)
        total, most = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        if len(s):
            code, _ = pd.factorize(span_hash(prefix_hash(data), s, e))
            sample = np.zeros(int(code.max()) + 1, np.int64)
            sample[code[::-1]] = np.arange(len(code))[::-1]
            body = data.tobytes()
            sizes = np.fromiter((machine.count(b" " + body[i:j]) for i, j in zip(s[sample].tolist(), e[sample].tolist(), strict=True)), np.int64, len(sample))[code]
            sums = np.concatenate(([0], np.cumsum(sizes)))
            total = sums[first[1:]] - sums[first[:-1]]
            some = np.flatnonzero(first[1:] > first[:-1])
            most[some] = np.maximum.reduceat(sizes, first[some])
        for part, value in zip(parts, (np.diff(first), total, most), strict=True):
            part.append(value)
    return [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts]


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Append ``n_words``, ``n_tokens`` and ``max_word_tokens`` to every row."""
    path = vocabulary or default_vocabulary()
    return append(docs, text, FIELDS, lambda column: count_column(column, path), keep)
