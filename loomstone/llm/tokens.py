"""Byte-level BPE ids of whole texts, at the cost of their distinct words.

A match of the vocabulary's split pattern never runs from a character that is
not white space into white space, so a text may be cut before every run of
white space and each cut piece encoded alone.  A slice therefore encodes every
distinct piece once and copies its ids to wherever the piece occurs.  Pieces
are told apart by a 64-bit hash of their bytes within one slice.  An added token
of the vocabulary, written out in a text, is one id, and the text ends and
begins anew around it.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa

from loomstone.llm.words import byte_class, prefix_hash, ragged, slices, span_hash

_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes that may end a character which surely isn't white space: ASCII, or the tail of a two-byte character other than those led by C2.
_ASCII_WORD = byte_class((0x00, 0x08), (0x0E, 0x1F), (0x21, 0x7F))
_LEAD2 = byte_class((0xC3, 0xDF))


def default_vocabulary() -> str:
    """The rank file of the 50k byte-level vocabulary that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoder(path: str):
    """The encoder of a rank file, the bytes of each id, and the added tokens that the vocabulary's JSON file names."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        size[i] = len(piece)
    enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = os.path.splitext(path)[0] + ".json"
    added = {}
    if os.path.exists(whole):
        with open(whole, encoding="utf-8") as source:
            added = {t["content"].encode(): t["id"] for t in json.load(source)["added_tokens"]}
    find = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
    return enc, size, added, find


def encode_slice(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a slice's rows (uint32, end to end) and each row's offset among them."""
    enc, size, added, find = _encoder(path)
    rows = len(offsets) - 1
    out = np.zeros(rows + 1, np.int64)
    if not len(data):
        return np.zeros(0, np.uint32), out
    cut = np.zeros(len(data), bool)
    space = _SPACE[data]
    cut[1:] = space[1:] & _ASCII_WORD[data[:-1]]
    cut[2:] |= space[2:] & (data[1:-1] >= 0x80) & _LEAD2[data[:-2]]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    cut[edge] = True
    buf = data.tobytes()
    # places of added tokens, none of which may run over a row's edge
    found = [(m.start(), m.end()) for m in find.finditer(buf)] if find else []
    found = [(i, j) for i, j in found if np.searchsorted(edge, i, "right") == np.searchsorted(edge, j - 1, "right")]
    for i, j in found:
        cut[i:j] = False
        cut[i] = True
        if j < len(cut):
            cut[j] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    # a piece at the edge of a row or of an added token may lack white space at the start or have it at the end
    first = np.searchsorted(starts, np.unique(np.concatenate([edge, *([i, j] for i, j in found if j < len(data))]).astype(np.int64)))
    last = np.append(first[1:], len(starts)) - 1
    odd = np.zeros(len(starts), bool)
    odd[first] = odd[last] = True
    key = span_hash(prefix_hash(data), starts, ends)
    code, _ = pd.factorize(key)
    # a piece at a row's edge is encoded alone, and kept apart from equal pieces elsewhere
    alone = np.flatnonzero(odd)
    code[alone] = code.max() + 1 + np.arange(len(alone))
    n_codes = int(code.max()) + 1
    where = np.full(n_codes, -1, np.int64)
    where[code[::-1]] = np.arange(len(code))[::-1]
    used = np.flatnonzero(where >= 0)
    plain = used[~odd[where[used]]]
    w = where[plain]
    joined = data[ragged(starts[w], ends[w] - starts[w])].tobytes().decode()
    ids = np.asarray(enc.encode_to_numpy(joined, disallowed_special=()), np.uint32) if joined else np.zeros(0, np.uint32)
    at = np.concatenate(([0], np.cumsum(size[ids])))
    bound = np.searchsorted(at, np.concatenate(([0], np.cumsum(ends[w] - starts[w]))))
    bodies = [buf[starts[i] : ends[i]] for i in where[used[odd[where[used]]]]]
    singles = [np.array([added[x]] if x in added else enc.encode_ordinary(x.decode()), np.uint32) for x in bodies]
    begin, length = np.zeros(n_codes, np.int64), np.zeros(n_codes, np.int64)
    begin[plain], length[plain] = bound[:-1], np.diff(bound)
    lone = used[odd[where[used]]]
    length[lone] = [len(x) for x in singles]
    begin[lone] = len(ids) + np.concatenate(([0], np.cumsum(length[lone])[:-1]))
    pool = np.concatenate([ids, *singles])
    lengths = length[code]
    flat = pool[ragged(begin[code], lengths)]
    total = np.concatenate(([0], np.cumsum(lengths)))
    out[1:] = total[np.searchsorted(starts, offsets[1:])]
    return flat, out


def encode_column(column: pa.Array, path: str):
    """Yield (row, ids) for every row of a string column; null counts as empty."""
    for a, b, data, offsets in slices(column, 4 << 20):
        ids, at = encode_slice(data, offsets, path)
        for i in range(b - a):
            yield a + i, ids[at[i] : at[i + 1]]
