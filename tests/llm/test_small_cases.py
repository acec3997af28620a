"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomstone.llm import decontam, fm_quality, html_blocks, packing, quality_rules, suffix_repeats, tgm_join, token_counts, tokens, training_order, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(spark, texts, **more):
    rows = [(i, t, *[v for v in more.values()]) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", *[f"{k} string" for k in more]])
    return spark.createDataFrame(rows, schema)


def corpus(seed=1, n=60):
    """Random texts with copies, near copies, shared passages and every odd kind of text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(90)
    out = [None, "", "   ", "one", "Two words", "\n\n", "x " * 3000, text(9000)]
    while len(out) < n:
        kind = rng.random()
        if kind < 0.3 and len(out) > 10:
            out.append(rng.choice(out[6:]))
        elif kind < 0.6 and len(out) > 10:
            w = (rng.choice(out[7:]) or "a").split(" ")
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
        elif kind < 0.8:
            out.append(text(rng.randint(1, 200)) + "\n" + passage + "\n" + text(rng.randint(0, 100)))
        else:
            out.append(text(rng.randint(1, 400)).title())
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def classes(texts, size, num, den=100):
    sets = [shingles(t, size) for t in texts]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and den * len(x & y) >= num * len(x | y):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sets, root


@pytest.mark.parametrize(("size", "num", "group"), [(3, 90, 64), (5, 80, 64), (2, 50, 2)])
def test_jaccard_components(spark, size, num, group):
    texts = corpus(size)
    sets, root = classes(texts, size, num)
    got = {r.doc_id: r for r in tgm_join.jaccard_components(make(spark, texts, n="x", cell="y"), size, num, 100, group).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == root


def test_crowd_of_near_copies_is_opened_in_bounded_groups(spark, monkeypatch):
    """Near copies of one text that share a min-hash: no group takes more than twice the group's size and its queries."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base, *(f"e{rng.randrange(10**9)}" for _ in range(k))]) for k in [3] * 120 + [17, 18] * 20]
    seen = spark.sparkContext.accumulator(0)
    look = tgm_join._open

    def watched(level, size):
        inner = look(level, size)

        def run(table):
            members = sum(not q for q in table["query"].to_pylist())
            if members > 8:
                seen.add(1)
            return inner(table)

        return run

    monkeypatch.setattr(tgm_join, "_open", watched)
    sets, root = classes(texts, 3, 80)
    got = {r.doc_id: r.component_id for r in tgm_join.jaccard_components(make(spark, texts), 3, 80, 100, 4).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert len(set(root)) < len(root) and seen.value == 0


def test_keep_one_and_empty_table(spark):
    texts = corpus(3)
    _, root = classes(texts, 5, 80)
    kept = tgm_join.keep_one(make(spark, texts, prefix="z"))
    assert kept.columns == ["doc_id", "text", "prefix"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))
    assert tgm_join.jaccard_components(make(spark, [])).count() == 0


def test_repeated_and_null_ids_lose_no_document(spark):
    """A repeated row leaves one row whole, other texts under its id stay, and rows without id stay."""
    rng = random.Random(9)
    text = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(80))
    clean, other, single, nameless, alone = (text() for _ in range(5))
    passage = text()
    rows = [(1, clean), (1, clean), (1, other), (2, single), (None, nameless), (None, nameless), (None, single), (None, alone + " " + passage), (3, "start " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = tgm_join.keep_one(docs)
    order = lambda found: sorted(found, key=repr)
    want = [(1, clean), (1, other), (2, single), (None, nameless), (None, alone + " " + passage), (3, "start " + passage)]
    assert order((r.doc_id, r.text) for r in kept.collect()) == order(want)
    left = suffix_repeats.remove(kept, 250, 64)
    assert order((r.doc_id, r.text.rstrip()) for r in left.collect()) == order([*want[:4], (None, alone), (3, "start")])


def covered(bodies, length):
    count = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        flag = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                flag[i : i + length] = b"\1" * length
        out.append(bytes(flag))
    return out


@pytest.mark.parametrize(("length", "gram", "group"), [(60, 20, 1024), (60, 20, 2), (25, 8, 3)])
def test_repeats(spark, length, gram, group):
    texts = corpus(length)
    bodies = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_repeats.digest(make(spark, texts, anchor="q", slot="s", row="r"), length, gram, group).collect()}
    for i, (b, flag) in enumerate(zip(bodies, covered(bodies, length), strict=True)):
        kept = bytes(c for c, f in zip(b, flag, strict=True) if not f)
        spans = len(re.findall(rb"\x01+", flag))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(flag), spans, hashlib.sha256(kept).hexdigest()), i
        assert got[i].text == kept.decode(errors="ignore")
    assert suffix_repeats.digest(make(spark, [])).count() == 0


def test_crowds_of_near_copies_are_split(spark):
    """Copies with scattered edits, and a passage between different words, each with more surroundings than a group takes."""
    rng = random.Random(8)
    base = [f"word{i}" for i in range(40)]
    texts = []
    for _ in range(40):
        w = list(base)
        w[rng.randrange(40)] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [f"{rng.random()} " + "shared passage of some length " * 2 + f" {rng.random()}" for _ in range(30)]
    bodies = [t.encode() for t in texts]
    got = {r.doc_id: r for r in suffix_repeats.digest(make(spark, texts), 60, 20, 4).collect()}
    for i, (b, flag) in enumerate(zip(bodies, covered(bodies, 60), strict=True)):
        assert got[i].kept_sha256 == hashlib.sha256(bytes(c for c, f in zip(b, flag, strict=True) if not f)).hexdigest(), i


def test_rows_of_one_id_keep_their_own_spans(spark):
    passage = " ".join(f"shared{i}" for i in range(80))
    rows = [(1, passage), (1, "short"), (None, passage), (None, None), (2, "tail " + passage)]
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(passage)
    assert got == [(0, 0), (5, 0), (n, n), (n, n), (n + 5, n)]


def test_remove_keeps_columns(spark):
    passage = " ".join(f"shared{i}" for i in range(80))
    texts = ["alpha1 " + passage + " beta", "gamma2 " + passage + " delta", "clean text", None]
    out = suffix_repeats.remove(make(spark, texts, spans="s", __slot="p"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == ["doc_id", "text", "spans", "__slot"]
    assert got[2] == "clean text" and got[3] is None and "shared40" not in got[0] and got[0].startswith("alpha") and got[1].endswith("delta")


def test_pipeline_removes_short_passages_of_fifty_one_words(spark):
    import corpus_pipeline

    rng = random.Random(11)
    word = lambda k: "".join(rng.choice("abcdefghij\u00e9") for _ in range(k))
    line = lambda n: " ".join(word(3) for _ in range(n))
    passage, fifty = line(51), line(50)
    assert len(passage.encode()) < corpus_pipeline.REPEAT_BYTES
    texts = [f"first{i} {word(9)} {passage} {word(8)} last{i}" for i in range(2)] + [f"one{i} {fifty} two{i}" for i in range(2)] + [None, "", line(300), f"{passage}", "q " * 70 + "end"]
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, make(spark, texts), "").collect()}
    for i in range(2):
        assert got[i].split() == texts[i].replace(passage, "").split()
        assert got[2 + i] == texts[2 + i]
    assert got[6] == texts[6] and 7 not in got and got[8].split() == ["end"]


def test_maximal_groups_against_all_pairs():
    """Every member reaches as far as any other member that shares enough with it, and every group is maximal with all its members."""
    rng = random.Random(2)
    for _ in range(300):
        some = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode()
        pairs = sorted({(some(), b"k" + some()) for _ in range(rng.randint(2, 12))})
        cut = rng.randint(0, len(pairs))
        edge = np.array(sorted({0, cut, len(pairs)}))
        body = pa.array([a + b for a, b in pairs], pa.binary())
        found = suffix_repeats.maximal_groups(body, np.array([len(a) for a, _ in pairs]), edge, 5)

        def agree(x, y):
            return next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905

        def common(i, j):
            return agree(pairs[i][0][::-1], pairs[j][0][::-1]), agree(pairs[i][1], pairs[j][1])

        want = set()
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for i in range(lo, hi):
                for j in range(lo, i):
                    x, y = common(i, j)
                    if x + y >= 5:
                        want.add((x, y, tuple(k for k in range(lo, hi) if all(p >= q for p, q in zip(common(i, k) if k != i else (99, 99), (x, y), strict=True)))))
        assert {(x, y, tuple(sorted(m.tolist()))) for x, y, m in found} == want


def test_repeat_groups_list_all_occurrences(spark):
    passage = " ".join(f"shared{i}" for i in range(80))
    docs = make(spark, [f"a {passage} b", f"c {passage} d", "none", f"e {passage} f"])
    rows = suffix_repeats.repeat_groups(docs).collect()
    assert rows and all(sorted(m.doc_id for m in r.members) == [0, 1, 3] for r in rows)


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark):
    texts = [*corpus(4), "#$ a|b <x> é\n\né é\n", " ".join(["a b c d e f g h"] * 3), "w " * 8, "w " * 9]
    got = {r.doc_id: r for r in quality_rules.quality_rules(make(spark, texts, n_words="clash")).collect()}
    for i, t in enumerate(texts):
        want = brute_quality(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    kept = quality_rules.keep(make(spark, texts, n_words="clash"))
    assert kept.columns == ["doc_id", "text", "n_words"]
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i].kept}
    assert quality_rules.quality_rules(make(spark, [])).count() == 0


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for item, t in items:
        w = word.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for t in texts:
        w = word.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    ids |= found
                    hit.update(range(i, i + n))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_decontamination(spark, block):
    texts = corpus(6)
    items = [("1", " ".join(texts[7].split()[50:75])), ("20", "short item"), ("3", None), ("4", ""), ("5", (texts[9] or "a b")[:300]), ("6", "..."), ("", "item short"), ("20", "Two words")]
    texts += ["A Short   ITEM, short item", "item", "prefix " + "".join(c.upper() if c.isascii() else c for c in items[0][1]) + " suffix"]
    bench = spark.createDataFrame([(i or None, t) for i, t in items], "item_id string, text string").coalesce(1)
    found = decontam.matches(make(spark, texts, items="clash"), bench, keep=["doc_id"], block_bytes=block)
    got = {r.doc_id: r for r in found.collect()}
    for i, want in enumerate(brute_hits(texts, items)):
        assert (got[i].n_words, got[i].n_hit, list(got[i].items)) == want, i
    sums = {r.doc_id: r.items_sha256 for r in decontam.digest(found).collect()}
    assert all(sums[i] == hashlib.sha256(",".join(sorted(map(str, got[i].items))).encode()).hexdigest() for i in got)
    assert got[len(texts) - 1].longest_match == 25
    clean = decontam.decontaminate(make(spark, texts, items="clash"), bench)
    assert clean.columns == ["doc_id", "text", "items"] and {r.doc_id for r in clean.collect()} == {i for i in got if not got[i].n_hit}
    assert decontam.decontaminate(make(spark, ["a"]), bench.limit(0)).count() == 1


def test_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*corpus(8), "hi <|endoftext|> yo", "<|endoftext|><|endoftext|>", "<|endoftext", "|> x<|endoftext|>", "it's 's  12\n\n 34abc!! ...", "é à é  à", "日本 語　 x", "a\u0085 b \u0085c  d", "<|endoftext|> hi", "tail  "]
    want = [e.ids for e in exact.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = dict(tokens.encode_column(pa.array(texts), tokens.default_vocabulary()))
    assert [got[i].tolist() for i in range(len(texts))] == want


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*corpus(9), "hi <|endoftext|> yo", "<|endoftext|>"]
    rows = packing.pack(make(spark, texts, length="clash"), capacity=256).collect()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(exact.encode(t or "", add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        whole = np.append(ids[doc], 0).astype("<u4")
        at = 0
        for k, r in enumerate(sorted(parts, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            assert r.length == 256 or k == 0
            at += r.length
        assert at == len(whole)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 256) * 1.05 + 1
    assert packing.pack(make(spark, [])).count() == 0


def test_sum_of_squares_prefers_the_smaller_sum():
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 4, 4]), 10)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 6, 6]


def test_automaton_counts_as_greedy_does():
    rng = random.Random(1)
    for _ in range(30):
        pieces = {b"a", b"b", b"c", b" "} | {bytes(rng.choice(b"abc ") for _ in range(rng.randint(2, 5))) for _ in range(8)}
        machine = token_counts.Automaton(sorted(pieces))
        for _ in range(200):
            word = bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 14)))
            n = at = 0
            while at < len(word):
                at = max(e for e in range(at + 1, len(word) + 1) if word[at:e] in pieces)
                n += 1
            assert machine.count(word) == n
    assert token_counts.Automaton([b"ab"]).count(b"abc") == -1


def test_token_counts(spark):
    texts = corpus(5)
    got = {r.doc_id: r for r in token_counts.token_counts(make(spark, texts, n_words="clash")).collect()}
    machine = token_counts.automaton(tokens.default_vocabulary())
    for i, t in enumerate(texts):
        sizes = [machine.count(b" " + w.encode()) for w in WORD.findall(t or "")]
        assert (got[i].n_words, got[i].n_tokens, got[i].max_word_tokens) == (len(sizes), sum(sizes), max(sizes, default=0))
    assert token_counts.token_counts(make(spark, [])).count() == 0


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(training_order.permute(np.arange(n), n, 9)) == list(range(n))
    assert training_order.permute(np.arange(100), 100, 1).tolist() != training_order.permute(np.arange(100), 100, 2).tolist()


def test_training_order_round_trip(spark, tmp_path):
    import public_tokenizers
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = corpus(7)
    docs = make(spark, texts, shard="clash").repartition(3)
    docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 12, F.col("doc_id"))).cache()
    parts = docs.select(F.spark_partition_id().alias("part"), "doc_id", "text").collect()
    rows = training_order.round_trip(spark, docs, f"file://{tmp_path}/order", capacity=128).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(len(rows)))
    # an order of its own: every partition's stream in pieces, by the permuted places of their indices
    weight = {}
    for r in parts:
        weight[r.part] = weight.get(r.part, 0) + len((r.text or "").encode()) + 1
    room, streams = max(weight.values()) // 128 + 1, {}
    for r in parts:
        owner = 12 if r.doc_id is None else r.doc_id
        whole = [*exact.encode(texts[owner] or "", add_special_tokens=False).ids, training_order.END_ID]
        streams.setdefault(r.part, []).extend((t, r.doc_id) for t in whole)
    size, want = (max(weight) + 1) * room, []
    for part, stream in streams.items():
        pieces = [stream[i : i + 128] for i in range(0, len(stream), 128)]
        slots = training_order.permute(np.arange(len(pieces)) + part * room, size, 1).tolist()
        for slot, piece in zip(slots, pieces, strict=True):
            owners = [d for k, (_, d) in enumerate(piece) if not k or piece[k - 1][1] != d]
            want.append((slot, zlib.crc32(np.array([t for t, _ in piece], "<u4").tobytes()), len(piece), owners))
    assert [(r.ids_crc32, r.n_tokens, list(r.doc_ids)) for r in rows] == [w[1:] for w in sorted(want, key=lambda w: w[0])]
    ids = dict(tokens.encode_column(pa.array(texts), tokens.default_vocabulary()))
    assert sum(r.n_tokens for r in rows) == sum(len(x) + 1 for x in ids.values())
    assert {d for r in rows for d in r.doc_ids} == {None if i == 12 else i for i in ids}
    disk, _ = training_order.filesystem(f"file://{tmp_path}")
    path = next(str(p) for p in (tmp_path / "order").glob("*.bin"))
    whole = list(training_order.read_shard(disk, path, 128))
    again = list(training_order.read_shard(disk, path, 128, start=len(whole) // 2))
    assert [k for k, *_ in again] == list(range(len(whole) // 2, len(whole))) and again[-1][2] == whole[-1][2]
    assert training_order.round_trip(spark, make(spark, []), f"file://{tmp_path}/none").count() == 0


def test_warc(spark, tmp_path):
    big, other = "<p>" + "payload " * 30, "é" * 50
    pages = [(5, "http://a/5", big), (3, "http://a/3", big), (9, None, big), (4, "u\nv", "small"), (6, "u", "small"), (1, "u", None), (2, "u", ""), (7, "u", other), (8, "u", other), (7, "u", other)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted(tuple(r) for r in warc.round_trip(spark, df, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "record_type", "refers_to", "payload_digest").collect())
    want = sorted(
        (i, len((h or "").encode()), "revisit" if i in (5, 9, 8) else "response", {5: 3, 9: 3, 8: 7}.get(i), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in pages
    )
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(spark, df.limit(0), f"file://{tmp_path}/v").count() == 0


def test_normaliser_reads_any_members(tmp_path):
    import gzip

    records = [warc.record(i, f"u{i}", b"x" * i, "d", None) for i in range(50)]
    data = gzip.compress(b"".join(records[:20])) + b"".join(gzip.compress(r) for r in records[20:])
    (tmp_path / "a.warc.gz").write_bytes(data)
    disk, root = warc.filesystem(f"file://{tmp_path}")
    rows = list(warc.normalise_file(disk, f"{root}/a.warc.gz"))
    assert len(rows) == 50
    with disk.open_input_file(rows[0][0]) as source:
        for i in (49, 0, 25):
            fields, payload = warc.read_record(source, rows[i][1], rows[i][2])
            assert fields["warc-page-id"] == str(i) and payload == b"x" * i
    assert len((tmp_path / "a.records.warc.gz.idx").read_text().splitlines()) == 50


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy this now and save a lot of money today.</div><article><h1>A  title</h1><p>First &amp; second
line.<br><p><b>Bold</b> word &lt;tag&gt; <script>var a = "</p>";</script>end.</p><aside><p>Related reading here.</p></aside><form><label>Mail</label></form>
<section class="user-comments"><p>I liked this very much.</p></section><ul><li>one</li><li>two</li></ul></article><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    want = "A title\nFirst & second line.\nBold word <tag> end.\none\ntwo"
    assert html_blocks.main_text(PAGE) == want
    assert html_blocks.main_text(None) == html_blocks.main_text("") == html_blocks.main_text("<nav>x</nav>") == ""
    assert html_blocks.main_text("<article><p>cut off <b>in the mid") == "cut off in the mid"
    body = "<div id=content><p>" + "plain words of a page " * 20 + "</p><p>" + "and more of them " * 20 + "</p></div><div class=menu><a href=x>one</a> <a href=y>two</a></div>"
    assert html_blocks.main_text(body).count("\n") == 1
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, "v", None, "c")], "page_id long, url string, html string, n_chars string")
    got = html_blocks.extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, want, len(want))] * 2 + [(2, "", 0)]


def test_an_article_survives_its_wrapper():
    body = "<h1>Title of the story</h1><p>" + "plain words of a page " * 12 + "</p><p>" + "more of these words " * 9 + "</p>"
    for name in ("post-header", "sidebar-layout-main", "related-work", "social-science", "story notice-board"):
        page = f'<ul><li><a>Home</a></li><li><a>News</a></li></ul><div class="{name}"><article>{body}</article></div><div class=related>see</div>'
        assert html_blocks.main_text(page).startswith("Title of the story\nplain") and html_blocks.main_text(page).count("\n") == 2


def test_menus_without_a_name_are_told_by_their_links():
    links = "".join(f"<li><a href=/{i}>Page {i}</a></li>" for i in range(6))
    text = "<p>" + "plain words of a page " * 12 + "</p>"
    assert html_blocks.main_text(f"<ul>{links}</ul>{text}{text}<div>{links}</div>").count("\n") == 1
    # in an article a list of links is text, unless its heading announces further reading
    assert html_blocks.main_text(f"<article>{text}<ul>{links}</ul>{text}</article>").count("\n") == 7
    assert html_blocks.main_text(f"<article>{text}<h2>Related stories</h2><ul>{links}</ul></article><p>{links}</p>").count("\n") == 0
    assert html_blocks.main_text(f"<article>{text * 2000}</article>").count("\n") == 1999


def test_decisions_need_counts_and_densities():
    x, y = html_blocks.sample_blocks()
    tree = html_blocks.trained()
    assert all(tree.decide(r) == bool(k) for r, k in zip(x, y, strict=True))
    flags = x * (np.arange(x.shape[1]) >= html_blocks.DENSITIES)
    outside = int((x[:, html_blocks.FEATURES.index("article")] == 0).sum())
    blind = html_blocks.grow(flags, y)
    assert sum(blind.decide(f) != bool(k) for f, k in zip(flags, y, strict=True)) > outside // 3


def test_pairwise_identity():
    rng = np.random.default_rng(0)
    model = fm_quality.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 4)).astype(np.float32))
    feature, value = np.array([1, 5, 7, 2, 3]), np.array([0.5, 1, 2, 1, 3], np.float32)
    row = np.array([0, 0, 0, 1, 1])
    z, _ = model.raw(row, feature, value, 2)
    for r in (0, 1):
        f, x = feature[row == r], value[row == r]
        want = model.bias + (model.weight[f] * x).sum() + sum(model.factor[f[i]] @ model.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert abs(want - z[r]) < 1e-4


def test_quality_learns_from_its_own_folds(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "sun", "rises", "over", "calm", "hills"]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$", "##", "buy", "NOW", "||", "win"]) for _ in range(60)) for _ in range(60)]
    texts = [*good, *bad, None, ""]
    docs = make(spark, texts, score="clash")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    machine = fm_quality.train(docs, labels)
    got = {r.doc_id: r for r in fm_quality.score(docs, machine).collect()}
    held = [i for i in range(210) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].predicted == int(i < 150) for i in held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[210].score == got[211].score
    flat = fm_quality.train(docs, labels.limit(0))
    assert {r.score for r in fm_quality.score(docs, flat).collect()} == {0.5}
