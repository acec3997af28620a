"""Cover density and question sets against a plain sweep; searches in tiles against those beside the base; levels and deltas."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.functions import vectors
from loomstone.operators import reduction, search, whole
from loomstone.streaming import counters


def minimal_covers(words, terms):
    """Every stretch that holds all terms and no shorter one inside it."""
    found = []
    for a in range(len(words)):
        need = set(terms)
        for b in range(a, len(words)):
            need.discard(words[b])
            if not need:
                found.append((a, b))
                break
    return [(a, b) for a, b in found if not any((c, d) != (a, b) and a <= c and d <= b for c, d in found)]


def ranked(questions, texts, every):
    out = []
    for q, question in questions:
        terms = list(dict.fromkeys(re.findall(r"\w+", (question or "").lower())))
        scores = []
        for d, text in texts:
            words = re.findall(r"\w+", (text or "").lower())
            if not terms:
                continue
            if every:
                # a cover weighs less for each word in it that nobody asked for
                r = sum(0.1 / (1 + sum(w not in terms for w in words[a : b + 1])) for a, b in minimal_covers(words, terms))
            else:
                r = 0.1 * sum(w in terms for w in words)
            if r:
                scores.append((-round(r / (r + 1), 9), d))
        out += [(q, d, -s, n + 1) for n, (s, d) in enumerate(sorted(scores)[:20])]
    return sorted(out)


@pytest.mark.parametrize("every", [True, False])
def test_ranks_of_a_question_set(spark, every):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(14)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "W1 w2, w1-W2 w3")]
    questions = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 4)))) for i in range(12)] + [(50, None), (51, "w1 W1 w1"), (52, "absent w1"), (53, "?")]
    q = spark.createDataFrame(questions, "query_id long, question string")
    t = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(tuple(r) for r in search.lexical(q, t, every=every).select("query_id", "doc_id", "lexical_score", "lexical_rank").collect())
    want = ranked(questions, texts, every)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want] and len(want) > 60
    assert all(abs(x[2] - y[2]) < 2e-9 for x, y in zip(got, want, strict=True))


def test_tiles_find_what_a_broadcast_finds(spark, monkeypatch):
    base = spark.range(700).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("embedding"))
    queries = base.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, vectors.top_k(queries, base, 5).collect()))
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "TILE_ROWS", 100)
    assert sorted(map(tuple, vectors.top_k(queries, base, 5).collect())) == whole and len(whole) == 350


def test_levels_keep_the_order(spark):
    """An order-sensitive combiner against a fold, for jobs of one to 600 parts."""
    sizes = {1: 1, 2: 2, 8: 8, 9: 9, 64: 64, 65: 65, 73: 73, 600: 600, None: 17}
    rows = [(job, i, f"{i}") for job, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    parts = spark.createDataFrame(rows, "job int, i int, said string")
    got = reduction.reduce_levels(parts, ["job"], "i", "said", lambda v: F.concat(F.lit("("), F.array_join(v, " "), F.lit(")")))
    want = {}
    for job, n in sizes.items():
        level = [f"{i}" for i in range(n)]
        while len(level) > 1:
            groups = [level[a : a + 8] for a in range(0, len(level), 8)]
            level = [g[0] if len(g) == 1 else f"({' '.join(g)})" for g in groups]
        want[job] = (level[0], n)
    assert {r.job: (r.said, r.parts) for r in got.collect()} == want
    assert reduction.reduce_levels(parts.where("false"), ["job"], "i", "said", lambda v: F.get(v, F.lit(0))).count() == 0


def test_deltas_count_once(spark, tmp_path):
    """Totals after writes, changes and removals are those of a count, also when a batch is played again."""
    rng = random.Random(2)
    live, log = {}, []
    for _ in range(300):
        key, owner = rng.randrange(25), None
        owner = f"u{key % 4}"
        new = rng.choice([None, rng.randrange(100)])
        log.append((owner, live.get(key), new))
        live[key] = new
    for key in [k for k in live if k % 4 == 3]:
        log.append((f"u{key % 4}", live[key], None))
        live[key] = None
    keep = counters.keeper(f"file://{tmp_path}/t", {"owner": "owner", "all": None}, "before", "after")
    batches = [log[a : a + 70] for a in range(0, len(log), 70)]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "owner string, before int, after int")
        keep(frame, n)
        if n % 2:
            keep(frame, n)
    got = {(r.scope, r.scope_id): (r.rows_held, r.bytes_held) for r in spark.read.parquet(f"file://{tmp_path}/t/totals-{len(batches) - 1}").collect()}
    held = {k: v for k, v in live.items() if v is not None}
    want = {("owner", f"u{o}"): (sum(k % 4 == o for k in held), sum(v for k, v in held.items() if k % 4 == o)) for o in range(3)} | {("all", ""): (len(held), sum(held.values()))}
    assert got == {k: v for k, v in want.items() if k[0] == "all" or v != (0, 0)}


def test_texts_of_a_question_are_not_shuffled(spark, monkeypatch):
    """Whole questions in passes of five beside the texts: copies and ties, ids that two texts share, and only the best leave a task."""
    monkeypatch.setattr(whole, "BLOCK", 5)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(9)]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    texts += [(1000 + i, t) for i, t in texts[:80]] + [(2000, None), (2001, "")]
    asked = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 4)))) for i in range(14)] + [(50, None), (51, "absent w1")]
    q, t = spark.createDataFrame(asked, "query_id long, question string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = lambda t: sorted((r.query_id, r.doc_id, r.lexical_rank) for r in search.lexical(q, t, every=True).collect())
    assert found(t) == [(a, b, d) for a, b, _, d in ranked(asked, texts, True)]
    terms = search.asked_terms(q, "question", 12)
    left = whole.held_whole(t, terms, 2, search.WEIGHT)
    assert "Exchange" not in left._jdf.queryExecution().optimizedPlan().toString() and left.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 2 * 3
    # a null id and a shared one are one text each, by the places of both
    odd = spark.createDataFrame([(1, "w1 x"), (1, "x x w2"), (None, "w1 w2"), (2, "w1 w2")], "doc_id long, text string")
    got = search.lexical(spark.createDataFrame([(7, "w1 w2")], "query_id long, question string"), odd, every=True)
    assert {(r.doc_id, r.lexical_score) for r in got.collect()} == {(2, 0.090909091), (None, 0.090909091), (1, 0.047619048)}


def test_best_are_the_same_in_any_steps():
    """Floors from earlier steps leave out no text that belongs to the best, ties by id."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(6)]
    texts = [(i, [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]) for i in rng.sample(range(500), 200)]
    asked = [(i, rng.sample(vocabulary, rng.randint(1, 3))) for i in range(9)]
    rows = [(i, w, n, len(ws)) for i, ws in asked for n, w in enumerate(ws)]
    table = whole.Asked(pa.table(dict(zip(("query_id", "term", "number", "n_terms"), map(list, zip(*rows))))))
    want = {(q, d) for q, d, _, n in ranked([(q, " ".join(w)) for q, w in asked], [(d, " ".join(w)) for d, w in texts], True) if n <= 5}
    for step in (1, 7, 200):
        best = whole.Best(len(table.ids), 5)
        for a in range(0, len(texts), step):
            part = texts[a : a + step]
            whole._meet(table, best, np.array([d for d, _ in part]), pa.array([w for _, w in part], pa.list_(pa.string())), 0.1)
        best.settle() if best.fresh else None
        assert {(table.ids[int(q)].as_py(), int(d)) for q, d in zip(*best.held[:2])} == want
