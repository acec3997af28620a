"""Steps that must not grow faster than their input: what they give when cut small is what they give whole."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from loomstone.functions import text, vectors
from loomstone.operators import overlap, retrieval, search
from loomstone.plans import records


@pytest.mark.parametrize("contained", [True, False])
def test_similar_sets_in_small_tiles(spark, monkeypatch, contained):
    """Blocks of 40 words against every pair; a null in ``by`` keeps its row and links with nothing."""
    monkeypatch.setattr(overlap, "BLOCK_WORDS", 40)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        words = set(rng.sample(rows[-1][2].split() if rows and rows[-1][2] and i % 2 else [f"w{j}" for j in range(40)], 1)) | {f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 12))}
        if rows and rows[-1][2] and i % 3:
            words = (set(rows[-1][2].split()) | {f"w{rng.randrange(40)}"}) - {f"w{rng.randrange(40)}"}
        rows.append((i, rng.choice(["a", "a", None]), " ".join(sorted(words))))
    rows += [(200, "a", None), (201, "a", ""), (202, "b", rows[0][2])]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in retrieval.similar_sets(df, "doc_id", ["lang"], "text", 0.7, contained).collect()}
    sets = {i: (lang, frozenset((text or "").split())) for i, lang, text in rows}
    classes = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    firsts = [i for i in sets if classes[i] == i and sets[i][1] and sets[i][0]]

    def like(i, j):
        (la, a), (lb, b) = sets[i], sets[j]
        return i != j and la == lb and len(a & b) >= 0.7 * (min(len(a), len(b)) if contained else len(a | b)) - 1e-9

    links = {i: sum(like(i, j) for j in firsts) for i in firsts}
    assert got == {i: (classes[i], links.get(classes[i], 0)) for i in sets} and sum(links.values()) > 60


def test_nearest_rows_in_steps(monkeypatch):
    """Four queries meet seven rows at once; ties go to the smaller id, wherever it stands."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-2, 3, (300, 3)).astype(np.float32)
    rows[(rows == 0).all(axis=1)] = 1
    names = rng.permutation(300)
    monkeypatch.setattr(vectors, "STEP_QUERIES", 4)
    monkeypatch.setattr(vectors, "STEP_ROWS", 7)
    lists = pa.array(rows.tolist(), pa.list_(pa.float32()))
    parts = [(pa.array(names[a : a + 50]), lists[a : a + 50]) for a in range(0, 300, 50)]
    wanted = vectors._directions(lists)
    got = vectors._nearest(names, wanted, iter(parts), 5, 0.2).to_pylist()
    near = np.round(wanted @ wanted.T, 6)
    want = [(q, v, s) for i, q in enumerate(names) for s, v in sorted(((-s, v) for s, v in zip(near[i], names)))[:5] if -s >= 0.2]
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, v) for q, v, _ in want]


def test_estimate_normalises_once(spark):
    """Units against the pattern that defines them, and one normalisation in the plan of an estimate."""
    said = ["", " ", "a b_c, d!", "Größe: 3 m²…", "x y　z q", "\x0b\x1c\x85.", "日本語 テスト。", "é ١٢ 𝒳y", "_-_", "ﬁ ½", None]
    df = spark.createDataFrame([(s,) for s in said], "text string")
    rows = df.select(text.units(F.col("text")).alias("a"), F.regexp_count("text", F.lit(text.UNIT)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    plan = df.select(text.token_estimate(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    once = df.select(text.nfkc(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Normalizer") == once.count("Normalizer") > 0


def test_texts_below_the_floor_are_not_paired(spark):
    """Of 200 texts with both words, only those with many of one of them meet the question; the best three stay the same."""
    rng = random.Random(8)
    said = [(i, " ".join(["xa"] * rng.randint(1, 4) + ["xb"] * rng.randint(1, 4))) for i in range(200)] + [(300, "xa " * 30), (301, "xb " * 40 + "xa"), (302, "xa xb " * 18), (303, "xb " * 36)]
    texts = spark.createDataFrame(said, "doc_id long, text string")
    terms = search.asked_terms(spark.createDataFrame([(1, "xa xb")], "query_id long, question string"), "question", 12)
    paired = search.held_any(search.postings(texts, terms), terms, 3)
    assert 3 <= paired.count() < 10
    got = search.lexical(spark.createDataFrame([(1, "xa xb")], "query_id long, question string"), texts, k=3).orderBy("lexical_rank").collect()
    assert [r.doc_id for r in got] == [301, 302, 303]


@pytest.mark.parametrize("contained", [True, False])
@pytest.mark.parametrize("piece", [3, 10_000])
def test_a_tile_in_pieces(monkeypatch, contained, piece):
    """Entries gathered three at a time, in tiles of one block and of two, against every pair."""
    monkeypatch.setattr(overlap, "PIECE", piece)
    rng = random.Random(piece)
    for blocks in (1, 2):
        sets = [sorted(rng.sample([f"w{j}" for j in range(14)], rng.randint(1, 9))) for _ in range(90)]
        ids, block = np.array(rng.sample(range(500), 90)), np.array([rng.randrange(blocks) for _ in range(90)])
        got = overlap.tile_links(ids, block, pa.array(sets, pa.list_(pa.string())), 0.6, contained)
        both = [[len(set(a) & set(b)) for b in sets] for a in sets]
        whole = lambda i, j: min(len(sets[i]), len(sets[j])) if contained else len(sets[i]) + len(sets[j]) - both[i][j]
        want = [sum(i != j and (blocks == 1 or block[i] != block[j]) and both[i][j] >= 0.6 * whole(i, j) - 1e-9 for j in range(90)) for i in range(90)]
        assert list(got) == want and sum(want) > 40


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    """Lines and orders meet in as many partitions as their number asks for, and give the rows of the statement."""
    monkeypatch.setattr(records, "SPREAD", 1000)
    sf_dir = "/root/testdata/sf0.001"
    got = records.area.queries["historical_sources"](spark, sf_dir)
    parts = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 1000)
    told = got._jdf.queryExecution().executedPlan().toString()
    assert parts > 4 and re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {parts}\)", told) and re.search(rf"hashpartitioning\(o_orderkey#\d+L?, {parts}\)", told)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(records.area.oracles["historical_sources"]).fetchall())
