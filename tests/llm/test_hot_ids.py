"""Ids that many rows share or lack, blocks that are read once for many documents, and the pipeline over odd tables."""

import random

import pyarrow as pa
from test_small_cases import classes

from loomstone.llm import columns, decontam, packing, tgm_join


def test_packing_splits_one_id(spark):
    """100,000 rows of one id, and as many without id, lie in several groups of about one size."""
    rows = spark.range(200_000).selectExpr("if(id % 2 = 0, 7L, null) AS doc_id", "CAST(null AS string) AS text")
    packed = packing.pack(rows)
    groups = [r["count"] for r in packed.groupBy(packed.sequence_id.bitwiseAND(-(1 << 32)).alias("g")).count().collect()]
    assert len(groups) == -(-200_000 // packing.GROUP_DOCS) and max(groups) < 1.1 * min(groups) and sum(groups) == 200_000
    assert packed.groupBy("sequence_id").count().count() <= 200_000 // 2048 + len(groups)


def test_packing_loses_no_row_of_one_id(spark):
    texts = [None, "", "a", "a", "long words " * 3000, "long words " * 3000]
    rows = spark.createDataFrame([(None, t, "x") for t in texts] + [(1, t, "x") for t in texts], "doc_id long, text string, piece string")
    packed = packing.pack(rows).collect()
    assert packed_length(packed, None) == packed_length(packed, 1) and sum(r.piece == 0 for r in packed) == len(texts) * 2
    for s in {r.sequence_id for r in packed}:
        held = sorted((r.offset, r.length) for r in packed if r.sequence_id == s)
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048


def packed_length(packed, doc_id):
    return sum(r.length for r in packed if r.doc_id == doc_id)


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100] * 10)], ["t"]) for _ in range(50)]
    held = list(columns.gathered(iter(batches), 8000))
    assert sum(b.num_rows for b in held) == 500 and all(b.nbytes >= 8000 for b in held[:-1]) and len(held) < 10
    assert len(list(columns.gathered(iter(batches), 0))) == 50 and list(columns.gathered(iter([]), 9)) == []


def test_a_block_is_read_once_for_a_gathered_batch(spark, monkeypatch):
    bench = spark.createDataFrame([(str(i), f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(12)], "item_id string, text string").coalesce(1)
    paths = decontam.blocks(bench, 10, 60)
    assert len(paths) > 2
    reads = []
    load = decontam._load.__wrapped__
    monkeypatch.setattr(decontam, "_load", lambda path: reads.append(path) or load(path))
    texts = pa.chunked_array([pa.array([f"so alpha{i % 12} beta{i % 12} gamma{i % 12} delta{i % 12} " + "and more words here " * 5000]) for i in range(60)])
    found = decontam.annotate(texts, paths)
    assert reads == paths and [x.as_py() for x in found[4]] == [[str(i % 12)] for i in range(60)]


def test_near_copies_without_id_are_linked(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(6)]
    rows = [(5, base[0]), (None, base[0] + " x"), (9, "y " + base[0]), (None, base[1]), (None, base[1]), (3, base[2]), (3, base[3]), (2, base[3] + " z"), (None, None), (4, "")]
    docs = spark.createDataFrame([(d, t, "q") for d, t in rows], "doc_id long, text string, row string")
    got = sorted((tuple(r) for r in tgm_join.jaccard_components(docs, 3, 90, 100).collect()), key=repr)
    sets, root = classes([t for _, t in rows], 3, 90)
    low = {k: min((d for (d, _), r in zip(rows, root, strict=True) if r == k and d is not None), default=None) for k in set(root)}
    assert got == sorted(((d, len(s), low[k]) for (d, _), s, k in zip(rows, sets, root, strict=True)), key=repr)
    assert {r[2] for r in got if r[0] == 5} == {5} and (None, 199, 5) in got


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Every stage takes nulls, empty and long texts, repeated rows and clashing columns; an empty table stays empty."""
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("lan", "mer", "sol", "tri", "vex", "dor") for b in ("a", "eno", "ith", "um", "ork", "ial", "e", "os")]
    prose = lambda n: " ".join(" ".join(rng.choice(vocabulary) for _ in range(12)).capitalize() + " of the and with." for _ in range(n))
    one, two, long = prose(20), prose(25), prose(4000)
    rows = [(1, one), (1, one), (None, two), (None, two), (None, None), (2, ""), (3, " \n "), (4, long), (4, prose(30)), (5, "short")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece string, row int, n_words string"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "p", 1, "w") for d, t in rows], schema)
    stage = docs
    bench = str(tmp_path)
    spark.createDataFrame([("b", "nothing of this stands in any text here at all")], "item_id string, text string").write.parquet(f"{bench}/benchmark.parquet")
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, stage, bench).write.parquet(f"{bench}/{name}")
        stage = spark.read.parquet(f"{bench}/{name}")
        if k < 4:
            assert stage.columns == docs.columns, name
            assert sorted({r.doc_id for r in stage.collect()}, key=repr) == [1, 4, None], name
        if k == 1:
            assert sorted(((r.doc_id, r.text) for r in stage.collect()), key=repr) == sorted([(1, one), (None, two), (4, long), (4, rows[8][1])], key=repr)
    assert {r.doc_id for r in stage.collect()} == {1, 4, None}
    nothing = docs.where("false")
    for name, apply in corpus_pipeline.STAGES:
        nothing = apply(spark, nothing, bench)
        assert nothing.count() == 0, name
