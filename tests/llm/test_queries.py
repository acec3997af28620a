"""The registered queries over a whole small scale, against SQL where SQL can say it, and the pipeline against brute force."""

import re

import duckdb
import pytest

from loomstone.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    pick = lambda names, rows: sorted((tuple(r[names.index(c)] for c in columns) for r in rows), key=repr)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from test_small_cases import brute_hits, classes, covered

    from loomstone.llm import quality_rules

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "jaccard_join", "suffix_dedup", "decontamination", "packing"]

    one = stages["quality_rules"](spark, docs, SF).cache()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.oracle()}) WHERE kept").fetchall()}
    assert one.columns == names and {r.doc_id for r in one.collect()} == want

    rows = sorted((r.doc_id, r.text) for r in one.collect())
    _, root = classes([t for _, t in rows], 5, 80)
    two = stages["jaccard_join"](spark, one, SF).cache()
    assert two.columns == names and {r.doc_id for r in two.collect()} == {rows[i][0] for i in set(root)}

    rows = sorted((r.doc_id, r.text) for r in two.collect())
    bodies = [t.encode() for _, t in rows]
    left = {d: bytes(c for c, f in zip(b, flag, strict=True) if not f).decode(errors="ignore") for (d, _), b, flag in zip(rows, bodies, covered(bodies, corpus_pipeline.REPEAT_BYTES), strict=True)}
    three = stages["suffix_dedup"](spark, two, SF).cache()
    assert three.columns == names and {r.doc_id: r.text for r in three.collect()} == {d: t for d, t in left.items() if re.search(r"[^ \t-\r]", t)}
    assert all(r.n_chars == len(r.text) for r in three.collect())

    rows = sorted((r.doc_id, r.text) for r in three.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d for (d, _), (_, hit, _) in zip(rows, brute_hits([t for _, t in rows], items), strict=True) if not hit}
    four = stages["decontamination"](spark, three, SF).cache()
    assert four.columns == names and {r.doc_id for r in four.collect()} == clean

    five = stages["packing"](spark, four, SF)
    assert {r.doc_id for r in five.collect()} == clean
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, five.select("doc_id", "piece", "ids_crc32").collect()))
