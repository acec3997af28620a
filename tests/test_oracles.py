"""Every registered query with an oracle gives the oracle's rows."""

import math
from pathlib import Path

import duckdb
import pytest

from loomstone.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, str(DATA))
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_rows_only(spark, name):
    """These have brute force in test_rules.py; here they run over the whole tables and give rows that are all distinct."""
    got = catalogue.queries()[name](spark, str(DATA)).toPandas()
    assert len(got) > 0 and not got.astype(str).duplicated().any()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
