"""The driver's contract: names match, and queries agree with their SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillspan.plans import registry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["id", "title", "created_at", "score"]


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = registry.QUERIES[name](spark, ROOT)
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert a == b
