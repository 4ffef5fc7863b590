"""Every query outside the llm subpackage that has SQL, against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tarn.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    got = rows(df.collect(), df.columns)
    c = con.execute(registry.ORACLES[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(c.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
