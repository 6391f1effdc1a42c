"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math

import duckdb
import pytest

from verbaloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(([plain(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    rel = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(([plain(r[names.index(c)]) for c in sorted(names)] for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = df.count()
    assert df.columns and rows > 0
