"""Every query with an oracle against DuckDB at the smallest scale."""

import math

import duckdb
import pytest
from statuta.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}"


def unique(names):
    """Each query once, though it may serve several inventory rows."""
    seen, out = set(), []
    for n in names:
        f = registry.queries()[n]
        if f not in seen:
            seen.add(f)
            out.append(n)
    return out


@pytest.mark.parametrize("name", unique(registry.oracles()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracles()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
