"""Every query against its SQL twin on the smallest tables."""

import math
import os

import pytest
from prospectra.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert table(got, df.columns) == table(result.fetchall(), names)
