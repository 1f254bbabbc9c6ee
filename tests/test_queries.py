"""Every registered query of the reference's own operators against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tarnweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    assert mine == Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
