"""Every query against its SQL twin on the smallest tables."""

import math
import os

import duckdb
import pytest

import corpusloom.plans  # noqa: F401
from corpusloom.plans import base

SF = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_twin(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in base.SQL:
        assert got
        return
    out = duck.sql(base.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == sorted([plain(dict(zip(names, r))[c]) for c in columns] for r in out.fetchall())
