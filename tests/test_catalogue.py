"""Every query against its SQL on the same tables."""

import datetime
import os

import duckdb
import pytest

from factloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = [r.asDict() for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in found.fetchall()]
    key = sorted(columns)
    assert sorted(repr([plain(r[k]) for k in key]) for r in rows) == sorted(repr([plain(r[k]) for k in key]) for r in want)
