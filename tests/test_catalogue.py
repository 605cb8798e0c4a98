"""Every catalogue query against its SQL twin."""

import math
import os

import duckdb
import pytest

from fieldproof.plans import catalogue

SF = os.environ.get("CATALOGUE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    con.execute("set timezone = 'UTC'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
    key = lambda r: [(v is None, f"{v:.6g}" if isinstance(v, float) else str(v)) for v in r]
    return sorted(([plain(r[i]) for i in order] for r in values), key=key)


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    expected = rows(names, found.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(expected) and len(got) > 0
    bad = [(g, e) for g, e in zip(got, expected) if not all(map(same, g, e)) or [type(x) for x in g] != [type(x) for x in e]]
    assert not bad, bad[:3]
