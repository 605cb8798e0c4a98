"""The corpus queries against the SQL that says the same."""

import math

import duckdb
import pytest

from fieldproof.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    key = lambda r: tuple(map(str, r[:1])) + tuple(map(str, r))
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    found = con.execute(queries.ORACLE_SQL[name])
    assert sorted(d[0] for d in found.description) == names
    place = [[d[0] for d in found.description].index(c) for c in names]
    expected = sorted((tuple(r[i] for i in place) for r in found.fetchall()), key=key)
    same = lambda a, b: math.isclose(a, b, abs_tol=1e-3) if isinstance(a, float) and isinstance(b, float) else a == b
    bad = [(g, e) for g, e in zip(got, expected) if not all(map(same, g, e))]
    assert len(got) == len(expected) > 0 and not bad, bad[:3]
