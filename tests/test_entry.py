"""Every registered query of the edge operators against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.oracle_sql() if n in entry.QUERIES)


def value(v):
    if v is None or isinstance(v, bool | str):
        return v
    if isinstance(v, list | tuple) or hasattr(v, "tolist"):
        return tuple(value(x) for x in list(v))
    v = float(v)
    return None if math.isnan(v) else float(f"{v:.8g}")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", OWN)
def test_query_agrees_with_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted(repr(tuple(value(r[names.index(c)]) for c in cols)) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
