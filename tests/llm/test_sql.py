"""The queries that SQL can express against their SQL on the small tables."""

import math
from pathlib import Path

import pytest

from edgeloom.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.01")


def value(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v if isinstance(v, bool | str) else float(f"{float(v):.10g}")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    theirs = con.execute(ORACLES[name])
    names = [d[0] for d in theirs.description]
    assert sorted(names) == cols
    ours = sorted(repr(tuple(value(r[c]) for c in cols)) for r in df.collect())
    assert ours == sorted(repr(tuple(value(r[names.index(c)]) for c in cols)) for r in theirs.fetchall())
