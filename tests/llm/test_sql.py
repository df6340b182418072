"""The SQL of the operators' queries gives their rows."""

from __future__ import annotations

import duckdb
import pytest

from foliant.llm import queries
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in found.fetchall()), key=str)
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=str) == want and want
