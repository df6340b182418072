"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from foliant import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return v if isinstance(v, bool) else str(v)
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=str)
    assert got == want


def test_embedded_points_whose_words_cancel_out(spark, tmp_path):
    from foliant.plans.models import Offline

    words = [f"w{i}" for i in range(200)]
    vectors = dict(zip(words, Offline().embed(words), strict=True))
    pair = next(f"{a} {b}" for a in words for b in words if [-x for x in vectors[a]] == vectors[b])
    texts = [pair, f"{pair}\n{pair}", "\u00a0", "\u2003\n", "\u000b", "\u0085", " \t\r\n\f", "", None, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["embedded_points"](spark, str(tmp_path)).select("point_id", "dimensions", "length").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"select point_id, dimensions, length from ({catalog.ORACLE_SQL['embedded_points']})").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_have_no_cartesian(spark):
    for name in ("contained_boxes", "dedup_types", "missed_tables"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_needed_columns(spark):
    plan = catalog.QUERIES["payload_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)" in plan
    assert "n_chars" not in plan
