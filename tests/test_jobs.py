"""The jobs: whole results against plain Python, reruns, and growing input."""

from __future__ import annotations

import json
import math
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from foliant.session import exists
from jobs import chunk_ingest, queries, text_triage
from jobs.common import config
from tests.conftest import SF

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_has_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in found.fetchall()), key=str)
    assert sorted((tuple(x[c] for c in cols) for x in df.collect()), key=str) == want and want
    assert before == {k: spark.conf.get(k, None) for k in before}
    assert not spark.streams.active


def plain_route(text, size=500, share=0.3):
    pages = re.findall(rf"(?s).{{1,{size}}}", text or "")
    kinds = []
    for p in pages:
        p = p.replace("\xad", "").replace("￾", "")
        a, n = sum(c.isalnum() for c in p), sum(not c.isspace() for c in p)
        kinds.append("empty" if a < 100 else "garbled" if a / n < 0.7 else "ok")
    bad, full = kinds.count("garbled"), len(kinds) - kinds.count("empty")
    return "empty" if not full else "ocr" if bad / full > share else "partial" if bad else "text", ",".join(str(i) for i, k in enumerate(kinds, 1) if k == "garbled")


def test_triage_routes_and_reruns(spark, tmp_path):
    good, junk = "a plain sentence of words " * 40, "abc1#$%^& " * 160
    rows = [(1, good * 5, "en", "s"), (2, junk, "en", "s"), (3, good * 5 + junk[:400], None, "s"), (4, None, "de", None), (5, "", "de", "s"), (6, "short", "de", "s"), (None, good, "en", "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    first = sorted(map(str, text_triage.run(spark, str(tmp_path / "in"), out, config("text_triage")).collect()))
    again = text_triage.run(spark, str(tmp_path / "in"), out, config("text_triage"))
    assert sorted(map(str, again.collect())) == first
    assert {r.doc_id: (r.route, r.ocr_pages) for r in again.collect()} == {i: plain_route(t) for i, t, _, _ in rows if i is not None}
    assert {r.lang for r in again.collect()} == {"en", "de", None} and {r.route for r in again.collect()} == {"text", "ocr", "partial", "empty"}
    empty = tmp_path / "none"
    spark.createDataFrame([], SCHEMA).write.parquet(str(empty))
    assert text_triage.run(spark, str(empty), out, config("text_triage")).count() == 0


def plain_chunks(text, low=150):
    out = []
    for k, line in enumerate((text or "").split("\n")):
        if not line.strip(" "):
            continue
        kind = "table" if re.fullmatch(r"\|.*\|", line.strip(" ")) else "text"
        if out and kind == "text" and len(line) < low and out[-1][3] == "text":
            out[-1][2] += "\n" + line
        else:
            out.append([k, kind, line, kind])
        out[-1][3] = kind
    return sorted((k, kind, t) for k, kind, t, _ in out)


def stored(df, i):
    return sorted((r.ord, r.chunk_type, r.text) for r in df.where(F.col("doc_id") == i).collect())


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    new, out, mark = str(tmp_path / "new"), str(tmp_path / "out"), str(tmp_path / "mark")
    texts = {1: "Head\nx\n\n| a | b |\n" + "long " * 60 + "\ntail", 2: "one line", 3: "", 4: None}
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(new)
    add([(i, t, "en", "s") for i, t in texts.items()] + [(None, "nameless", "en", "s"), (2, "a line", "en", "s")])
    settings = config("chunk_ingest") | {"files_per_batch": 1}
    first = chunk_ingest.run(spark, new, out, mark, settings)
    assert {i: stored(first, i) for i in texts} == {i: plain_chunks(t) for i, t in texts.items()}
    rows = sorted(map(str, first.collect()))
    # nothing new: no batch and the same rows
    assert sorted(map(str, chunk_ingest.run(spark, new, out, mark, settings).collect())) == rows
    folders = lambda: sorted(p.name for p in (tmp_path / "out").iterdir())
    assert folders() == ["batch=0"]
    # a new document, one that comes again, and one that comes again without text
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/batch=0").rglob("*.parquet")}
    add([(5, "fresh", "de", "s"), (2, "changed\nlines", "en", "s"), (1, None, "en", "s")])
    second = chunk_ingest.run(spark, new, out, mark, settings)
    assert folders() == ["batch=0", "batch=1"] and files == {p: p.stat().st_mtime_ns for p in files}
    assert {i: stored(second, i) for i in range(1, 6)} == {1: [], 2: plain_chunks("changed\nlines"), 3: [], 4: [], 5: plain_chunks("fresh")}
    # a store built from all files at once has the same rows
    whole = chunk_ingest.run(spark, new, str(tmp_path / "out2"), str(tmp_path / "mark2"), settings)
    assert sorted(map(str, whole.collect())) == sorted(map(str, second.collect()))


def test_ingest_survives_a_batch_that_fails(spark, tmp_path, monkeypatch):
    new, out, mark = str(tmp_path / "new"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.createDataFrame([(k, f"text {k}", "en", "s") for k in range(20)], SCHEMA).write.parquet(new)
    real = chunk_ingest.log.info

    def dies(text, *a):
        if "wrote" in text:
            raise RuntimeError("lost after the write")
        real(text, *a)

    monkeypatch.setattr(chunk_ingest.log, "info", dies)
    with pytest.raises(Exception, match="lost after the write"):
        chunk_ingest.run(spark, new, out, mark, config("chunk_ingest"))
    monkeypatch.undo()
    got = chunk_ingest.run(spark, new, out, mark, config("chunk_ingest"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_ingest_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "new"))
    got = chunk_ingest.run(spark, str(tmp_path / "new"), str(tmp_path / "out"), str(tmp_path / "mark"), config("chunk_ingest"))
    assert got.count() == 0 and got.columns == [c.split()[0] for c in chunk_ingest.COLUMNS.split(", ")]


def test_config_and_command_line(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"page_chars": 100}))
    assert config("text_triage", str(tmp_path / "c.json")) == {"page_chars": 100, "garbled_share": 0.3}
    (tmp_path / "d.json").write_text(json.dumps({"pages": 1}))
    with pytest.raises(ValueError, match="pages"):
        config("text_triage", str(tmp_path / "d.json"))
    out = str(tmp_path / "out")
    run = subprocess.run([sys.executable, "-m", "jobs.text_triage", f"{SF}/documents.parquet", out, "--config", str(tmp_path / "c.json")], capture_output=True, text=True, timeout=240, env=clean_env())
    assert run.returncode == 0, run.stderr[-2000:]
    assert "text_triage reads 200 rows" in run.stderr and exists(spark, out)
    pages = text_triage.read_back(spark, out).agg(F.sum("pages")).first()[0]
    assert pages == sum(math.ceil(len(r.text) / 100) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def clean_env():
    import os

    return {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
