"""Sources, sinks, streams and whole plans."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from foliant.plans import models as md
from foliant.plans import pipelines as pl
from foliant.sources import readers as rd
from foliant.sources import writers as wr
from foliant.streaming import lifecycle as lc


def test_pdf_scan_and_extract(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("in/b.pdf", "in/a.pdf", "in/sub/c.PDF", "in/x.txt"):
        (tmp_path / name).write_bytes(b"one\ftw\xc2\xado")
    flat = rd.pdf_files(spark, str(tmp_path / "in"))
    assert sorted(r.doc_id for r in flat.select("doc_id").collect()) == ["a", "b"]
    assert sorted(r.doc_id for r in rd.pdf_tree(spark, str(tmp_path / "in")).select("doc_id").collect()) == ["a", "b", "c"]
    pages = rd.pages_of(rd.extract(flat, lambda x: x.decode().split("\f")))
    assert sorted((r.doc_id, r.page_no, r.text) for r in pages.collect()) == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "one"), ("b", 2, "two")]
    assert rd.extract(flat, lambda x: 1 / 0).where("error is not null").count() == 2
    with pytest.raises(FileNotFoundError):
        rd.pdf_files(spark, str(tmp_path / "in"), "*.doc")


def test_small_sources(spark):
    lines = spark.createDataFrame([("# c\nA=1=2\n\nA=3\r\nB = x",)], "value string")
    assert {r.key: r.value for r in rd.settings(lines).collect()} == {"A": "1=2", "B": "x"}
    cards = rd.gpus(spark.createDataFrame([("0, Big, 81920",), ("1, Small, 24576",), ("bad",)], "value string"))
    plan = rd.gpu_plan(cards, 2.0, 6.0).first()
    assert (plan.name, plan.instances, plan.concurrency, plan.pages_per_min) == ("Big", 16, 6, 360)
    assert rd.gpu_plan(cards.limit(0), 2.0, 6.0).first().pages_per_min == 5
    names = spark.createDataFrame([("a.PDF",), ("b.txt",)], "name string")
    assert rd.uploads(names).count() == 1
    files = spark.createDataFrame([("/d/x.pdf",), ("/d/long_y_1.pdf",)], "path string")
    assert {r.document_id: r.path for r in rd.find_pdf(spark.createDataFrame([("x",), ("y",), ("q",)], "document_id string"), files).collect()} == {"x": "/d/x.pdf", "y": "/d/long_y_1.pdf", "q": None}


def test_upsert_replaces_documents(spark, tmp_path):
    schema = "doc_id string, point_id string, dense array<float>"
    old = spark.createDataFrame([("a", "a1", [1.0]), ("b", "b1", [1.0])], schema)
    new = spark.createDataFrame([("a", "a2", [2.0]), ("c", "c1", [])], schema)
    assert sorted(r.point_id for r in wr.upsert(new, old, 1).collect()) == ["a2", "b1"]
    left, n = wr.delete_document(old, "a")
    assert (left.count(), n.first().deleted) == (1, 1)
    assert wr.delete_points(old, spark.createDataFrame([("b1",)], "point_id string")).count() == 1
    wr.write_points(old, str(tmp_path / "points"), 4)
    assert rd.points(spark, str(tmp_path / "points")).count() == 2


def test_deleted_documents_are_gone_after_a_write(spark, tmp_path):
    path, schema = str(tmp_path / "points"), "doc_id string, point_id string, dense array<float>"
    ids = [f"d{k}" for k in range(6)]
    wr.write_points(spark.createDataFrame([(d, f"{d}-1", [1.0]) for d in ids], schema), path, 64)
    there = lambda: sorted(r.point_id for r in rd.points(spark, path).collect())
    left, _ = wr.delete_document(rd.points(spark, path).drop("bucket"), "d0")
    wr.write_points(left, path, 64, touched=spark.createDataFrame([("d0",)], "doc_id string"))
    assert there() == [f"{d}-1" for d in ids[1:]]
    new = spark.createDataFrame([("d1", "d1-2", [2.0])], schema)
    merged = wr.upsert(new, rd.points(spark, path), 64)
    assert set(r.doc_id for r in merged.collect()) <= {"d1", *ids} and merged.where("doc_id = 'd1'").count() == 1
    wr.write_points(merged.drop("bucket"), path, 64, touched=new)
    assert there() == ["d1-2", *(f"{d}-1" for d in ids[2:])]
    wr.write_points(rd.points(spark, path).drop("bucket").where("doc_id = 'd5'"), str(tmp_path / "other"), 64)
    wr.write_points(spark.createDataFrame([("z", "z1", [1.0])], schema), str(tmp_path / "other"), 64)
    assert [r.point_id for r in rd.points(spark, str(tmp_path / "other")).collect()] == ["z1"]


def test_texts_by_tool_and_csv(spark, tmp_path):
    wr.write_text_by_tool(spark.createDataFrame([("a", "1", "x\ny"), ("b", "1", "z")], "tool string, doc_id string, text string"), str(tmp_path / "t"))
    assert {(r.tool, r.text) for r in spark.read.json(str(tmp_path / "t")).collect()} == {("a", "x\ny"), ("b", "z")}
    wr.write_csv(spark.createDataFrame([(1, "q")], "n int, s string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s == "q"
    assert wr.env_lines({"A": 1, "B": "x"}) == "A=1\nB=x\n"


def test_log_tail_follows_offsets_and_rotation(spark):
    files = lambda **x: spark.createDataFrame([(k, v.encode()) for k, v in x.items()], "path string, content binary")
    none = spark.createDataFrame([], "path string, offset int")
    lines, at = rd.tail(files(a="one\nGET /health\nthr", b="é\n"), none)
    assert sorted((r.path, r.value) for r in lines.collect()) == [("a", "one"), ("b", "é")]
    at = spark.createDataFrame(at.collect(), "path string, offset int")
    lines, more = rd.tail(files(a="one\nGET /health\nthree\nfour\n", b="x\n"), at)
    assert sorted((r.path, r.value) for r in lines.collect()) == [("a", "four"), ("a", "three"), ("b", "x")]
    assert {r.path: r.offset for r in more.collect()} == {"a": 27, "b": 2}


def test_search_pages_stop(spark):
    pages = [[("a", 1), ("b", 2)], [("b", 3), ("c", 4)], [], [("d", 5)]]
    assert sorted(r.id for r in rd.search_pages(spark, lambda k: pages[k], "id string, n int", 10).collect()) == ["a", "b", "c"]
    assert rd.search_pages(spark, lambda k: pages[k], "id string, n int", 2).count() == 2
    assert rd.search_pages(spark, lambda k: [][k], "id string, n int", 2).count() == 0


def test_layout_keeps_errors_and_missing_files(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"x")], "doc_id string, content binary")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    got = {r.doc_id: r for r in rd.layout(files, lambda x, images: [(int(x), images)], "n int, pictures boolean", wanted, images=False).collect()}
    assert got["a"]["items"][0].n == 1 and not got["a"]["items"][0].pictures and "invalid literal" in got["b"].error and got["c"].error == "File not found"


def test_failover_and_backoff():
    calls, waits = [], []

    def bad(x):
        calls.append("bad")
        raise md.Throttled()

    call = md.failover([bad, lambda x: x + 1], wait=waits.append)
    assert call(1) == 2 and call(1) == 2 and calls == ["bad"] and not waits
    with pytest.raises(md.Throttled):
        md.failover([bad], attempts=3, delay=1.0, wait=waits.append)(0)
    assert waits == [2.0, 4.0]

    def wrong(x):
        raise md.ClientError("4xx")

    with pytest.raises(md.ClientError):
        md.failover([wrong, lambda x: x], wait=waits.append)(0)


def test_collection_and_reports(spark, tmp_path):
    wr.create_collection(spark, "things", "doc_id STRING")
    wr.create_collection(spark, "things", "doc_id STRING")
    assert wr.drop_collection(spark, "things") and not wr.drop_collection(spark, "things")
    docs = spark.createDataFrame([("b", True, True), ("a", True, True), ("c", False, False)], "doc_id string, needs_ocr boolean, success boolean")
    wr.write_run(docs.agg(F.count("*").alias("n")), docs, str(tmp_path / "run"))
    assert [r.value for r in spark.read.text(str(tmp_path / "run/needs_ocr")).orderBy("value").collect()] == ["a", "b"]
    nested = wr.result_rows(spark.createDataFrame([("a", 1, "text", "x"), ("a", 0, "table", "y")], "doc_id string, ord int, chunk_type string, text string"), docs.where("doc_id = 'a'"))
    wr.write_results(nested, str(tmp_path / "json"))
    row = json.loads(spark.read.text(str(tmp_path / "json")).first().value)
    assert [c["ord"] for c in row["chunks"]] == [0, 1] and row["stats"]["table"] == 1
    assert wr.encoded(nested).first().stats.startswith("{")


def test_lifecycle_times_out(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    rounds = [[("b", "1", "processing", at(0)), ("b", "2", "processing", at(1))], [("b", "2", "complete", at(5))], [("b", "3", "pending", at(2000))], [("b", "4", "pending", at(2001))]]
    path = str(tmp_path / "events")
    for rows in rounds:
        spark.createDataFrame(rows, lc.EVENT).coalesce(1).write.mode("append").parquet(path)
    events = spark.readStream.schema(lc.EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    q = lc.lifecycle(events).writeStream.format("memory").queryName("life").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.doc_id, r.state, r.recovered) for r in spark.table("life").collect()}
    assert ("1", "pending", True) in got and ("2", "complete", False) in got
    assert not any(d == "2" and rec for d, _, rec in got)


def test_ingest_stream_and_retrieve(spark, tmp_path):
    schema = "doc_id string, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double"
    rows = [(d, i, "text", "text", 0, f"{d} says number {i} about iron and steel", 1, 50.0, 700.0 - 40 * i, 550.0, 670.0 - 40 * i) for d in ("x", "y") for i in range(3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "items"))
    vlm = spark.createDataFrame([], "doc_id string, seq int, kind string, page_no int, t double, success boolean, markdown string, relevant boolean, description string, figure_type string, caption string")
    formulas = spark.createDataFrame([], "doc_id string, page_no int, seq int, formula_id string, latex string, equation_number string, after_box int, description string")
    regions = spark.createDataFrame([], "doc_id string, page_no int, seq int, start_box int, last_box int, formatted_text string")
    build = lambda batch: pl.ingest(batch, vlm, formulas, regions, "c")
    lc.ingest_stream(spark, str(tmp_path / "items"), schema, build, str(tmp_path / "points"), str(tmp_path / "ck2")).awaitTermination(120)
    points = spark.read.parquet(str(tmp_path / "points"))
    assert points.count() == 2 and points.select("point_id").distinct().count() == 2
    vec = md.Offline().embed(["iron steel x"])[0]
    q = spark.createDataFrame([("q1", "iron steel x", vec, ["x"], 10, 2), ("q2", "iron", vec, ["nothing"], 10, 2), ("q3", "", vec, None, 10, 2)], "query_id string, query string, qvec array<float>, document_ids array<string>, top_k_candidates int, top_k_final int")
    out = pl.retrieve(points, q)
    assert [r.document_id for r in out["ranked"].collect()] == ["x"]
    assert [(r.query_id, r.document_id) for r in out["citations"].collect()] == [("q1", "x")]
    assert {r.query_id for r in out["refusals"].collect()} == {"q2"}
    last = out["events"].orderBy(F.desc("seq")).first()
    assert last.event == "data: [DONE]\n\n"
    every, changes = pl.remerge(points.drop("epoch"), "c")
    assert every.count() == 2 and changes.count() == 0


def test_process_gives_a_row_for_every_document(spark):
    item = "seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double"
    line = lambda k, text: (k, "text", "text", 0, text, 1, 50.0, 700.0 - 40 * k, 550.0, 670.0 - 40 * k)

    def parser(content, images):
        if content == b"broken":
            raise ValueError("not a document")
        return [line(k, t) for k, t in enumerate(content.decode().split("|")) if t]

    class Picky(md.Offline):
        def embed(self, texts):
            if any("refuse" in t for t in texts):
                raise RuntimeError("no")
            return super().embed(texts)

    long = "words of a text " * 20
    files = spark.createDataFrame([("good", f"{long}|{long}".encode()), ("bad", b"broken"), ("none", b""), ("half", f"refuse {long}".encode())], "doc_id string, content binary").repartition(4, "doc_id")
    points, results = pl.process(files, parser, item, "c", Picky())
    got = {r.doc_id: r for r in results.collect()}
    assert {k: (r.success, r.error) for k, r in got.items()} == {"good": (True, None), "bad": (False, "not a document"), "none": (False, "no items"), "half": (False, "1 chunks without a vector")}
    assert got["good"].points == got["good"].chunks == 2 and got["good"].layout_s > 0 and got["good"].total_s >= got["good"].layout_s
    assert [r.doc_id for r in points.collect()] == ["good", "good"]
    for held in results.held:
        held.unpersist()


def test_bucketed_points_join_without_a_shuffle(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('d', id % 40) AS doc_id", "cast(id AS int) AS ord", "'x' AS text")
    a, b = (wr.store_bucketed(rows, f"bucketed_{k}_{tmp_path.name.replace('-', '_')}", str(tmp_path / k), 8) for k in "ab")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b.select("doc_id", "ord").withColumnRenamed("ord", "o"), "doc_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_settings_and_payload_filters(spark, tmp_path):
    from foliant.operators import retrieval as rt

    wr.write_env(spark, {"A": 1, "B": "x=y"}, str(tmp_path / "env"))
    assert {r.key: r.value for r in rd.settings(spark.read.text(str(tmp_path / "env"), wholetext=True)).collect()} == {"A": "1", "B": "x=y"}
    rows = [(1, "en", '{"k": 7, "a.b": true, "it\'s": "q"}'), (2, "en", '{"k": "7"}'), (3, "de", '{"k": 7}'), (4, "en", "no json"), (5, "en", None), (6, "en", '{"k": 7.5}')]
    p = spark.createDataFrame(rows, "point_id long, lang string, raw string").withColumn("payload", F.try_parse_json("raw"))
    ids = lambda **x: sorted(r.point_id for r in rt.free_filters(p, x).collect())
    assert ids(k=7, lang="en") == [1] and ids(lang="de") == [3] and ids(**{"a.b": True}) == [1] and ids(**{"it's": "q"}) == [1] and ids(gone=1) == []
    rt.with_hot_keys(p, {"k": "bigint"}).drop("payload").write.parquet(str(tmp_path / "hot"))
    plan = rt.free_filters(spark.read.parquet(str(tmp_path / "hot")), {"k": 7})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,7)" in plan


def test_error_frames(spark):
    from foliant.operators import retrieval as rt

    answers = spark.createDataFrame([("q", 1, "half an", "lost"), ("q", 2, "all", None)], "query_id string, turn int, answer string, error string")
    ranked = spark.createDataFrame([], "query_id string, final_rank int, document_id string, page_no int, chunk_type string, text string")
    got = {t: [r.event for r in rt.events(answers, ranked).where(F.col("turn") == t).orderBy("seq").collect()] for t in (1, 2)}
    assert got[1] == ['data: {"token":"half "}\n\n', 'data: {"token":"an"}\n\n', 'data: {"error":"lost"}\n\n', "data: [DONE]\n\n"]
    assert got[2] == ['data: {"token":"all"}\n\n', 'data: {"sources":[]}\n\n', "data: [DONE]\n\n"]


def test_images_with_their_manifest(spark, tmp_path):
    import base64

    png = b"\x89PNG\r\n\x1a\n" + b"data"
    rows = [(f"t{k}", base64.b64encode(png if k else b"other").decode() if k < 3 else None) for k in range(4)]
    wr.write_images(spark.createDataFrame(rows, "table_id string, image_base64 string"), str(tmp_path), 2)
    got = spark.read.json(f"{tmp_path}/manifest").orderBy("table_id").collect()
    assert [(r.table_id, r.file, r.bytes, r.is_png) for r in got] == [("t0", "t0.png", 5, False), ("t1", "t1.png", 12, True)]
    assert {bytes(r.png) for r in spark.read.parquet(f"{tmp_path}/images").collect()} == {b"other", png}
