"""Facts about single operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import text as tx
from foliant.functions import vectors as vx
from foliant.operators import batch as bt
from foliant.operators import chunks as ch
from foliant.operators import layout as ly
from foliant.operators import quality as ql
from foliant.operators import retrieval as rt
from foliant.operators import tables as tb


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def box(l, b, r, t):
    return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("lbrt", (l, b, r, t), strict=True)])


@pytest.mark.parametrize(
    "a, b, area",
    [((0, 0, 10, 10), (20, 20, 30, 30), 0), ((0, 0, 10, 10), (0, 0, 10, 10), 100), ((0, 0, 10, 10), (5, 5, 15, 15), 25), ((10, 10, 20, 20), (0, 0, 100, 100), 100), ((0, 0, 10, 10), (10, 0, 20, 10), 0), ((-10, -10, 0, 0), (-5, -5, 5, 5), 25)],
)
def test_intersection(spark, a, b, area):
    got = spark.range(1).select(box(*a).alias("x"), box(*b).alias("y")).select(g.intersection("x", "y").alias("v")).first().v
    assert got == area


def items(spark, *rows):
    """(seq, type, l, r, t, b)"""
    return spark.createDataFrame([("d", s, k, "text", 1, f"text {s}", 1, float(l), float(t), float(r), float(b)) for s, k, l, r, t, b in rows], "doc_id string, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double")


def seqs(df):
    return sorted(r.seq for r in df.collect())


def test_contained(spark):
    assert seqs(ly.drop_contained(items(spark, (1, "text", 0, 100, 100, 0), (2, "text", 10, 20, 20, 10)))) == [1]
    two = items(spark, (1, "text", 0, 100, 100, 0), (2, "text", 50, 150, 50, 0))
    assert seqs(ly.drop_contained(two)) == [1, 2]
    assert seqs(ly.drop_contained(two, 0.4)) == [1]
    assert seqs(ly.drop_contained(items(spark, (1, "text", 0, 50, 50, 0), (2, "text", 0, 50, 50, 0)))) == [1, 2]
    assert seqs(ly.drop_contained(items(spark, (1, "text", 0, 50, 50, 0), (2, "text", 5, 5, 9, 9)))) == [1, 2]


def test_duplicate_pictures(spark):
    assert seqs(ly.drop_duplicate_pictures(items(spark, (1, "picture", 0, 100, 100, 0), (2, "table", 1, 100, 100, 0)))) == [2]
    assert seqs(ly.drop_duplicate_pictures(items(spark, (1, "picture", 0, 100, 100, 0), (2, "table", 50, 100, 100, 0)))) == [1, 2]


def test_tiny(spark):
    got = ly.eligible(items(spark, (1, "text", 0, 19, 9, 0), (2, "text", 0, 300, 9, 0), (3, "text", 0, 499, 1, 0), (4, "other", 0, 300, 90, 0)))
    assert seqs(got) == [2]


def test_headings(spark):
    rows = [("d", i, "text", lab, lev, txt, 1, 0.0, 100.0 - i, 10.0, 0.0) for i, (lab, lev, txt) in enumerate([("section_header", 1, "A"), ("text", 0, "x"), ("section_header", 2, "B"), ("section_header", 0, "C"), ("text", 0, "y")])]
    df = spark.createDataFrame(rows, "doc_id string, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double")
    got = {r.seq: r.headings for r in ly.heading_stacks(df).collect()}
    assert got == {0: ["A"], 1: ["A"], 2: ["A", "B"], 3: ["C"], 4: ["C"]}


def chunks(spark, *parts):
    """(type, length)"""
    rows = [("d", i, k, chr(97 + i) * n, 1, ["H"]) for i, (k, n) in enumerate(parts)]
    return spark.createDataFrame(rows, "doc_id string, ord int, chunk_type string, text string, page_no int, headings array<string>")


def lengths(df):
    return [len(r.text) for r in df.orderBy("ord").collect()]


def test_merge_small(spark):
    m = lambda *p: lengths(ch.merge_small(chunks(spark, *p), 50))
    assert m(("text", 100), ("text", 30)) == [131]
    assert m(("text", 5), ("table", 20), ("text", 10)) == [5, 20, 10]
    assert m(("text", 1)) == [1]
    assert m(("text", 100), ("text", 30), ("text", 30)) == [162]
    assert m(("text", 5), ("text", 100)) == [5, 100]
    assert ch.merge_small(chunks(spark).limit(0)).count() == 0


def test_merge_max(spark):
    m = lambda *p: lengths(ch.merge_to_max(chunks(spark, *p), 200))
    assert m(("text", 80), ("text", 80)) == [162]
    assert m(("text", 150), ("text", 150)) == [150, 150]
    assert m(("text", 50), ("table", 20), ("text", 50)) == [50, 20, 50]


def test_merge_target_counts_an_empty_first_chunk(spark):
    got = ch.merge_to_target(chunks(spark, ("text", 0), ("text", 600), ("text", 10))).orderBy("ord").collect()
    assert [r.original_orders for r in got] == [[0, 1], [2]]


def test_nearest_match_takes_each_result_once(spark):
    boxes = spark.createDataFrame([("d", 1, 1, 100.0), ("d", 1, 2, 97.0), ("d", 2, 3, 50.5)], "doc_id string, page_no int, seq int, t double")
    vlm = spark.createDataFrame([("d", 1, 10, 98.0), ("d", 1, 11, 95.0), ("d", 2, 12, 50.0)], "doc_id string, page_no int, seq int, t double")
    assert {r.seq: r.vseq for r in tb.nearest_match(boxes, vlm).collect()} == {1: 10, 2: 11, 3: 12}


def test_link_pages_chain(spark):
    head = "| Name | Value | Unit |\n|---|---|---|\n| a | b | c |"
    long = "| " + "x" * 40 + " | b | c |"
    rows = [("d", 1, 1, 700.0, head), ("d", 2, 1, 700.0, "| N | V | U |\n|-|-|-|\n" + long), ("d", 3, 1, 650.0, long), ("d", 4, 1, 649.0, long), ("d", 5, 1, 700.0, "| a | b |")]
    got = {r.page_no: (r.continuation_of, r.markdown) for r in tb.link_pages(spark.createDataFrame(rows, "doc_id string, page_no int, seq int, t double, markdown string")).collect()}
    lead = "| Name | Value | Unit |\n|---|---|---|\n"
    assert got[2] == (1, lead + long) and got[3] == (1, lead + long) and got[4] == (None, long) and got[5][0] is None


def test_page_class(spark):
    letters = lambda n, rest: page(spark, "a" * n + rest)
    assert letters(99, "") == "empty" and letters(100, "") == "ok"
    assert letters(100, "#" * 43) == "garbled" and letters(100, "#" * 42) == "ok"
    assert page(spark, "ä" * 100) == "ok"
    assert one(spark, v=tx.clean_hyphens(F.lit("a­b￾c"))).v == "abc"


def page(spark, text):
    return one(spark, v=tx.page_class(F.lit(text))).v


def test_needs_ocr_is_strict(spark):
    bad, good = "a" * 100 + "#" * 90, "a" * 200
    pages = spark.createDataFrame([("d", i, bad if i < 3 else good) for i in range(10)] + [("e", 0, "")], "doc_id string, page_no int, text string")
    assert {r.doc_id: r.needs_ocr for r in ql.document_quality(pages).collect()} == {"d": False, "e": False}


def test_text_functions(spark):
    got = one(
        spark, a=tx.title_case(F.lit("bar-chart x")), b=tx.column_count(F.lit("| a | b |")), c=tx.column_count(F.lit("a | b")), d=tx.is_separator(F.lit("|:--|-|")), e=tx.duration(F.lit(3725)), f=tx.duration(F.lit(None).cast("int")),
        g=tx.stem(F.lit("/x/y.z.pdf")), h=tx.stream_delta(F.lit('data: {"choices":[{"delta":{"content":"hi"}}]}')), i=tx.stream_delta(F.lit("data: [DONE]")), j=tx.stream_delta(F.lit("data: {bad")),
        k=tx.model_json(F.lit('```json\n{"a": 1}\n```'), "a int"), m=tx.model_json(F.lit("nope"), "a int"), n=F.size(tx.sources(F.lit("x"))), p=tx.decoded(F.lit("plain")), q=tx.progress_bar(F.lit(50.0), 4), r=tx.formula_text(F.lit("x"), F.lit("(1)"), F.lit("d")),
        s=vx.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(3.0), F.lit(4.0))),
    )
    assert (got.a, got.b, got.c, got.d, got.e, got.f, got.g) == ("Bar-Chart X", 2, 0, True, "1h 2m 5s", "N/A", "y.z")
    assert (got.h, got.i, got.j) == ("hi", None, None)
    assert got.k.value.a == 1 and got.k.error is None and got.m.value is None and got.m.raw == "nope"
    assert (got.n, got.p, got.q, got.r) == (0, "plain", "[██░░]", "d\n$$x$$ (1)")
    assert got.s == pytest.approx(1.0)


def test_rerank_facts(spark):
    cand = spark.createDataFrame([("q", "a", "A", 1), ("q", "b", "B", 2), ("q", "c", "C", 3)], "query_id string, point_id string, text string, rank int")
    scores = spark.createDataFrame([("q", "b", 0.98), ("q", "a", 0.75), ("q", "c", 0.41)], "query_id string, point_id string, rerank_score double")
    top = lambda df: [r.point_id for r in df.orderBy("final_rank").collect()]
    assert top(rt.merge_scores(cand, scores, 2)) == ["b", "a"]
    assert top(rt.merge_scores(cand, scores.limit(0), 2)) == ["a", "b"]
    assert top(rt.merge_scores(cand, scores.where("point_id <> 'b'"), 3)) == ["a", "c"]
    assert top(rt.merge_scores(cand, scores.withColumn("rerank_score", F.lit(0.5)), 3)) == ["a", "b", "c"]


def test_empty_scope_means_all(spark):
    points = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0]), (3, "y", [])], "point_id int, doc_id string, dense array<float>")
    q = lambda s: spark.createDataFrame([(0, [1.0, 0.0], s)], "query_id int, qvec array<float>, document_ids array<string>")
    ids = lambda s: [r.point_id for r in rt.dense_topk(points, q(s), 5).orderBy("rank").collect()]
    assert ids(None) == [1, 2] and ids([]) == [1, 2] and ids(["y"]) == [2] and ids(["z"]) == []


STATE = "batch_id string, doc_id string, state string, start_ts double, end_ts double, duration double, pages int, error string"


def test_batch_facts(spark):
    s = spark.createDataFrame([("b", "1", "processing", 0.0, None, None, None, None), ("b", "2", "failed", 0.0, 5.0, 0.0, 1, None), ("b", "2", "pending", None, None, None, None, None)], STATE)
    assert bt.counts(s).first().total == 3
    assert bt.stale(s, 600.0).count() == 0 and bt.stale(s, 600.5).count() == 1
    assert bt.latest(s).count() == 2
    empty = spark.createDataFrame([("e", 0.0, "running")], "batch_id string, created_ts double, status string")
    row = bt.progress(s, empty, 10.0).first()
    assert row.percent == 0.0 and row.is_complete is False
    done = bt.mark_complete(bt.mark_processing(bt.submit("n", spark.createDataFrame([("/a/x.pdf",)], "path string")), spark.createDataFrame([("n", "x")], "batch_id string, doc_id string"), 1.0), spark.createDataFrame([("n", "x")], "batch_id string, doc_id string"), 3.5).first()
    assert (done.state, done.duration) == ("complete", 2.5)
    assert bt.timing_summary(s.withColumn("state", F.lit("complete"))).first().n == 0


def test_overlaps_by_place(spark):
    import random

    r = random.Random(9)
    rows = []
    for seq in range(400):
        w, h, x, y = r.choice([3, 20, 90, 400]), r.choice([2, 15, 60, 300]), r.randrange(-50, 500), r.randrange(-50, 700)
        rows.append((seq, r.choice(["text", "table", "picture"]), float(x), float(x + w), float(y + h), float(y)))
        if seq % 3 == 0:
            rows.append((1000 + seq, r.choice(["picture", "table"]), x + 0.02 * w, x + w * 1.0, y + h * 0.99, float(y)))
    rows += [(5000, "text", 9.0, 3.0, 1.0, 8.0), (5001, "text", 1.0, 1.0, 5.0, 2.0), (5002, "picture", -1e9, 1e9, 1e9, -1e9)]
    area = lambda b: (b[3] - b[2]) * (b[4] - b[5])
    inter = lambda a, b: max(0, min(a[3], b[3]) - max(a[2], b[2])) * max(0, min(a[4], b[4]) - max(a[5], b[5]))
    covered = {a[0] for a in rows for b in rows if a[0] != b[0] and area(b) > area(a) > 0 and inter(a, b) >= 0.8 * area(a)}
    twins = {a[0] for a in rows for b in rows if a[1] == "picture" and b[1] == "table" and area(a) > 0 and area(b) > 0 and inter(a, b) >= 0.9 * max(area(a), area(b))}
    got = items(spark, *rows)
    assert sorted(set(seqs(ly.drop_contained(got)))) == sorted({x[0] for x in rows} - covered) and len(covered) > 50
    assert sorted(set(seqs(ly.drop_duplicate_pictures(got)))) == sorted({x[0] for x in rows} - twins) and len(twins) > 5
    assert seqs(ly.drop_overlaps(got)) == seqs(ly.drop_duplicate_pictures(ly.drop_contained(got)))


def test_pairs_of_a_full_page_are_linear(spark):
    page = lambda n: spark.range(n).selectExpr("'d' AS doc_id", "cast(id AS int) AS seq", "'text' AS item_type", "1 AS page_no", "cast(id % 100 * 10 AS double) AS l", "cast(floor(id / 100) * 10 + 8 AS double) AS t", "cast(id % 100 * 10 + 8 AS double) AS r", "cast(floor(id / 100) * 10 AS double) AS b")
    few, many = (ly.centre_pairs(page(n)).count() for n in (1000, 10_000))
    assert many <= 11 * few and many < 100_000


def test_headings_of_chunks_are_found_after_the_last_shuffle(spark):
    import re

    rows = [(d, s, "text", "section_header" if s % 3 == 0 else "text", s % 2, f"t{s}" if s % 4 else None, 1, 50.0, 700.0 - 30 * s, 550.0, 680.0 - 30 * s) for d in (1, 2, None) for s in range(8)]
    items = spark.createDataFrame(rows, "doc_id long, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double")
    page = items.select("doc_id", "page_no", "seq").limit(0)
    vlm = items.select("doc_id", "page_no", "seq", "t").limit(0).selectExpr("*", "'table' AS kind", "false AS success", "'' AS markdown", "false AS relevant", "'' AS description", "'' AS figure_type", "'' AS caption")
    formulas = page.selectExpr("*", "'' AS formula_id", "'' AS latex", "'' AS equation_number", "0 AS after_box", "'' AS description")
    regions = page.selectExpr("*", "0 AS start_box", "0 AS last_box", "'' AS formatted_text").unionByName(spark.sql("select 2L doc_id, 1 page_no, 0 seq, 4 start_box, 6 last_box, 'R' formatted_text"))
    made = ch.build_chunks(items, vlm, formulas, regions)
    plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert moved and not [x for x in moved if "headings#" in x]
    got = {d: [(r.ord, r.text, tuple(r.headings)) for r in made.where(F.col("doc_id").eqNullSafe(F.lit(d))).orderBy("ord").collect()] for d in (1, 2, None)}
    one = [(0, "t1", ()), (1, "t2", ()), (2, "t3", ("t3",)), (3, "t5", ("t3",)), (4, "t6", ("t6",)), (5, "t7", ("t6",))]
    assert got[1] == one and [x[:2] for x in got[None]] == [x[:2] for x in one]
    # the region stands at its first box, 4, whose place is that of t3, and 5 and 6 vanish; boxes without a text have numbers too
    assert got[2] == [(0, "t1", ()), (1, "t2", ()), (2, "R", ("t3",)), (3, "t6", ("t6",)), (4, "t7", ("t6",))]


def test_quick_chunks_move_no_headings(spark):
    from foliant.plans import pipelines as pl

    rows = [(1, s, "text", "section_header" if s == 2 else "text", 0, f"t{s}", 1, 50.0, 700.0 - 30 * s, 550.0, 680.0 - 30 * s) for s in range(5)]
    items = spark.createDataFrame(rows, "doc_id long, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double")
    made = pl.quick(items)
    plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert not [x for x in plan.split("\n\n") if ") Exchange\n" in x and "headings#" in x]
    assert [(r.ord, r.text, r.headings) for r in made.collect()] == [(0, "t0\nt1\nt2\nt3\nt4", [])]


def test_partitions_of_texts_grow_with_the_boxes(spark, monkeypatch):
    from foliant.plans import pipelines as pl

    rows = [(d, s, "text", "section_header" if s == 2 else "text", 0, f"t{s}", 1, 50.0, 700.0 - 30 * s, 550.0, 680.0 - 30 * s) for d in range(20) for s in range(5)]
    items = spark.createDataFrame(rows, "doc_id long, seq int, item_type string, label string, level int, text string, page_no int, l double, t double, r double, b double")
    monkeypatch.setattr(ch, "TASK_BOXES", 4)
    made = pl.quick(items)
    plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "REPARTITION_BY_NUM" in plan and ", 25), REPARTITION_BY_NUM" in plan
    assert sorted((r.doc_id, r.ord, r.text) for r in made.collect()) == [(d, 0, "t0\nt1\nt2\nt3\nt4") for d in range(20)]
