"""The indexes: vectors in cells, against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import retrieval as rt
from foliant.operators import vector_index as vi
from foliant.sources import keyword_index as ki

DIM = 16


def clustered(n, groups=12, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, DIM)) * 4
    return centres[r.integers(groups, size=n)] + r.normal(size=(n, DIM))


@pytest.fixture(scope="module")
def points(spark):
    v = clustered(1500)
    rows = [(i, f"d{i % 7}", [float(x) for x in v[i]]) for i in range(len(v))] + [(9000, "d0", []), (9001, "d0", None)]
    return spark.createDataFrame(rows, "point_id long, doc_id string, dense array<double>").repartition(4)


def asked(points, every=100):
    q = points.where((F.col("point_id") % every == 0) & (F.size("dense") > 0))
    return q.select(F.col("point_id").alias("query_id"), F.col("dense").alias("qvec"), F.when(F.col("point_id") % 200 == 0, F.array(F.lit("d1"), F.lit("d2"))).alias("document_ids"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.point_id, round(r.score, 6)) for r in df.collect())


def test_all_cells_are_exact(spark, points, monkeypatch):
    monkeypatch.setattr(vi, "POINT_BLOCK", 40)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 3)
    centroids = vi.fit_centroids(points, 10)
    placed = vi.assign(points, centroids)
    assert placed.count() == 1500
    assert rows(vi.search(placed, centroids, asked(points), 10, 10)) == rows(rt.dense_topk(points, asked(points), 10))


def test_few_probes_reach_nine_tenths_of_grouped_vectors(spark, points):
    centroids = vi.fit_centroids(points, 24, sample=600)
    placed = vi.assign(points, centroids)
    queries = asked(points, 10).withColumn("document_ids", F.lit(None).cast("array<string>"))
    probes = vi.probes_for(placed, centroids, queries, 10)
    assert probes <= 12
    got = vi.recall(vi.search(placed, centroids, queries, 10, probes), rt.dense_topk(points, queries, 10)).agg(F.sum("hit"), F.sum("wanted")).first()
    assert got[1] == 1500 and got[0] >= 0.9 * got[1]


def test_stored_index_takes_more_points_and_reads_probed_cells(spark, points, tmp_path):
    path = str(tmp_path / "index")
    vi.write_index(points.where("point_id < 1000"), path, 8)
    vi.add_points(spark, points.where("point_id >= 1000"), path)
    placed, centroids = vi.read_index(spark, path)
    assert placed.count() == 1500 and rows(vi.search(placed, centroids, asked(points), 5, 8)) == rows(rt.dense_topk(points, asked(points), 5))
    plan = placed.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_odd_indexes(spark, points):
    none = points.limit(0)
    centroids = vi.fit_centroids(none, 8)
    assert centroids.count() == 0 and vi.search(vi.assign(none, centroids), centroids, asked(points), 5, 3).count() == 0
    few = points.where("point_id < 3 or point_id = 9000")
    centroids = vi.fit_centroids(few, 8)
    assert centroids.count() == 3 and vi.search(vi.assign(few, centroids), centroids, asked(points, 500), 5, 8).where("rank > 3").count() == 0


def test_more_queries_than_a_pass_takes(spark, points):
    queries = asked(points, 7)
    assert len(rt.in_parts(queries, 50)) > 4
    assert rows(rt.dense_topk(points, queries, 3, pass_queries=50)) == rows(rt.dense_topk(points, queries, 3))
    many = spark.range(10_001).select(F.col("id").alias("query_id"), F.array(*[F.lit(float(i == 1)) for i in range(DIM)]).alias("qvec"), F.lit(None).cast("array<string>").alias("document_ids"))
    assert rt.dense_topk(points, many, 1).groupBy().agg(F.count("*"), F.count_distinct("point_id")).first()[:] == (10_001, 1)


def test_keywords_of_more_queries_than_are_broadcast(spark, monkeypatch):
    p = spark.createDataFrame([(i, "d", " ".join(f"w{j}" for j in range(i % 11, i % 11 + 5))) for i in range(60)], "point_id long, doc_id string, text string")
    q = spark.createDataFrame([(i, f"w{i % 13} w{i % 5}") for i in range(80)], "query_id long, query string").withColumn("document_ids", F.lit(None).cast("array<string>"))
    want = rows(rt.sparse_topk(p, q, 4))
    monkeypatch.setattr(rt.small, "__defaults__", (3,))
    assert rows(rt.sparse_topk(p, q, 4)) == want and want


WORDS = "SELECT id AS point_id, concat('d', id % 5) AS doc_id, CASE WHEN id % 97 = 5 THEN NULL ELSE concat_ws(' ', transform(sequence(1, 3 + id % 40), i -> concat('w', cast(pow((id * 7919 + i * 104729) % 97, 2) % 61 AS int)))) END AS text FROM range(3000)"


def questions(spark):
    q = spark.createDataFrame([(1, "w0 w1 w4"), (2, "w9"), (3, "w16 w16 W3 nothing"), (4, ""), (5, "nothing at all"), (6, "w" + " w".join(map(str, range(61))))], "query_id long, query string")
    return q.withColumn("document_ids", F.when(F.col("query_id") == 3, F.array(F.lit("d1"), F.lit("d4"))))


def test_stored_keywords_find_the_same_with_fewer_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ki, "BLOCK", 16)
    points = spark.sql(WORDS)
    ki.write_batch(points, str(tmp_path / "i"), 0)
    index = ki.Index(spark, str(tmp_path / "i"))
    want = rows(rt.sparse_topk(points, questions(spark), 10))
    assert rows(ki.search(index, questions(spark), 10)) == want and len(want) >= 40
    assert max(r[0] for r in index.postings.select(F.size("postings")).collect()) < 64
    read = {r.query_id: (r.some, r.every) for r in ki.needed_levels(index, questions(spark), 10).groupBy("query_id").agg(F.sum(F.when(F.col("needed"), F.col("n"))).alias("some"), F.sum("n").alias("every")).collect()}
    assert read[2][0] < 0.5 * read[2][1] and sum(x for x, _ in read.values()) < sum(x for _, x in read.values())


def test_stored_keywords_follow_inserts_and_removals(spark, tmp_path):
    path, points = str(tmp_path / "i"), spark.sql(WORDS)
    stale = points.where("point_id % 3 = 0").withColumn("text", F.lit("w1 w1 w9"))
    ki.write_batch(points.where("point_id % 3 = 1").unionByName(stale), path, 0)
    for _ in range(2):  # a batch that runs again replaces itself
        ki.write_batch(points.where("point_id % 3 = 0"), path, 1, removed=stale)
    ki.write_batch(points.where("point_id % 3 = 2"), path, 2)
    assert rows(ki.search(ki.Index(spark, path), questions(spark), 10)) == rows(rt.sparse_topk(points, questions(spark), 10))
    gone = points.where("point_id % 3 = 2")
    ki.write_batch(points.limit(0), path, 3, removed=gone)
    assert rows(ki.search(ki.Index(spark, path), questions(spark), 10)) == rows(rt.sparse_topk(points.where("point_id % 3 < 2"), questions(spark), 10))


def test_an_empty_index_finds_nothing(spark, tmp_path):
    ki.write_batch(spark.sql(WORDS).limit(0), str(tmp_path / "i"), 0)
    assert ki.search(ki.Index(spark, str(tmp_path / "i")), questions(spark), 10).count() == 0


def test_texts_are_cut_into_terms_once_for_a_stored_index(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        asked.add(1)
        return text

    points = spark.sql(WORDS)
    ki.write_batch(points.withColumn("text", seen("text")), str(tmp_path / "i"), 0)
    assert asked.value == points.count()


def test_terms_are_counted_where_their_texts_are(spark):
    points = spark.sql("select * from values (1L, 'd', 'b a, B'), (2L, 'd', ''), (3L, 'd', null), (4L, 'd', '?'), (5L, 'd', 'x') as t(point_id, doc_id, text)")
    assert {(r.point_id, r.term, r.tf, r.dl) for r in rt.postings(points).collect()} == {(1, "a", 1, 3), (1, "b", 2, 3), (5, "x", 1, 1)}
    made = rt.sparse_vectors(points)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.point_id: sorted(r.sparse) for r in made.collect()} == {1: ["a", "b"], 5: ["x"]}


def test_rows_that_repeat_an_id_are_postings_of_one_point(spark, tmp_path):
    points = spark.sql("select * from values (1L, 'd', 'a b'), (1L, 'd', 'a c'), (1L, 'e', 'f'), (2L, 'd', 'a'), (null, 'd', 'a'), (null, 'd', 'z'), (3L, 'd', null), (3L, 'd', null) as t(point_id, doc_id, text)")
    want = {(1, "d", "a", 2, 2), (1, "d", "b", 1, 2), (1, "d", "c", 1, 2), (1, "e", "f", 1, 1), (2, "d", "a", 1, 1), (None, "d", "a", 1, 1), (None, "d", "z", 1, 1)}
    assert {(r.point_id, r.doc_id, r.term, r.tf, r.dl) for r in rt.postings(points).collect()} == want
    assert {r.point_id: sorted(r.sparse) for r in rt.sparse_vectors(points).collect()} == {1: ["a", "b", "c", "f"], 2: ["a"], None: ["a", "z"]}
    ki.write_batch(points, str(tmp_path / "i"), 0)
    index = ki.Index(spark, str(tmp_path / "i"))
    assert index.stats.select("n", "n_dl", "dl").collect() == [(8, 6, 8)]
    assert {(r.term, r.df) for r in index.terms.collect()} == {("a", 3), ("b", 1), ("c", 1), ("f", 1), ("z", 1)}


def test_scores_of_points_are_summed_where_their_terms_are(spark):
    rows = [(1, "d", "b a b"), (2, "d", "a"), (2, "d", "a c a"), (4, "e", "b c")]
    points = spark.createDataFrame(rows, "point_id long, doc_id string, text string")
    asked = [("q", "a b b", None), ("r", "c x", ["e"]), ("s", "", None)]
    queries = spark.createDataFrame(asked, "query_id string, query string, document_ids array<string>")
    found = rt.sparse_topk(points, queries, 2)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, point_id#", found._jdf.queryExecution().executedPlan().toString())
    df = Counter(t for _, _, text in rows for t in set(text.split()))
    avg = sum(len(text.split()) for _, _, text in rows) / len(rows)
    want = []
    for q, query, scope in asked:
        scores = Counter()
        for i, doc, text in rows:
            for t in query.split() if scope is None or doc in scope else []:
                tf = text.split().count(t)
                scores[i] += tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(text.split()) / avg)) * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))
        best = sorted((-round(x, 6), i) for i, x in scores.items() if x)[:2]
        want += [(q, i, -x, n + 1) for n, (x, i) in enumerate(best)]
    assert sorted((r.query_id, r.point_id, r.score, r["rank"]) for r in found.collect()) == sorted(want)


def test_terms_of_a_text_are_counted_once(spark):
    points = spark.createDataFrame([(1, "d", "b a b")], "point_id long, doc_id string, text string")
    plan = rt.exploded(rt.counted(points, None))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
