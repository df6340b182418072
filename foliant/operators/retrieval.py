"""Retrieval over tables of points and queries: dense and keyword search, fusion, reranking, context, citations.

points have point_id, doc_id, text, dense and payload columns; queries have query_id, query, qvec
and document_ids (null or empty: all documents). The document filter acts before each branch's cut.
There may be any number of queries: dense search takes them in blocks, keyword search joins their terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from foliant.functions import text as tx
from foliant.functions import vectors as vx
from foliant.session import stored

#: Queries whose vectors are broadcast at once; more are taken in parts, each with a pass over the points.
PASS_QUERIES = 10_000
#: Queries whose products with a batch of points are held at once.
QUERY_BLOCK = 256
#: Rows of a few narrow columns that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Scores of points for queries that a task of keyword search holds, at most: partitions of a fixed number would grow and spill.
TASK_PAIRS = 1_000_000
K1, B, RRF_K0 = 1.2, 0.75, 60


def validate(queries: DataFrame) -> DataFrame:
    """`queries` with `error`: length 1 to 2000, 5 to 100 candidates, 1 to 20 final rows."""
    n, k, f = F.length("query"), F.coalesce("top_k_candidates", F.lit(30)), F.coalesce("top_k_final", F.lit(5))
    error = F.when(n.isNull() | (n < 1) | (n > 2000), "query length").when((k < 5) | (k > 100), "top_k_candidates").when((f < 1) | (f > 20), "top_k_final")
    return queries.withColumn("top_k_candidates", k).withColumn("top_k_final", f).withColumn("error", error)


def equal_filters(points: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal every given value; payload columns push down to the scan."""
    for key, value in filters.items():
        points = points.where(F.col(key) == F.lit(value))
    return points


_KINDS = {"boolean": "^BOOLEAN$", "bigint": "^BIGINT$", "double": "^(DOUBLE|FLOAT|DECIMAL.*|BIGINT)$", "string": "^STRING$"}
_VARIANT = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def in_payload(key: str, kind: str, payload: str = "payload") -> Column:
    """A key of a free payload (variant); null where it is not there or of another kind."""
    mark = '"' if "'" in key else "'"
    if mark in key:
        raise ValueError(f"a payload key with both kinds of quotes: {key}")
    path = f"$[{mark}{key}{mark}]"
    # a variant would turn "7" and 7.5 into whole numbers
    own = F.schema_of_variant(F.try_variant_get(payload, path, "variant")).rlike(_KINDS[kind])
    return F.when(own, F.try_variant_get(payload, path, kind))


def free_filters(points: DataFrame, filters: dict[str, object], payload: str = "payload") -> DataFrame:
    """Rows that equal every given value, in a column of the name where there is one, which reaches the scan, else in the free payload."""
    for key, value in filters.items():
        found = F.col(f"`{key}`") if key in points.columns else in_payload(key, _VARIANT[type(value)], payload)
        points = points.where(found == F.lit(value))
    return points


def with_hot_keys(points: DataFrame, keys: dict[str, str], payload: str = "payload") -> DataFrame:
    """`points` with keys of the payload that filters often name as columns (name: type), to be stored with it."""
    return points.withColumns({k: in_payload(k, kind, payload) for k, kind in keys.items()})


def in_scope(scope: Column, doc: Column) -> Column:
    return scope.isNull() | (F.size(scope) == 0) | F.array_contains(scope, doc)


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` of narrow columns, marked for broadcast if they are counted to be no more than `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def in_parts(queries: DataFrame, most: int) -> list[DataFrame]:
    """`queries` cut by a hash of their id into as many parts as keep each at about `most` rows."""
    n = queries.select("query_id").count()
    # a part has half of `most` rows on average, so that chance does not fill one
    parts = 1 if n <= most else -(-2 * n // most)
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by rounded score, then id; ranks are cut before the shuffle too."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_topk(points: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, metric: str = "cosine", pass_queries: int = PASS_QUERIES) -> DataFrame:
    """(query_id, point_id, score, rank) of the k most similar points of each query.

    Points stream through block products with blocks of query vectors, which are broadcast, and each block keeps its
    k best a query, so what is shuffled is a few rows a task whatever the number of points. Queries of one scope share its test.
    More than `pass_queries` queries are taken in parts by a hash of their id, with one pass over the points each.
    """
    parts = [_dense_part(points, q, k, threshold, metric) for q in in_parts(queries, pass_queries)]
    return reduce(DataFrame.unionByName, parts)


def _dense_part(points: DataFrame, queries: DataFrame, k: int, threshold: float | None, metric: str) -> DataFrame:
    q = queries.select("query_id", "qvec", "document_ids").toPandas()
    vectors = np.array([v for v in q["qvec"]], np.float64).reshape(len(q), -1)
    if metric == "cosine":
        vectors = vectors / np.maximum(np.sqrt((vectors**2).sum(1, keepdims=True)), 1e-300)
    scopes = [() if s is None or len(s) == 0 else tuple(sorted(set(s))) for s in q["document_ids"]]
    kept = points.sparkSession.sparkContext.broadcast((vectors, scopes, q["query_id"].to_numpy()))

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, scopes, ids = kept.value
        by_scope: dict[tuple, list[int]] = {}
        for i, s in enumerate(scopes):
            by_scope.setdefault(s, []).append(i)
        for b in batches:
            if not len(b) or not len(ids):
                continue
            m = np.array(b["dense"].tolist(), np.float64)
            if metric == "cosine":
                m = m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-300)
            point = b["point_id"].to_numpy()
            for scope, mine in by_scope.items():
                rows = np.flatnonzero(b["doc_id"].isin(scope)) if scope else np.arange(len(b))
                for x in range(0, len(mine) if len(rows) else 0, QUERY_BLOCK):
                    some = mine[x : x + QUERY_BLOCK]
                    s = np.round(vectors[some] @ m[rows][:, : vectors.shape[1]].T, 6) + 0.0
                    if len(rows) > k:  # ties with the k-th value stay until the exact order decides
                        bound = np.partition(s, len(rows) - k, axis=1)[:, len(rows) - k][:, None]
                        take = s >= bound
                    else:
                        take = np.ones_like(s, bool)
                    if threshold is not None:
                        take &= s >= threshold
                    i, at = np.nonzero(take)
                    yield pd.DataFrame({"query_id": ids[some][i], "point_id": point[rows][at], "score": s[i, at]})

    kinds = {**dict(points.dtypes), **dict(queries.dtypes)}
    slim = points.where(F.size("dense") > 0).select("point_id", "doc_id", "dense")
    return _ranked(slim.mapInPandas(block, f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, score double"), k)


def _counts(terms: Column) -> Column:
    """(term, tf) of the terms of a sorted array, in order: where a run of equal ones begins, and how far it is to the next."""
    starts = F.array_compact(F.transform(terms, lambda t, i: F.when((i == 0) | (t != F.get(terms, i - 1)), i)))
    # an array of one binds the starts, which are asked for once a term
    runs = lambda a: F.transform(a, lambda at, j: F.struct(F.get(terms, at).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(terms)) - at).cast("long").alias("tf")))
    return F.get(F.transform(F.array(starts), runs), 0)


def repeated_ids(points: DataFrame) -> DataFrame | None:
    """(point_id) of the points that have several rows, if there are any."""
    twice = points.groupBy("point_id").agg(F.count("*").alias("n")).where("n > 1").select("point_id")
    return None if twice.isEmpty() else twice


def counted(points: DataFrame, twice: DataFrame | None) -> DataFrame:
    """(point_id, doc_id, dl, rows, counts): a row for each point, with its terms and how often they stand in it.

    Terms are counted in the row, so texts are not shuffled. Only rows of the ids in `twice`, which are repeated_ids(), are put
    together: those of one doc_id and length are one row here, and `rows` says how many they were.
    """
    each = points.select("point_id", "doc_id", vx.terms(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))
    same, one = ["point_id", "doc_id", "dl"], F.lit(1).cast("long").alias("rows")
    rows = each.select(*same, one, "ts")
    if twice is not None:
        split = lambda how: each.alias("e").join(small(twice).alias("w"), F.col("e.point_id").eqNullSafe(F.col("w.point_id")), how)
        again = split("left_semi").groupBy(*same).agg(F.count("*").alias("rows"), F.flatten(F.collect_list("ts")).alias("ts"))
        rows = split("left_anti").select(*same, one, "ts").unionByName(again)
    return rows.select(*same, "rows", F.sort_array("ts").alias("ts")).select(*same, "rows", _counts(F.col("ts")).alias("counts"))


def exploded(counts: DataFrame) -> DataFrame:
    """(point_id, doc_id, dl, term, tf) of counted() points.

    From explode() Spark would infer a filter of points without terms, in which the terms of a text are sorted again for each of them.
    """
    return counts.select("point_id", "doc_id", "dl", F.explode_outer("counts").alias("x")).where("x is not null").select("point_id", "doc_id", "dl", "x.term", "x.tf")


def postings(points: DataFrame) -> DataFrame:
    """(point_id, doc_id, term, tf, dl): one row a term of a point."""
    return exploded(counted(points, repeated_ids(points)))


def corpus_stats(points: DataFrame) -> DataFrame:
    n = points.select(F.size(vx.terms(F.col("text"))).alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def _with_stats(rows: DataFrame, points: DataFrame) -> DataFrame:
    """`rows` with the one row of corpus_stats() beside each; the constant key makes it a hash join of one broadcast row."""
    one = corpus_stats(points).withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").drop("one")


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def sparse_vectors(points: DataFrame) -> DataFrame:
    """(point_id, sparse): saturated term weights by term, of points with terms; nothing is shuffled but the rows of repeated ids."""
    twice = repeated_ids(points)
    p = _with_stats(counted(points.where(F.col("text").rlike(r"[\p{L}\p{N}]")), twice), points)
    w = F.transform("counts", lambda x: F.struct(x["term"].alias("term"), F.round(_weight(x["tf"], F.col("dl"), F.col("avgdl")), 6).alias("w")))
    ws = p.select("point_id", w.alias("ws"))
    if twice is not None:
        ws = ws.groupBy("point_id").agg(F.sort_array(F.flatten(F.collect_list("ws"))).alias("ws"))
    return ws.select("point_id", F.map_from_entries("ws").alias("sparse"))


def sparse_topk(points: DataFrame, queries: DataFrame, k: int, mode: str = "bm25") -> DataFrame:
    """(query_id, point_id, score, rank) by keywords.

    `bm25`: Robertson-Zaragoza with idf. `tf_dot`: the product of saturated weights of both sides, without idf.
    Terms are counted in a text's row, and those of the queries are kept as a table that the document counts and the search read. Its rows are shuffled by point
    alone, once, so that a point's scores are sums within a task and k rows a query and task are all that is shuffled after them. What a query's term
    adds beside a text's is joined to the queries' terms first. Tables of terms are broadcast only where their counted rows are few.
    """
    spark = points.sparkSession
    qt = queries.select("query_id", "document_ids", vx.terms(F.col("query")).alias("ts")).withColumn("qdl", F.size("ts"))
    qt = qt.select("query_id", "document_ids", "qdl", F.explode("ts").alias("term")).groupBy("query_id", "document_ids", "qdl", "term").agg(F.count("*").alias("qtf"))
    counts = counted(points, repeated_ids(points))
    p = stored(exploded(counts).join(small(qt.select("term").distinct()), "term", "left_semi"), "terms")
    if mode == "bm25":
        qt = qt.join(p.groupBy("term").agg(F.count("*").alias("df")), "term")
    pairs = points.count() * queries.select("query_id").count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pairs // TASK_PAIRS))
    hits = p.repartition(tasks, "point_id").join(small(stored(qt, "query-terms")), "term").where(in_scope(F.col("document_ids"), F.col("doc_id")))
    hits = _with_stats(hits, points)
    w = _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    if mode == "bm25":
        w = w * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")
    else:
        w = w * _weight(F.col("qtf"), F.col("qdl"), F.col("avgdl"))
    return _ranked(hits.groupBy("query_id", "point_id").agg(F.round(F.sum(w), 6).alias("score")), k)


def fuse(branches: list[DataFrame], k: int, k0: int = RRF_K0) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, point_id, rank) branches."""
    every = branches[0].select("query_id", "point_id", "rank")
    for b in branches[1:]:
        every = every.unionAll(b.select("query_id", "point_id", "rank"))
    score = F.round(F.sum(1.0 / (k0 + F.col("rank"))), 6)
    return _ranked(every.groupBy("query_id", "point_id").agg(score.alias("score")), k)


def hybrid(points: DataFrame, queries: DataFrame, k: int = 30, k0: int = RRF_K0, mode: str = "bm25", texts: DataFrame | None = None) -> DataFrame:
    """Both searches fused; keywords are looked up in `texts`, the points without their vectors, if that table is at hand and spares a join."""
    return fuse([dense_topk(points, queries, k), sparse_topk(points if texts is None else texts, queries, k, mode)], k, k0)


def with_payload(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with payload columns, missing values replaced by their defaults."""
    has = set(points.columns)
    take = lambda c, d: F.coalesce(F.col(c), d).alias(c) if c in has else d.alias(c)
    empty = F.array().cast("array<string>")
    cols = [take("text", F.lit("")), F.col("doc_id").cast("string").alias("document_id"), take("page_no", F.lit(0)), take("chunk_type", F.lit("text")), take("headings", empty)]
    cols += [take("figure_type", F.lit(None).cast("string")), take("is_complex_table", F.lit(False)), take("ord", F.lit(0))]
    return hits.join(points.select("point_id", *cols), "point_id", "left")


def overlap_score(query: Column, text: Column) -> Column:
    """Default reranker: the share of the query's distinct terms that the text has."""
    q = F.array_distinct(vx.terms(query))
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, vx.terms(text))) / F.size(q), 6)).otherwise(0.0)


def rerank(candidates: DataFrame, queries: DataFrame, k: int, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The k best candidates by the scorer's value of (query, text); ties keep their order, and without a score the first k stay."""
    scored = candidates.join(queries.select("query_id", "query"), "query_id").withColumn("rerank_score", scorer(F.col("query"), F.col("text"))).drop("query")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k)


def merge_scores(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Candidates with a reranker's scores (query_id, point_id, rerank_score); those that it left out go. Queries without any score keep their first k."""
    by = Window.partitionBy("query_id")
    both = candidates.join(scores, ["query_id", "point_id"], "left").withColumn("_any", F.max(F.col("rerank_score").isNotNull()).over(by))
    kept = both.where("rerank_score is not null or not _any")
    order = by.orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return kept.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= k).drop("_any")


def refusals(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Event frames of the queries that found nothing."""
    none = queries.select("query_id").join(candidates.select("query_id").distinct(), "query_id", "left_anti")
    frames = F.array(tx.sse(F.struct(F.lit(tx.REFUSAL).alias("token"))), tx.sse(F.struct(F.array().cast(tx.SOURCES_TYPE).alias("sources"))), F.lit("data: [DONE]\n\n"))
    return none.select("query_id", F.posexplode(frames).alias("seq", "event"))


def context_blocks(ranked: DataFrame) -> DataFrame:
    """(query_id, context): the numbered chunks of each query in rank order."""
    head = F.concat(F.lit("["), "final_rank", F.lit("] Document: "), "document_id", F.lit(" | Page: "), "page_no", F.lit(" | Type: "), "chunk_type")
    section = F.when(F.size("headings") > 0, F.concat(F.lit("\n     Section: "), F.array_join("headings", " > "))).otherwise("")
    chunk = F.concat(head, section, F.lit("\n" + "-" * 40 + "\n"), F.trim("text"), F.lit("\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", chunk.alias("x")))), lambda s: s["x"]), "\n")
    return ranked.groupBy("query_id").agg(F.concat(F.lit(tx.CONTEXT_HEAD + "\n" + "=" * 70 + "\n"), body, F.lit("\n" + "=" * 70)).alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query_id, prompt) with the question under its context."""
    text = F.concat("context", F.lit("\n\nQUESTION: "), "query", F.lit("\n\nANSWER (cite every claim with [N], output SOURCES block at the end):"))
    return queries.select("query_id", "query").join(contexts, "query_id").select("query_id", text.alias("prompt"))


def _keys(answers: DataFrame) -> list[str]:
    """What names an answer: its query, and whatever else the table has beside the text."""
    return [c for c in answers.columns if c not in ("answer", "error")]


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """Sources that the answers (query_id, answer, other keys) cite, with what the cited chunk adds where they are empty (a page only where it is null).

    A source whose chunk is not there keeps what it says; excerpts are cut to 120 characters.
    """
    keys = _keys(answers)
    cited = answers.select(*keys, F.posexplode(tx.sources(F.col("answer"))).alias("seq", "s")).select(*keys, "seq", "s.*")
    chunk = ranked.select("query_id", F.col("final_rank").cast("string").alias("ref"), F.col("document_id").alias("d"), F.col("page_no").alias("p"), F.col("chunk_type").alias("c"), F.col("text").alias("e"))
    both = cited.join(chunk, ["query_id", "ref"], "left")
    pick = lambda own, other, none: F.when(tx.falsy(F.col(own)), F.coalesce(other, F.lit(none))).otherwise(F.col(own))
    excerpt = F.left(pick("excerpt", "e", ""), F.lit(120)).alias("excerpt")
    return both.select(*keys, "seq", "ref", pick("document_id", "d", "").alias("document_id"), F.coalesce("page_no", "p").alias("page_no"), pick("chunk_type", "c", "text").alias("chunk_type"), excerpt)


def events(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, other keys, seq, event): a token frame for each word, one frame of sources (perhaps of none), and the end.

    An answer whose `error` is not null broke off: its words are followed by a frame of the error instead.
    """
    keys = _keys(answers)
    error = F.col("error") if "error" in answers.columns else F.lit(None).cast("string")
    every = answers.withColumn("error", error)
    words = F.regexp_extract_all(F.regexp_replace("answer", tx.SOURCES_BLOCK, ""), F.lit(r"\S+\s*"), F.lit(0))
    tokens = every.select(*keys, F.posexplode(words).alias("seq", "w")).select(*keys, "seq", tx.sse(F.struct(F.col("w").alias("token"))).alias("event"))
    source = F.struct("ref", "document_id", "page_no", "chunk_type", "excerpt")
    cited = citations(answers.select(*keys, "answer"), ranked).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", source.alias("s")))).alias("x"))
    last = F.lit(1 << 30)
    listed = F.coalesce(F.transform("x", lambda v: v["s"]), F.array().cast(tx.SOURCES_TYPE))
    frame = F.when(F.col("error").isNotNull(), tx.sse(F.struct("error"))).otherwise(tx.sse(F.struct(listed.alias("sources"))))
    closing = every.select(*keys, "error").join(cited, keys, "left").select(*keys, last.alias("seq"), frame.alias("event"))
    done = every.select(*keys, (last + 1).alias("seq"), F.lit("data: [DONE]\n\n").alias("event"))
    return tokens.unionByName(closing).unionByName(done)


def document(points: DataFrame, doc_id: object, chunk_type: str | None = None) -> DataFrame:
    """All chunks of a document in order."""
    got = points.where(F.col("doc_id") == F.lit(doc_id))
    return (got if chunk_type is None else got.where(F.col("chunk_type") == chunk_type)).orderBy("ord")


def document_ids(points: DataFrame) -> DataFrame:
    return points.select(F.col("doc_id").cast("string").alias("doc_id")).where("doc_id <> ''").distinct().orderBy("doc_id")
