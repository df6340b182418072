"""The registered queries of the library, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from foliant.domain import ctes, table
from foliant.functions import geometry as g
from foliant.functions import text as tx
from foliant.functions import vectors as vx
from foliant.operators import batch as bt
from foliant.operators import chunks as ch
from foliant.operators import layout as ly
from foliant.operators import quality as ql
from foliant.operators import retrieval as rt
from foliant.operators import tables as tb
from foliant.operators import vector_index as vi
from foliant.operators import viewing as vw
from foliant.plans import models as md
from foliant.plans import pipelines as pl
from foliant.session import fresh_folder, stored
from foliant.sources import html as hm
from foliant.sources import keyword_index as ki
from foliant.sources import readers as rd
from foliant.sources import writers as wr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

NOW = 9000.0
K = 10


def register(sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (ctes(*uses) + "\n" + sql.replace("WITH ", ", ", 1) if sql.lstrip().startswith("WITH ") else ctes(*uses) + "\n" + sql) if uses else sql
        return f

    return add


# ---- retrieval -------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense"))
    p = table(spark, sf_dir, "points").join(e, "point_id", "left")
    return p.withColumn("dense", F.coalesce("dense", F.array().cast("array<float>"))).withColumn("headings", F.array(F.concat(F.lit("Part "), "lang")))


def _queries(spark: SparkSession, sf_dir: str, scoped: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    scope = F.when(F.col("query_id") % 2 == 0, F.array(F.concat(F.lit("src"), F.col("query_id") % 20), F.lit("src3"))) if scoped else F.lit(None)
    both = b.join(e, "query_id").select("query_id", "query", "qvec", scope.cast("array<string>").alias("document_ids"))
    return both.withColumn("top_k_candidates", F.lit(None).cast("int")).withColumn("top_k_final", F.lit(None).cast("int"))


_Q = """q AS (SELECT item_id AS query_id, b.text AS query, e.embedding AS qvec, {scope} AS document_ids FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""
_Q_ALL = _Q.format(scope="CAST(NULL AS VARCHAR[])")
_Q_SCOPED = _Q.format(scope="CASE WHEN item_id % 2 = 0 THEN ['src' || CAST(item_id % 20 AS VARCHAR), 'src3'] END")
_DENSE = """
dense_scores AS (SELECT q.query_id, p.point_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.qvec AS DOUBLE[])), 6) + 0.0 AS score
  FROM points p JOIN embeddings e ON e.vec_id = p.point_id, q WHERE q.document_ids IS NULL OR list_contains(q.document_ids, p.doc_id)),
dense_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM dense_scores) WHERE rank <= 10)"""
_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_SPARSE = rf"""
post AS (SELECT point_id, doc_id, term, dl, count(*) AS tf FROM (SELECT point_id, doc_id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT point_id, doc_id, {_TERMS.format("text")} AS ts FROM points)) GROUP BY ALL),
stats AS (SELECT count(*) AS n_docs, avg(len({_TERMS.format("text")})) AS avgdl FROM points),
qt AS (SELECT query_id, document_ids, qdl, term, count(*) AS qtf FROM (SELECT query_id, document_ids, len(ts) AS qdl, unnest(ts) AS term FROM (SELECT query_id, document_ids, {_TERMS.format("query")} AS ts FROM q)) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
sparse_scores AS (SELECT query_id, point_id, round(sum({{weight}}), 6) AS score FROM qt JOIN post USING (term) JOIN df USING (term), stats
  WHERE document_ids IS NULL OR list_contains(document_ids, doc_id) GROUP BY query_id, point_id),
sparse_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM sparse_scores) WHERE rank <= 10)"""
_W = "tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
_BM25 = _SPARSE.replace("{weight}", f"{_W} * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * qtf")
_TF = _SPARSE.replace("{weight}", f"{_W} * (qtf * 2.2 / (qtf + 1.2 * (0.25 + 0.75 * qdl / avgdl)))")
_FUSED = """
united AS (SELECT query_id, point_id, rank FROM dense_hits UNION ALL SELECT query_id, point_id, rank FROM sparse_hits),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (SELECT query_id, point_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM united GROUP BY ALL)) WHERE rank <= 10)"""
_RERANKED = rf"""
cand AS (SELECT f.*, p.text, p.doc_id AS document_id, p.page_no, p.chunk_type, ['Part ' || p.lang] AS headings FROM fused f JOIN points p USING (point_id)),
scored AS (SELECT cand.*, round(len(list_intersect(list_distinct({_TERMS.format("q.query")}), {_TERMS.format("cand.text")})) / len(list_distinct({_TERMS.format("q.query")})), 6) AS rerank_score FROM cand JOIN q USING (query_id)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS final_rank FROM scored) WHERE final_rank <= 5)"""
_HITS = ["query_id", "point_id", "score", "rank"]


@register(f"WITH {_Q_ALL},{_DENSE} SELECT query_id, point_id, score, rank FROM dense_hits", ("points",))
def dense_topk(spark, sf_dir):
    return rt.dense_topk(_points(spark, sf_dir), _queries(spark, sf_dir), K).select(*_HITS)


@register(f"WITH {_Q_SCOPED},{_DENSE} SELECT query_id, point_id, score, rank FROM dense_hits", ("points",))
def dense_topk_filtered(spark, sf_dir):
    return rt.dense_topk(_points(spark, sf_dir), _queries(spark, sf_dir, scoped=True), K).select(*_HITS)


@register(f"WITH {_Q_ALL},{_DENSE} SELECT query_id, point_id, score, rank FROM dense_hits WHERE score >= 0.2", ("points",))
def dense_topk_threshold(spark, sf_dir):
    return rt.dense_topk(_points(spark, sf_dir), _queries(spark, sf_dir), K, threshold=0.2).select(*_HITS)


@register(f"WITH {_Q_SCOPED},{_BM25} SELECT query_id, point_id, score, rank FROM sparse_hits", ("points",))
def sparse_topk_bm25(spark, sf_dir):
    return rt.sparse_topk(table(spark, sf_dir, "points"), _queries(spark, sf_dir, scoped=True), K).select(*_HITS)


@register(f"WITH {_Q_ALL},{_TF} SELECT query_id, point_id, score, rank FROM sparse_hits", ("points",))
def sparse_topk_tf(spark, sf_dir):
    return rt.sparse_topk(table(spark, sf_dir, "points"), _queries(spark, sf_dir), K, mode="tf_dot").select(*_HITS)


@register(f"WITH {_Q_SCOPED},{_BM25} SELECT query_id, point_id, score, rank FROM sparse_hits", ("points",))
def keyword_index_topk(spark, sf_dir):
    """The search of sparse_topk_bm25 in a stored index of two batches, the second of which replaces points of the first."""
    points, path = table(spark, sf_dir, "points"), fresh_folder(spark, "keyword-index")
    old = points.where("point_id % 10 = 1").withColumn("text", F.concat(F.lit("outdated words "), F.reverse("text")))
    ki.write_batch(points.where("point_id % 2 = 0").unionByName(old), path, 0)
    ki.write_batch(points.where("point_id % 2 = 1"), path, 1, removed=old)
    return ki.search(ki.Index(spark, path), _queries(spark, sf_dir, scoped=True), K).select(*_HITS)


def _ranked(spark, sf_dir):
    p, q = _points(spark, sf_dir), _queries(spark, sf_dir, scoped=True)
    cand = rt.with_payload(rt.hybrid(p, q, K, texts=table(spark, sf_dir, "points")), p)
    return q, cand, rt.rerank(cand, q, 5)


_CHAIN = f"WITH {_Q_SCOPED},{_DENSE},{_BM25},{_FUSED},{_RERANKED}"


@register(f"WITH {_Q_SCOPED},{_DENSE},{_BM25},{_FUSED} SELECT query_id, point_id, score, rank FROM fused", ("points",))
def hybrid_rrf(spark, sf_dir):
    return rt.hybrid(_points(spark, sf_dir), _queries(spark, sf_dir, scoped=True), K, texts=table(spark, sf_dir, "points")).select(*_HITS)


@register(f"{_CHAIN} SELECT query_id, point_id, document_id, page_no, chunk_type, rerank_score, final_rank FROM ranked", ("points",))
def rerank_topk(spark, sf_dir):
    return _ranked(spark, sf_dir)[2].select("query_id", "point_id", "document_id", "page_no", "chunk_type", "rerank_score", "final_rank")


@register(f"{_CHAIN} SELECT query_id, point_id, rank AS final_rank FROM fused WHERE rank <= 5", ("points",))
def rerank_fallback(spark, sf_dir):
    q, cand, _ = _ranked(spark, sf_dir)
    return rt.rerank(cand, q, 5, lambda query, text: F.lit(None).cast("double")).select("query_id", "point_id", "final_rank")


@register(
    f"""{_CHAIN}, got AS (SELECT query_id, point_id, rank, CASE WHEN query_id % 3 > 0 AND point_id % 2 = 0 THEN round(point_id / 1000.0, 6) END AS s FROM fused),
    seen AS (SELECT *, bool_or(s IS NOT NULL) OVER (PARTITION BY query_id) AS has FROM got)
    SELECT * FROM (SELECT query_id, point_id, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, rank) AS final_rank FROM seen WHERE s IS NOT NULL OR NOT has) WHERE final_rank <= 3""",
    ("points",),
)
def rerank_score_merge(spark, sf_dir):
    # both sides of the merge read the candidates
    cand = stored(rt.hybrid(_points(spark, sf_dir), _queries(spark, sf_dir, scoped=True), K, texts=table(spark, sf_dir, "points")), "candidates")
    scores = cand.where("query_id % 3 > 0 and point_id % 2 = 0").select("query_id", "point_id", F.round(F.col("point_id") / 1000.0, 6).alias("rerank_score"))
    return rt.merge_scores(cand, scores, 3).select("query_id", "point_id", "rerank_score", "final_rank")


@register(
    """WITH none AS (SELECT item_id AS query_id FROM benchmark WHERE item_id % 3 = 0)
    SELECT query_id, seq, event FROM none, (VALUES (0, 'data: {"token":"I cannot answer this question based on the provided documents."}' || chr(10) || chr(10)), (1, 'data: {"sources":[]}' || chr(10) || chr(10)), (2, 'data: [DONE]' || chr(10) || chr(10))) AS f(seq, event)"""
)
def refusals(spark, sf_dir):
    every = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return rt.refusals(every, every.where("query_id % 3 <> 0"))


@register(
    f"""{_CHAIN}, parts AS (SELECT query_id, final_rank, '[' || final_rank || '] Document: ' || document_id || ' | Page: ' || page_no || ' | Type: ' || chunk_type || chr(10) || '     Section: ' || array_to_string(headings, ' > ') || chr(10) || repeat('-', 40) || chr(10) || trim(text, ' ') || chr(10) AS x FROM ranked)
    SELECT query_id, 'CONTEXT CHUNKS (use these and only these to answer):' || chr(10) || repeat('=', 70) || chr(10) || string_agg(x, chr(10) ORDER BY final_rank) || chr(10) || repeat('=', 70) AS context FROM parts GROUP BY query_id""",
    ("points",),
)
def context_blocks(spark, sf_dir):
    return rt.context_blocks(_ranked(spark, sf_dir)[2])


def _answers(spark, sf_dir):
    """Every assistant turn as an answer to the question of its conversation's number; one in seven breaks off."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    block = F.when(F.col("conv_id") % 5 == 4, F.lit("\n```sources\n[{bad json]\n```")).otherwise(
        F.concat(F.lit('\n```Sources\n[{"ref": '), F.col("conv_id") % 4 + 1, F.lit(', "document_id": "'), F.when(F.col("conv_id") % 2 == 0, "").otherwise("own"), F.lit('", "page_no": '), F.when(F.col("conv_id") % 3 == 0, "null").otherwise("0"), F.lit(', "chunk_type": "", "excerpt": ""}]\n```'))
    )
    error = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("no answer after turn "), "turn"))
    return c.select(F.col("conv_id").alias("query_id"), "turn", F.concat("text", block).alias("answer"), error.alias("error"))


_CITED = """a AS (SELECT conv_id AS query_id, turn, text FROM conversations WHERE role = 'assistant'),
ci AS (SELECT a.query_id, a.turn, 0 AS seq, CAST(a.query_id % 4 + 1 AS VARCHAR) AS ref, CASE WHEN a.query_id % 2 = 0 THEN coalesce(r.document_id, '') ELSE 'own' END AS document_id, CASE WHEN a.query_id % 3 = 0 THEN r.page_no ELSE 0 END AS page_no,
  coalesce(r.chunk_type, 'text') AS chunk_type, coalesce(left(r.text, 120), '') AS excerpt FROM a LEFT JOIN ranked r ON r.query_id = a.query_id AND r.final_rank = a.query_id % 4 + 1 WHERE a.query_id % 5 <> 4)"""


@register(f"{_CHAIN}, {_CITED} SELECT * FROM ci", ("points",))
def citations_enriched(spark, sf_dir):
    q, cand, ranked = _ranked(spark, sf_dir)
    return rt.citations(_answers(spark, sf_dir).drop("error"), ranked)


@register(
    rf"""{_CHAIN}, {_CITED}, w AS (SELECT query_id, turn, regexp_extract_all(text || chr(10), '\S+\s*') AS w FROM a),
    js AS (SELECT query_id, turn, '{{"ref":' || to_json(ref) || ',"document_id":' || to_json(document_id) || ',"page_no":' || coalesce(CAST(page_no AS VARCHAR), 'null') || ',"chunk_type":' || to_json(chunk_type) || ',"excerpt":' || to_json(excerpt) || '}}' AS j FROM ci)
    SELECT query_id, turn, CAST(generate_subscripts(w, 1) - 1 AS INT) AS seq, 'data: {{"token":' || to_json(unnest(w)) || '}}' || chr(10) || chr(10) AS event FROM w
    UNION ALL SELECT a.query_id, a.turn, 1073741824, 'data: ' || CASE WHEN (a.query_id + a.turn) % 7 = 0 THEN '{{"error":"no answer after turn ' || a.turn || '"}}' ELSE '{{"sources":[' || coalesce(j, '') || ']}}' END || chr(10) || chr(10) FROM a LEFT JOIN js ON js.query_id = a.query_id AND js.turn = a.turn
    UNION ALL SELECT query_id, turn, 1073741825, 'data: [DONE]' || chr(10) || chr(10) FROM a""",
    ("points",),
)
def event_frames(spark, sf_dir):
    return rt.events(_answers(spark, sf_dir), _ranked(spark, sf_dir)[2])


@register(
    f"""{_CHAIN}, parts AS (SELECT query_id, final_rank, '[' || final_rank || '] Document: ' || document_id || ' | Page: ' || page_no || ' | Type: ' || chunk_type || chr(10) || '     Section: ' || array_to_string(headings, ' > ') || chr(10) || repeat('-', 40) || chr(10) || trim(text, ' ') || chr(10) AS x FROM ranked),
    cx AS (SELECT query_id, 'CONTEXT CHUNKS (use these and only these to answer):' || chr(10) || repeat('=', 70) || chr(10) || string_agg(x, chr(10) ORDER BY final_rank) || chr(10) || repeat('=', 70) AS context FROM parts GROUP BY query_id)
    SELECT query_id, context || chr(10) || chr(10) || 'QUESTION: ' || query || chr(10) || chr(10) || 'ANSWER (cite every claim with [N], output SOURCES block at the end):' AS prompt, 1 AS cited FROM cx JOIN q USING (query_id)""",
    ("points",),
)
def prompted_answers(spark, sf_dir):
    """The prompt of each question, and how many sources the answer to it cites."""
    q, _, ranked = _ranked(spark, sf_dir)
    p = rt.prompts(q, rt.context_blocks(ranked))
    return p.select("query_id", "prompt", F.size(tx.sources(md.generate(F.col("prompt"), md.Offline()))).alias("cited"))


@register("SELECT doc_id AS point_id, CASE WHEN text IS NULL OR text = '' THEN 0 ELSE 64 END AS dimensions, CASE WHEN text IS NULL OR trim(regexp_replace(text, '\\s', '', 'g')) = '' THEN 0 ELSE 1 END AS length FROM documents")
def embedded_points(spark, sf_dir):
    """Vectors of all texts in batches: their dimensions, and their length, which is 1."""
    v = table(spark, sf_dir, "points").select("point_id", md.embed(F.col("text"), md.Offline(), batch=64).alias("v"))
    return v.select("point_id", F.size("v").alias("dimensions"), F.round(F.sqrt(vx.dot(F.col("v"), F.col("v")))).cast("int").alias("length"))


@register("SELECT a.vec_id, 16 AS dimensions, round(list_cosine_similarity(CAST(a.embedding[1:16] AS DOUBLE[]), CAST(b.embedding[1:16] AS DOUBLE[])), 5) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_functions(spark, sf_dir):
    """Each vector, cut to 16 dimensions, against the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", vx.truncated(F.col("embedding"), 16).alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.size("v").alias("dimensions"), (F.round(vx.cosine(F.col("v"), F.col("w")), 5) + 0.0).alias("cosine"))


@register("SELECT item_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS logged FROM benchmark")
def query_log(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.short_query(F.col("text")).alias("logged"))


@register("SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND CAST(props->>'k' AS BIGINT) = 7 AND json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')")
def payload_variant_filter(spark, sf_dir):
    """A filter on a stored column, which reaches the scan, and on a key of the free payload."""
    e = table(spark, sf_dir, "events").withColumn("payload", F.try_parse_json("props"))
    return rt.free_filters(e, {"event_type": "click", "k": 7}).select("event_id", "event_type", "value")


@register("SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, CASE WHEN json_exists(props, '$.k') THEN CAST(props->>'k' AS BIGINT) % 2 = 0 END AS even FROM events")
def payload_hot_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("payload", F.try_parse_json("props"))
    return rt.with_hot_keys(e, {"k": "bigint"}).select("event_id", "k", (F.col("k") % 2 == 0).alias("even"))


@register("SELECT point_id, page_no, chunk_type, text FROM points WHERE doc_id = 'src3'", ("points",))
def document_fetch(spark, sf_dir):
    return rt.document(_points(spark, sf_dir).withColumn("ord", F.col("point_id")), "src3").select("point_id", "page_no", "chunk_type", "text")


@register("SELECT DISTINCT doc_id FROM points WHERE doc_id <> ''", ("points",))
def document_ids(spark, sf_dir):
    return rt.document_ids(_points(spark, sf_dir))


@register("SELECT count(*) AS points, count(DISTINCT doc_id) AS documents FROM points", ("points",))
def collection_stats(spark, sf_dir):
    return wr.collection_stats(table(spark, sf_dir, "points"))


@register("SELECT point_id, page_no FROM points WHERE chunk_type = 'table' AND lang = 'en'", ("points",))
def payload_filter(spark, sf_dir):
    return rt.equal_filters(_points(spark, sf_dir), {"chunk_type": "table", "lang": "en"}).select("point_id", "page_no")


@register("SELECT item_id AS query_id, CASE WHEN length(text) > 2000 THEN 'query length' WHEN item_id % 120 < 5 THEN 'top_k_candidates' WHEN item_id % 25 = 0 OR item_id % 25 > 20 THEN 'top_k_final' END AS error FROM benchmark")
def query_validation(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % 120).cast("int").alias("top_k_candidates"), (F.col("item_id") % 25).cast("int").alias("top_k_final"))
    q = q.withColumn("top_k_candidates", F.when(F.col("top_k_candidates") > 100, 100).otherwise(F.col("top_k_candidates")))
    return rt.validate(q).select("query_id", "error")


def _vectors(spark, sf_dir):
    """All vectors in cells, their centroids, and as queries those whose id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings")
    points = e.select(F.col("vec_id").alias("point_id"), F.col("label").cast("string").alias("doc_id"), F.col("embedding").alias("dense"))
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), F.lit(None).cast("array<string>").alias("document_ids"))
    centroids = vi.fit_centroids(points, 64)
    return vi.assign(points, centroids), centroids, queries


_NEAREST = """WITH s AS (SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) + 0.0 AS score FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM s) WHERE rank <= 10)"""


@register()
def ann_topk(spark, sf_dir):
    placed, centroids, queries = _vectors(spark, sf_dir)
    return vi.search(placed, centroids, queries, K, vi.probes_for(placed, centroids, queries, K)).select(*_HITS)


@register(f"{_NEAREST} SELECT query_id, point_id, score, rank FROM h")
def ann_topk_all_cells(spark, sf_dir):
    placed, centroids, queries = _vectors(spark, sf_dir)
    return vi.search(placed, centroids, queries, K, 64).select(*_HITS)


@register(f"{_NEAREST} SELECT count(DISTINCT query_id) AS n_queries, count(*) AS wanted, TRUE AS nine_tenths_found FROM h")
def ann_recall(spark, sf_dir):
    """What ann_topk finds of the exact results of all its queries."""
    placed, centroids, queries = _vectors(spark, sf_dir)
    found = vi.search(placed, centroids, queries, K, vi.probes_for(placed, centroids, queries, K))
    got = vi.recall(found, rt.dense_topk(placed, queries, K))
    return got.agg(F.count("*").alias("n_queries"), F.sum("wanted").alias("wanted"), (F.sum("hit") * 10 >= F.sum("wanted") * 9).alias("nine_tenths_found"))


# ---- layout ----------------------------------------------------------------------------------

_AREA = "(r - l) * (t - b)"
_ELIGIBLE = f"ok AS (SELECT * FROM items WHERE NOT ((r - l < 20 AND t - b < 10) OR {_AREA} < 500))"
_INTER = "(CASE WHEN least(i.r, o.r) > greatest(i.l, o.l) AND least(i.t, o.t) > greatest(i.b, o.b) THEN (least(i.r, o.r) - greatest(i.l, o.l)) * (least(i.t, o.t) - greatest(i.b, o.b)) ELSE 0 END)"
_AI, _AO = "((i.r - i.l) * (i.t - i.b))", "((o.r - o.l) * (o.t - o.b))"
_J1 = f"j1 AS (SELECT * FROM ok i WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.doc_id = i.doc_id AND o.page_no = i.page_no AND o.seq <> i.seq AND {_AO} > {_AI} AND {_AI} > 0 AND {_INTER} >= 0.8 * {_AI}))"
_J2 = f"j2 AS (SELECT * FROM j1 i WHERE NOT EXISTS (SELECT 1 FROM j1 o WHERE i.item_type = 'picture' AND o.item_type = 'table' AND o.doc_id = i.doc_id AND o.page_no = i.page_no AND {_AI} > 0 AND {_AO} > 0 AND {_INTER} >= 0.9 * {_AI} AND {_INTER} >= 0.9 * {_AO}))"
_W1 = "boxed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t DESC, seq) AS box_num FROM j2 WHERE NOT contains(lower(label), 'formula'))"
_BOX = ["doc_id", "page_no", "seq", "item_type"]
_DET = "det AS (SELECT * FROM items WHERE item_type = 'table' AND page_no % 2 = 1)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "items")


def _detected(items):
    return items.where("item_type = 'table' and page_no % 2 = 1")


@register(f"WITH {_ELIGIBLE} SELECT doc_id, page_no, seq, item_type FROM ok", ("items",))
def eligible_items(spark, sf_dir):
    return ly.eligible(_items(spark, sf_dir)).select(*_BOX)


@register(f"WITH {_ELIGIBLE}, {_J1} SELECT doc_id, page_no, seq, item_type FROM j1", ("items",))
def contained_boxes(spark, sf_dir):
    return ly.drop_contained(ly.eligible(_items(spark, sf_dir))).select(*_BOX)


@register(f"WITH {_ELIGIBLE}, {_J1}, {_J2} SELECT doc_id, page_no, seq, item_type FROM j2", ("items",))
def dedup_types(spark, sf_dir):
    return ly.drop_duplicate_pictures(ly.drop_contained(ly.eligible(_items(spark, sf_dir)))).select(*_BOX)


@register(f"WITH {_ELIGIBLE}, {_J1}, {_J2}, {_W1} SELECT doc_id, page_no, seq, box_num FROM boxed", ("items",))
def reading_order(spark, sf_dir):
    return ly.number_boxes(_items(spark, sf_dir)).select("doc_id", "page_no", "seq", "box_num")


@register(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, t DESC, seq) AS n FROM items),
    walk AS (SELECT doc_id, n, seq, CASE WHEN label = 'section_header' AND text <> '' THEN [text] ELSE CAST([] AS VARCHAR[]) END AS headings FROM o WHERE n = 1
      UNION ALL SELECT o.doc_id, o.n, o.seq, CASE WHEN label = 'section_header' AND text <> '' THEN list_concat(headings[1:level], [text]) ELSE headings END FROM walk JOIN o ON o.doc_id = walk.doc_id AND o.n = walk.n + 1)
    SELECT doc_id, seq, len(headings) AS depth, array_to_string(headings, ' > ') AS path FROM walk""",
    ("items",),
)
def heading_stack(spark, sf_dir):
    return ly.heading_stacks(_items(spark, sf_dir)).select("doc_id", "seq", F.size("headings").alias("depth"), F.array_join("headings", " > ").alias("path"))


@register("SELECT doc_id, page_no, min(l) AS l, max(t) AS t, max(r) AS r, min(b) AS b FROM items GROUP BY ALL", ("items",))
def bbox_union(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("doc_id", "page_no").agg(*ly.union_box())


@register(f"WITH {_DET}, p AS (SELECT DISTINCT doc_id, page_no FROM det), n AS (SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt FROM p) SELECT doc_id, CAST(unnest(generate_series(page_no + 1, nxt - 1)) AS INT) AS page_no FROM n WHERE nxt > page_no + 1", ("items",))
def gap_pages(spark, sf_dir):
    return ly.gap_pages(_detected(_items(spark, sf_dir)))


def _titled(items):
    return items.withColumn("text", F.when(F.col("seq") % 34 == 6, F.concat(F.lit("Table "), F.col("seq") % 7 + 1, F.lit(" "), F.col("text"))).when((F.col("label") == "section_header") & (F.col("seq") % 5 == 0), "References (continued)").otherwise(F.col("text")))


_TITLED = "tit AS (SELECT * REPLACE (CASE WHEN seq % 34 = 6 THEN 'Table ' || (seq % 7 + 1) || ' ' || text WHEN label = 'section_header' AND seq % 5 = 0 THEN 'References (continued)' ELSE text END AS text) FROM items), tdet AS (SELECT * FROM tit WHERE item_type = 'table' AND page_no % 2 = 1)"
_MISSED = r"""txt AS (SELECT *, regexp_matches(trim(text), '(?i)^TABLE\s+([IVXLCDM]+|\d+)') AS is_title FROM tit WHERE item_type = 'text'),
mk AS (SELECT *, min(CASE WHEN is_title OR (label = 'section_header' AND regexp_matches(upper(text), 'REFERENCE|CONCLUSION|APPENDIX|FIGURE')) THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM txt),
ti AS (SELECT * FROM mk WHERE is_title AND NOT EXISTS (SELECT 1 FROM tdet d WHERE d.doc_id = mk.doc_id AND d.page_no = mk.page_no AND abs(d.t - mk.t) < 50)),
missed AS (SELECT ti.doc_id, ti.page_no, ti.seq AS title_seq, trim(ti.text) AS title, min(x.l) AS l, max(x.t) AS t, max(x.r) AS r, min(x.b) AS b FROM ti JOIN txt x ON x.doc_id = ti.doc_id AND x.page_no = ti.page_no AND x.seq >= ti.seq AND (ti.stop IS NULL OR x.seq < ti.stop) GROUP BY ALL)"""


@register(f"WITH {_TITLED}, {_MISSED} SELECT * FROM missed", ("items",))
def missed_tables(spark, sf_dir):
    items = _titled(_items(spark, sf_dir))
    return ly.missed_tables(items, _detected(items))


@register(f"WITH {_TITLED} SELECT DISTINCT doc_id, page_no FROM tit t WHERE label = 'section_header' AND contains(lower(text), 'continued') AND NOT EXISTS (SELECT 1 FROM tdet d WHERE d.doc_id = t.doc_id AND d.page_no = t.page_no)", ("items",))
def continued_pages(spark, sf_dir):
    items = _titled(_items(spark, sf_dir))
    return ly.continued_pages(items, _detected(items))


@register("SELECT DISTINCT doc_id, page_no FROM items WHERE contains(lower(label), 'formula')", ("items",))
def formula_pages(spark, sf_dir):
    return ly.formula_pages(_items(spark, sf_dir))


@register(
    """WITH f AS (SELECT doc_id, page_no, seq AS fig, t AS ft, b AS fb FROM items WHERE item_type = 'picture'), x AS (SELECT * FROM items WHERE item_type = 'text' AND text <> '')
    SELECT f.doc_id, f.page_no, f.fig AS seq, trim(right(coalesce(string_agg(x.text, ' ' ORDER BY x.b, x.seq) FILTER (WHERE x.b > f.ft), ''), 300), ' ') AS above,
           trim(left(coalesce(string_agg(x.text, ' ' ORDER BY x.t DESC, x.seq) FILTER (WHERE x.t < f.fb), ''), 300), ' ') AS below
    FROM f LEFT JOIN x ON x.doc_id = f.doc_id AND x.page_no = f.page_no GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY f.doc_id, f.page_no, f.fig"),
    ("items",),
)
def figure_context(spark, sf_dir):
    return ly.figure_context(_items(spark, sf_dir))


_CANDIDATES = f"""{_TITLED}, {_MISSED}, pg AS (SELECT DISTINCT doc_id, page_no FROM tdet), nx AS (SELECT *, lead(page_no) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt FROM pg),
more AS (SELECT doc_id, CAST(unnest(generate_series(page_no + 1, nxt - 1)) AS INT) AS page_no FROM nx WHERE nxt > page_no + 1
  UNION SELECT doc_id, page_no FROM tit t WHERE label = 'section_header' AND contains(lower(text), 'continued') AND NOT EXISTS (SELECT 1 FROM tdet d WHERE d.doc_id = t.doc_id AND d.page_no = t.page_no)),
cont AS (SELECT doc_id, page_no, min(l) AS l, max(t) AS t, max(r) AS r, min(b) AS b FROM tit JOIN more USING (doc_id, page_no) WHERE item_type = 'text' GROUP BY doc_id, page_no),
cand AS (SELECT doc_id, page_no, seq, l, t, r, b, 'detected' AS source, 0 AS k FROM tdet UNION ALL SELECT doc_id, page_no, title_seq, l, t, r, b, 'missed', 1 FROM missed UNION ALL SELECT doc_id, page_no, 0, l, t, r, b, 'continuation', 2 FROM cont
  UNION ALL SELECT doc_id, page_no, seq, l, t, r, b, 'picture_table', 3 FROM tit WHERE item_type = 'picture' AND abs(r - l) * abs(t - b) >= 50000),
ids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, page_no, seq) AS n FROM cand)"""


@register(f"WITH {_CANDIDATES} SELECT doc_id, page_no, seq, l, t, r, b, source, 'table_' || n AS table_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, t DESC, n) AS place FROM ids", ("items",))
def table_candidates(spark, sf_dir):
    items = _titled(_items(spark, sf_dir))
    return ly.table_candidates(items, _detected(items))


_FIGURES = "fg AS (SELECT doc_id, page_no, 'figure' AS kind, 'figure_' || row_number() OVER (PARTITION BY doc_id ORDER BY page_no, t DESC, seq) AS id, l, t, r, b FROM items WHERE item_type = 'picture' AND l IS NOT NULL AND abs(r - l) * abs(t - b) < 50000), fp AS (SELECT DISTINCT doc_id, page_no, 'formula_page' AS kind, 'page_' || page_no AS id, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS r, CAST(NULL AS DOUBLE) AS b FROM items WHERE contains(lower(label), 'formula'))"


@register(f"WITH {_CANDIDATES}, {_FIGURES} SELECT doc_id, page_no, 'table' AS kind, 'table_' || n AS id, l, t, r, b FROM ids UNION ALL SELECT * FROM fg UNION ALL SELECT * FROM fp", ("items",))
def extract_all(spark, sf_dir):
    items = _titled(_items(spark, sf_dir))
    return ly.extract(items, _detected(items))


@register(f"WITH {_FIGURES} SELECT * FROM fg", ("items",))
def extract_figures_only(spark, sf_dir):
    items = _items(spark, sf_dir)
    return ly.extract(items, _detected(items), tables=False, formula_pages_too=False)


@register("WITH n AS (SELECT *, lead(seq) OVER w AS s2, lead(l) OVER w AS l2, lead(t) OVER w AS t2, lead(r) OVER w AS r2, lead(b) OVER w AS b2 FROM items WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, NOT (r < l2 OR l > r2 OR t < b2 OR b > t2) AS overlaps FROM n WHERE s2 IS NOT NULL", ("items",))
def label_overlaps(spark, sf_dir):
    """Whether the box of each item and that of the next overlap."""
    box = F.struct("l", "t", "r", "b")
    nxt = F.lead(box).over(Window.partitionBy("doc_id").orderBy("seq"))
    return _items(spark, sf_dir).select("doc_id", "seq", box.alias("x"), nxt.alias("y")).where("y is not null").select("doc_id", "seq", g.overlaps("x", "y").alias("overlaps"))


@register(f"WITH {_CANDIDATES} SELECT doc_id, count(*) AS n_tables, count(*) FILTER (WHERE source = 'detected') AS n_detected, count(*) FILTER (WHERE source = 'missed') AS n_missed, count(*) FILTER (WHERE source = 'continuation') AS n_continuation, count(*) FILTER (WHERE source = 'picture_table') AS n_picture_table FROM cand GROUP BY doc_id", ("items",))
def source_counts(spark, sf_dir):
    items = _titled(_items(spark, sf_dir))
    return ly.source_counts(ly.table_candidates(items, _detected(items)))


@register(
    f"""WITH nf AS (SELECT * FROM items WHERE NOT contains(lower(label), 'formula')), {_ELIGIBLE.replace('FROM items', 'FROM nf')}, {_J1}, {_J2}, {_W1}
    SELECT doc_id, page_no, coalesce(string_agg('[' || box_num || '] ' || left(text, 100), chr(10) ORDER BY box_num) FILTER (WHERE item_type = 'text' AND trim(text, ' ') <> ''), '') AS blocks FROM boxed GROUP BY doc_id, page_no""",
    ("items",),
)
def content_blocks(spark, sf_dir):
    return ly.content_blocks(_items(spark, sf_dir))


@register(
    """SELECT doc_id, seq, greatest(0, l - 70) AS crop_l, t + 70 AS crop_t, r + 70 AS crop_r, greatest(0, b - 70) AS crop_b,
    greatest(0, l - (r - l) * 0.05) AS x0, greatest(0, 792 - t - (t - b) * 0.05) AS y0, least(612, r + (r - l) * 0.05) AS x1, least(792, 792 - b + (t - b) * 0.05) AS y1, (792 - t) * 2 AS top, abs(r - l) * abs(t - b) >= 50000 AS large FROM items""",
    ("items",),
)
def box_geometry(spark, sf_dir):
    i = _items(spark, sf_dir)
    w, h = F.lit(612.0), F.lit(792.0)
    crop = [c.alias(n) for c, n in zip(g.padded(), ("crop_l", "crop_t", "crop_r", "crop_b"), strict=True)]
    return i.withColumn("q", g.image_rect(w, h)).withColumn("f", g.flip_y(h, 2.0)).select("doc_id", "seq", *crop, "q.x0", "q.y0", "q.x1", "q.y1", "f.top", g.is_table_picture().alias("large"))


# ---- chunks ----------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    return c.withColumn("headings", F.array(F.concat(F.lit("S"), "section"))).drop("section")


_SMALL = """m AS (SELECT *, CASE WHEN chunk_type = 'text' AND length(text) < 150 AND coalesce(lag(chunk_type) OVER w = 'text', FALSE) THEN 0 ELSE 1 END AS starts FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
gs AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) AS gid FROM m),
small AS (SELECT doc_id, min(ord) AS ord, arg_min(chunk_type, ord) AS chunk_type, string_agg(text, chr(10) ORDER BY ord) AS text, arg_min(page_no, ord) AS page_no, arg_min(section, ord) AS section, count(*) > 1 AS merged FROM gs GROUP BY doc_id, gid)"""


@register(f"WITH {_SMALL} SELECT doc_id, ord, chunk_type, text, page_no, 'S' || section AS heading, merged AS merged_small FROM small", ("chunks",))
def merge_small(spark, sf_dir):
    return ch.merge_small(_chunks(spark, sf_dir)).withColumn("heading", F.get("headings", 0)).drop("headings")


@register(
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n, length(text) AS size FROM chunks),
    f AS (SELECT doc_id, n, ord, 1 AS gid, size, chunk_type FROM c WHERE n = 1
      UNION ALL SELECT c.doc_id, c.n, c.ord, f.gid + CASE WHEN f.chunk_type = 'text' AND c.chunk_type = 'text' AND f.size + c.size <= 2000 THEN 0 ELSE 1 END, CASE WHEN f.chunk_type = 'text' AND c.chunk_type = 'text' AND f.size + c.size <= 2000 THEN f.size + c.size ELSE c.size END, c.chunk_type FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1)
    SELECT c.doc_id, min(c.ord) AS ord, arg_min(c.chunk_type, c.ord) AS chunk_type, string_agg(c.text, chr(10) || chr(10) ORDER BY c.ord) AS text, count(*) > 1 AS merged FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n GROUP BY c.doc_id, f.gid""",
    ("chunks",),
)
def merge_max(spark, sf_dir):
    return ch.merge_to_max(_chunks(spark, sf_dir)).select("doc_id", "ord", "chunk_type", "text", "merged")


_GROUPS = """hg AS (SELECT *, CASE WHEN chunk_type = 'text' AND coalesce(lag(chunk_type) OVER w = 'text' AND lag(ord) OVER w = ord - 1 AND lag(section) OVER w = section, FALSE) THEN 0 ELSE 1 END AS starts FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
grp AS (SELECT * FROM (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) AS grp FROM hg) WHERE chunk_type = 'text')"""


@register(f"WITH {_GROUPS} SELECT doc_id, ord, CAST(grp AS BIGINT) AS grp FROM grp", ("chunks",))
def heading_groups(spark, sf_dir):
    return ch.heading_groups(_chunks(spark, sf_dir)).select("doc_id", "ord", "grp")


@register(
    f"""WITH {_GROUPS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY ord) AS n, length(text) AS size FROM grp),
    f AS (SELECT doc_id, grp, n, 1 AS gid, size FROM c WHERE n = 1
      UNION ALL SELECT c.doc_id, c.grp, c.n, f.gid + CASE WHEN f.size < 512 AND f.size + c.size + 2 <= 2000 THEN 0 ELSE 1 END, CASE WHEN f.size < 512 AND f.size + c.size + 2 <= 2000 THEN f.size + c.size + 2 ELSE c.size END FROM f JOIN c ON c.doc_id = f.doc_id AND c.grp = f.grp AND c.n = f.n + 1)
    SELECT c.doc_id, min(c.ord) AS ord, string_agg(c.text, chr(10) || chr(10) ORDER BY c.ord) AS text, string_agg(CAST(c.ord AS VARCHAR), ',' ORDER BY c.ord) AS orders, count(*) > 1 AS merged
    FROM f JOIN c ON c.doc_id = f.doc_id AND c.grp = f.grp AND c.n = f.n GROUP BY c.doc_id, c.grp, f.gid""",
    ("chunks",),
)
def merge_target(spark, sf_dir):
    return ch.merge_to_target(_chunks(spark, sf_dir)).select("doc_id", "ord", "text", F.array_join("original_orders", ",").alias("orders"), "merged")


@register(
    f"""WITH {_GROUPS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY ord) AS n, length(text) AS size FROM grp),
    f AS (SELECT doc_id, grp, n, 1 AS gid, size FROM c WHERE n = 1
      UNION ALL SELECT c.doc_id, c.grp, c.n, f.gid + CASE WHEN f.size < 512 AND f.size + c.size + 2 <= 2000 THEN 0 ELSE 1 END, CASE WHEN f.size < 512 AND f.size + c.size + 2 <= 2000 THEN f.size + c.size + 2 ELSE c.size END FROM f JOIN c ON c.doc_id = f.doc_id AND c.grp = f.grp AND c.n = f.n + 1),
    gs AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id, grp, gid), mg AS (SELECT doc_id, count(*) AS text_after, count(*) FILTER (WHERE n > 1) AS rewritten FROM gs GROUP BY doc_id),
    b AS (SELECT doc_id, count(*) FILTER (WHERE chunk_type = 'text') AS text_before, count(*) FILTER (WHERE chunk_type <> 'text') AS non_text FROM chunks GROUP BY doc_id)
    SELECT b.doc_id, text_before, coalesce(text_after, 0) AS text_after, text_before - coalesce(text_after, 0) AS deleted, coalesce(rewritten, 0) AS rewritten, non_text FROM b LEFT JOIN mg USING (doc_id)""",
    ("chunks",),
)
def remerge_dry_run(spark, sf_dir):
    return pl.remerge_plan(_chunks(spark, sf_dir))


@register("SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, CASE WHEN seq % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE t END DESC, seq) - 1 AS ord FROM items", ("items",))
def renumber(spark, sf_dir):
    return ch.renumber(_items(spark, sf_dir).withColumn("t", F.when(F.col("seq") % 11 != 0, F.col("t")))).select("doc_id", "seq", "ord")


def _formulas(spark, sf_dir):
    b = table(spark, sf_dir, "boxes").where("label = 'formula'")
    return b.select("doc_id", "page_no", "seq", F.concat(F.lit("f"), F.col("pos") % 4).alias("formula_id"), F.when(F.col("pos") % 3 > 0, F.col("text")).alias("latex"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("("), "pos", F.lit(")"))).alias("equation_number"), (F.col("pos") % 25).cast("int").alias("after_box"), F.when(F.col("pos") % 5 == 0, "where").alias("description"))


@register(
    f"""WITH {_ELIGIBLE}, {_J1}, {_J2}, {_W1}, fm AS (SELECT doc_id, page_no, seq, 'f' || (pos % 4) AS formula_id, CASE WHEN pos % 3 > 0 THEN text END AS latex, CASE WHEN pos % 2 = 0 THEN '(' || pos || ')' END AS num, pos % 25 AS after_box, CASE WHEN pos % 5 = 0 THEN 'where' END AS description FROM boxes WHERE label = 'formula'),
    an AS (SELECT doc_id, page_no, box_num AS after_box, l, r, b AS top, coalesce(lead(t) OVER (PARTITION BY doc_id, page_no ORDER BY box_num), b - 100) AS bottom FROM boxed),
    jn AS (SELECT fm.*, an.top, an.bottom, an.l IS NOT NULL AS placed FROM fm LEFT JOIN an USING (doc_id, page_no, after_box)),
    one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, formula_id ORDER BY placed DESC, after_box, seq) AS n FROM jn)
    SELECT doc_id, page_no, seq, formula_id, placed, top AS t, bottom AS b, coalesce(description || chr(10), '') || '$$' || coalesce(latex, '') || '$$' || coalesce(' ' || num, '') AS text FROM one WHERE n = 1 AND (placed OR coalesce(latex, '') <> '')""",
    ("items",),
)
def formula_place(spark, sf_dir):
    return ch.place_formulas(ly.number_boxes(_items(spark, sf_dir)), _formulas(spark, sf_dir)).select("doc_id", "page_no", "seq", "formula_id", "placed", "t", "b", "text")


def _regions(spark, sf_dir):
    b = table(spark, sf_dir, "boxes").where("pos % 6 = 1")
    return b.select("doc_id", "page_no", "seq", (F.col("pos") % 9).cast("int").alias("start_box"), (F.col("pos") % 9 + 2).cast("int").alias("last_box"), F.concat(F.lit("R"), "pos").alias("formatted_text"))


@register(
    f"""WITH {_ELIGIBLE}, {_J1}, {_J2}, {_W1}, rg AS (SELECT doc_id, page_no, seq, pos % 9 AS lo, pos % 9 + 2 AS hi, 'R' || pos AS body FROM boxes WHERE pos % 6 = 1),
    hit AS (SELECT b.doc_id, b.page_no, b.box_num, arg_max(rg.lo, rg.seq) AS lo, arg_max(rg.body, rg.seq) AS body FROM boxed b JOIN rg ON rg.doc_id = b.doc_id AND rg.page_no = b.page_no AND b.box_num BETWEEN rg.lo AND rg.hi GROUP BY ALL)
    SELECT * FROM (SELECT b.doc_id, b.page_no, b.seq, CASE WHEN h.lo IS NULL THEN b.text WHEN b.box_num = h.lo THEN h.body END AS text FROM boxed b LEFT JOIN hit h USING (doc_id, page_no, box_num)) WHERE text IS NOT NULL""",
    ("items",),
)
def inline_regions(spark, sf_dir):
    return ch.cover_regions(ly.number_boxes(_items(spark, sf_dir)), _regions(spark, sf_dir)).select("doc_id", "page_no", "seq", "text")


@register("SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE chunk_type = 'text') AS n_text, count(*) FILTER (WHERE chunk_type = 'table') AS n_table, 0 AS n_picture, 0 AS n_formula FROM chunks GROUP BY doc_id", ("chunks",))
def chunk_counts(spark, sf_dir):
    return ch.chunk_counts(_chunks(spark, sf_dir))


@register("SELECT doc_id AS point_id, CASE WHEN doc_id % 3 = 0 THEN 'deleted' ELSE 'created' END AS change FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 5 = 0)")
def id_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"))
    return ch.id_changes(d.where("point_id % 3 = 0"), d.where("point_id % 5 = 0"))


@register("SELECT doc_id, lang AS a_label, source AS b FROM documents")
def meta_round_trip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("a_label"), "lang", F.lit("b"), "source").alias("meta"))
    back = ch.unflatten_meta(ch.flatten_meta(d))
    return back.select("doc_id", F.col("meta")["a_label"].alias("a_label"), F.col("meta")["b"].alias("b"))


@register()
def build_chunks(spark, sf_dir):
    i = _items(spark, sf_dir)
    said = i.where("item_type = 'picture'").select("doc_id", "seq", "page_no", "t", F.lit(True).alias("success"), F.lit(None).cast("string").alias("markdown"), F.lit("picture").alias("kind"), (F.col("seq") % 4 != 0).alias("relevant"), F.lit("a drawing").alias("description"), F.when(F.col("seq") % 3 > 0, "bar chart").alias("figure_type"), F.when(F.col("seq") % 5 == 0, "Fig.").alias("caption"))
    return ch.build_chunks(i, _vision(spark, sf_dir).unionByName(said), _formulas(spark, sf_dir), _regions(spark, sf_dir))


# ---- tables ----------------------------------------------------------------------------------


def _vision(spark, sf_dir):
    v = table(spark, sf_dir, "vlm").withColumn("kind", F.lit("table"))
    nothing = F.lit(None).cast("string")
    return v.select("*", F.lit(None).cast("boolean").alias("relevant"), nothing.alias("description"), nothing.alias("figure_type"), nothing.alias("caption"))


@register(
    r"""WITH p AS (SELECT doc_id, seq, [trim(x, ' ') FOR x IN string_split(markdown, chr(10)) IF starts_with(trim(x, ' '), '|')] AS bars, markdown FROM vlm),
    s AS (SELECT *, list_position([regexp_matches(x, '^\|[|:\- ]*$') AND contains(x, '-') FOR x IN bars], TRUE) AS sep FROM p)
    SELECT doc_id, seq, len(bars) AS n_lines, CASE WHEN sep > 1 THEN bars[sep - 1] END AS header, CASE WHEN sep > 0 THEN len(bars) - sep ELSE len(bars) END AS n_data,
      len(string_split(trim(bars[CASE WHEN sep > 0 THEN sep ELSE 1 END], '|'), '|')) AS col_count, CASE WHEN doc_id % 3 = 0 THEN 'Title' ELSE '' END AS before FROM s""",
    ("vlm",),
)
def table_parse(spark, sf_dir):
    p = table(spark, sf_dir, "vlm").withColumn("p", tb.parse_markdown(F.col("markdown")))
    return p.select("doc_id", "seq", F.size("p.lines").alias("n_lines"), "p.header", F.size("p.data").alias("n_data"), "p.col_count", "p.before")


_ODD = "CASE WHEN pos % 5 = 0 THEN '| one |' || chr(10) || '|---|' || chr(10) || '| 1 |' WHEN pos % 7 = 0 THEN 'no table' WHEN pos % 9 = 0 THEN '| a | b |' ELSE markdown END"


@register(f"WITH o AS (SELECT v.doc_id, v.seq, {_ODD} AS markdown FROM vlm v JOIN boxes USING (doc_id, seq)), p AS (SELECT doc_id, seq, [trim(x, ' ') FOR x IN string_split(markdown, chr(10)) IF starts_with(trim(x, ' '), '|')] AS bars FROM o) SELECT doc_id, seq FROM p WHERE len(bars) >= 2 AND len(string_split(trim(bars[1], '|'), '|')) >= 2", ("vlm",))
def real_tables(spark, sf_dir):
    odd = table(spark, sf_dir, "vlm").join(table(spark, sf_dir, "boxes").select("doc_id", "seq", "pos"), ["doc_id", "seq"]).withColumn("markdown", F.expr(_ODD))
    return odd.where(tb.is_real_table(F.col("markdown"))).select("doc_id", "seq")


@register(
    r"""WITH tp AS (SELECT *, [trim(x, ' ') FOR x IN string_split(markdown, chr(10)) IF starts_with(trim(x, ' '), '|')] AS bars FROM vlm WHERE success AND markdown <> ''),
    ts AS (SELECT *, list_position([regexp_matches(x, '^\|[|:\- ]*$') AND contains(x, '-') FOR x IN bars], TRUE) AS sep FROM tp),
    tc AS (SELECT *, CASE WHEN sep > 1 THEN bars[sep - 1] END AS head, CASE WHEN sep > 0 THEN bars[sep] END AS rule, len(string_split(trim(bars[CASE WHEN sep > 0 THEN sep ELSE 1 END], '|'), '|')) AS cc, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY t DESC, seq) AS rk FROM ts),
    pg AS (SELECT doc_id, page_no, list(cc ORDER BY rk)[1] AS fcc, list(t ORDER BY rk)[1] AS ft, list(cc ORDER BY rk)[-1] AS lcc, list(head ORDER BY rk)[-1] AS lh, list(rule ORDER BY rk)[-1] AS lr FROM tc GROUP BY doc_id, page_no),
    nx AS (SELECT *, row_number() OVER w AS n, lag(page_no) OVER w AS pp, lag(lcc) OVER w AS pcc, lag(lh) OVER w AS ph, lag(lr) OVER w AS pr FROM pg WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)),
    fx AS (SELECT *, coalesce(pp = page_no - 1 AND pcc = fcc AND fcc >= 3 AND ft >= 650, FALSE) AS fits, ph IS NOT NULL AND pr IS NOT NULL AS own FROM nx),
    ch AS (SELECT doc_id, n, page_no, CAST(NULL AS VARCHAR) AS h, CAST(NULL AS VARCHAR) AS r, CAST(NULL AS INT) AS o FROM fx WHERE n = 1
      UNION ALL SELECT fx.doc_id, fx.n, fx.page_no, CASE WHEN fits AND o IS NOT NULL THEN h WHEN fits AND own THEN ph END, CASE WHEN fits AND o IS NOT NULL THEN r WHEN fits AND own THEN pr END, CASE WHEN fits AND o IS NOT NULL THEN o WHEN fits AND own THEN pp END FROM ch JOIN fx ON fx.doc_id = ch.doc_id AND fx.n = ch.n + 1),
    dt AS (SELECT tc.*, h, r, o, [x FOR x IN bars IF NOT (regexp_matches(x, '^\|[|:\- ]*$') AND contains(x, '-'))] AS d FROM tc JOIN ch USING (doc_id, page_no)),
    cl AS (SELECT *, CASE WHEN list_max([length(trim(c, ' ')) FOR c IN string_split(trim(d[1], '|'), '|')]) <= 35 THEN d[2:] ELSE d END AS dd FROM dt)
    SELECT doc_id, page_no, seq, CASE WHEN rk = 1 AND o IS NOT NULL THEN array_to_string(list_concat(CASE WHEN doc_id % 3 = 0 THEN ['Title'] ELSE [] END, [h, r], dd), chr(10)) ELSE markdown END AS markdown, CASE WHEN rk = 1 THEN o END AS continuation_of FROM cl""",
    ("vlm",),
)
def link_tables(spark, sf_dir):
    return tb.link_pages(tb.linkable(table(spark, sf_dir, "vlm"))).select("doc_id", "page_no", "seq", "markdown", "continuation_of")


@register(
    "WITH k AS (SELECT * FROM (SELECT doc_id, page_no, t AS bt, seq FROM items WHERE item_type = 'table')) SELECT k.doc_id, k.page_no, k.seq, v.seq AS vseq FROM k JOIN vlm v ON v.doc_id = k.doc_id AND v.page_no = k.page_no AND abs(round_even(v.t, 0) - round_even(k.bt, 0)) <= 5",
    ("items", "vlm"),
)
def vision_match(spark, sf_dir):
    return tb.nearest_match(_items(spark, sf_dir).where("item_type = 'table'"), table(spark, sf_dir, "vlm"))


# ---- quality ---------------------------------------------------------------------------------

_PQ = r"""pq AS (SELECT doc_id, page_no, len(regexp_extract_all(text, '[\p{L}\p{N}]')) AS a, len(regexp_extract_all(text, '[^\s\x{00A0}\x{0085}\x{000B}\x{001C}-\x{001F}]')) AS n, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS alphanum, length(text) AS chars FROM slices),
pc AS (SELECT doc_id, page_no, CASE WHEN a < 100 THEN 'empty' WHEN a / n < 0.7 THEN 'garbled' ELSE 'ok' END AS page_class, alphanum, chars FROM pq)"""


@register(f"WITH {_PQ} SELECT * FROM pc", ("slices",))
def page_quality(spark, sf_dir):
    return ql.page_quality(table(spark, sf_dir, "slices"))


_DQ = "dq AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE page_class = 'ok') AS ok_pages, count(*) FILTER (WHERE page_class = 'empty') AS empty_pages, count(*) FILTER (WHERE page_class = 'garbled') AS garbled_pages, CAST(sum(alphanum) AS BIGINT) AS alphanum_chars FROM pc GROUP BY doc_id)"


@register(f"WITH {_PQ}, {_DQ} SELECT *, pages > empty_pages AND garbled_pages / (pages - empty_pages) > 0.3 AS needs_ocr FROM dq", ("slices",))
def doc_needs_ocr(spark, sf_dir):
    return ql.document_quality(table(spark, sf_dir, "slices")).withColumn("needs_ocr", F.coalesce("needs_ocr", F.lit(False)))


def _runs(spark, sf_dir):
    s = table(spark, sf_dir, "state")
    return s.where("state in ('complete', 'failed')").select(F.concat(F.lit("tool"), F.col("batch") % 3).alias("tool"), (F.col("state") == "complete").alias("ok"), F.col("duration").alias("seconds"), (F.col("doc_id") % 5000).alias("chars"), "pages")


def _strict(content: bytes) -> list[str]:
    if len(content) > 4000:
        raise ValueError("too long")
    return [content.decode()]


@register(
    """WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
    SELECT 'lines' AS tool, count(*) AS n_ok, 0 AS n_failed, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS pages, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS chars FROM d
    UNION ALL SELECT 'strict', count(*) FILTER (WHERE n <= 4000), count(*) FILTER (WHERE n > 4000), count(*) FILTER (WHERE n <= 4000), CAST(sum(CASE WHEN n <= 4000 THEN length(text) ELSE 0 END) AS BIGINT) FROM d"""
)
def tool_comparison(spark, sf_dir):
    """Two parsers over the bytes of every document."""
    files = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.encode("text", "UTF-8").alias("content"))
    runs = rd.extract_by_tool(files, {"lines": lambda x: x.decode().split("\n"), "strict": _strict})
    pages = runs.groupBy("tool").agg(F.sum("pages").alias("pages"))
    return ql.tool_summary(runs).join(pages, "tool").select("tool", "n_ok", "n_failed", "pages", "chars")


@register("SELECT CASE doc_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'picture' ELSE 'formula' END AS kind, count(*) AS n, count(*) FILTER (WHERE state = 'complete') AS n_ok, CAST(sum(doc_id % 900) AS BIGINT) AS tokens_in, CAST(sum(doc_id % 300) AS BIGINT) AS tokens_out FROM state GROUP BY 1", ("state",))
def usage_by_kind(spark, sf_dir):
    s = table(spark, sf_dir, "state")
    k = F.col("doc_id")
    return ql.usage_by_kind(s.select(F.when(k % 3 == 0, "table").when(k % 3 == 1, "picture").otherwise("formula").alias("kind"), (F.col("state") == "complete").alias("success"), (k % 900).alias("tokens_in"), (k % 300).alias("tokens_out")))


@register("SELECT 'tool' || (batch % 3) AS tool, round(sum(duration), 3) AS seconds, CAST(sum(doc_id % 5000) AS BIGINT) AS chars, count(*) FILTER (WHERE state = 'complete') AS n_ok, count(*) FILTER (WHERE state = 'failed') AS n_failed, round(sum(CASE WHEN state = 'complete' THEN duration END) / greatest(count(*) FILTER (WHERE state = 'complete'), 1), 4) AS avg_seconds FROM state WHERE state IN ('complete', 'failed') GROUP BY 1", ("state",))
def tool_summary(spark, sf_dir):
    return ql.tool_summary(_runs(spark, sf_dir))


@register("WITH u AS (SELECT state = 'complete' AS success, doc_id % 900 AS ti, doc_id % 300 AS tout FROM state), s AS (SELECT sum(ti) AS a, sum(tout) AS b, count(*) FILTER (WHERE success) AS n FROM u) SELECT CAST(a AS BIGINT) AS tokens_in, CAST(b AS BIGINT) AS tokens_out, n AS n_ok, round(a / 1e6 * 0.06 + b / 1e6 * 0.24, 6) AS cost, round((a / 1e6 * 0.06 + b / 1e6 * 0.24) / greatest(n, 1), 6) AS cost_per_doc, round((a / 1e6 * 0.06 + b / 1e6 * 0.24) / greatest(n, 1) * 1000, 4) AS projected_cost FROM s", ("state",))
def cost_summary(spark, sf_dir):
    s = table(spark, sf_dir, "state")
    return ql.cost_summary(s.select((F.col("state") == "complete").alias("success"), (F.col("doc_id") % 900).alias("tokens_in"), (F.col("doc_id") % 300).alias("tokens_out")))


@register("SELECT count(*) FILTER (WHERE state = 'complete') AS n_ok, count(*) FILTER (WHERE state <> 'complete') AS n_failed, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(doc_id % 5000) AS BIGINT) AS chars, round(sum(duration), 3) AS cpu_s, CAST(sum(pages % 2) AS BIGINT) AS garbled_pages, CAST(sum(pages % 3) AS BIGINT) AS empty_pages, round(sum(pages) / 50.0 * 60, 2) AS pages_per_min, round(sum(duration) / 50.0, 3) AS effective_parallelism, round(108000 * 50.0 / greatest(count(*) FILTER (WHERE state = 'complete'), 1) / 3600, 3) AS extrapolated_hours FROM state WHERE state IN ('complete', 'failed')", ("state",))
def corpus_summary(spark, sf_dir):
    s = table(spark, sf_dir, "state").where("state in ('complete', 'failed')")
    r = s.select((F.col("state") == "complete").alias("success"), "pages", (F.col("doc_id") % 5000).alias("chars"), F.col("duration").alias("elapsed_s"), (F.col("pages") % 2).alias("garbled_pages"), (F.col("pages") % 3).alias("empty_pages"))
    return ql.corpus_summary(r, 50.0)


@register("WITH b AS (SELECT doc_id, CAST(ceil(length(text) / 500.0) AS INT) AS pages FROM documents), k AS (SELECT *, CASE WHEN pages <= 20 THEN 'small' WHEN pages <= 100 THEN 'medium' ELSE 'large' END AS bucket FROM b WHERE pages > 0), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(doc_id || ':42'), doc_id) AS rank FROM k) SELECT doc_id, pages, bucket, rank FROM r WHERE rank <= CASE WHEN bucket = 'large' THEN 14 ELSE 13 END")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.ceil(F.length("text") / 500.0).cast("int").alias("pages"))
    return ql.stratified_sample(d, 40)


# ---- batches ---------------------------------------------------------------------------------


def _state(spark, sf_dir):
    return table(spark, sf_dir, "state").withColumn("batch_id", F.concat(F.lit("batch_"), "batch")).drop("batch")


def _batches(spark, sf_dir):
    return table(spark, sf_dir, "state").select(F.concat(F.lit("batch_"), "batch").alias("batch_id"), (F.lit(1000.0) + F.col("batch") * 10).alias("created_ts"), F.lit("running").alias("status")).distinct()


_COUNTS = "cn AS (SELECT batch, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'processing') AS processing, count(*) FILTER (WHERE state = 'complete') AS complete, count(*) FILTER (WHERE state = 'failed') AS failed, count(*) AS total FROM state GROUP BY batch)"
_PROGRESS = f"""{_COUNTS}, pr AS (SELECT 'batch_' || batch AS batch_id, * EXCLUDE (batch), 9000.0 - (1000.0 + batch * 10) AS el FROM cn),
prog AS (SELECT batch_id, pending, processing, complete, failed, total, round((complete + failed) / total * 100, 1) AS percent, CAST(floor(el) AS BIGINT) AS elapsed_s, round(complete / el * 60, 2) AS docs_per_min, CASE WHEN complete > 0 AND floor((pending + processing) / (complete / el * 60) * 60) > 0 THEN CAST(floor((pending + processing) / (complete / el * 60) * 60) AS BIGINT) END AS eta_s, pending + processing = 0 AS is_complete FROM pr)"""


@register(f"WITH {_COUNTS} SELECT 'batch_' || batch AS batch_id, * EXCLUDE (batch) FROM cn", ("state",))
def state_counts(spark, sf_dir):
    return bt.counts(_state(spark, sf_dir))


@register(f"WITH {_PROGRESS} SELECT * FROM prog", ("state",))
def batch_progress(spark, sf_dir):
    return bt.progress(_state(spark, sf_dir), _batches(spark, sf_dir), NOW)


@register("SELECT 'batch_' || batch AS batch_id, count(nullif(duration, 0)) AS n, round(min(nullif(duration, 0)), 4) AS min_s, round(max(nullif(duration, 0)), 4) AS max_s, round(avg(nullif(duration, 0)), 4) AS avg_s, round(sum(nullif(duration, 0)), 4) AS sum_s, min(start_ts) AS first_start, max(end_ts) AS last_end, round(max(end_ts) - min(start_ts), 4) AS wall_s, CAST(sum(pages) AS BIGINT) AS total_pages, round(min(CASE WHEN pages > 0 AND duration > 0 THEN duration / pages END), 4) AS min_s_page, round(max(CASE WHEN pages > 0 AND duration > 0 THEN duration / pages END), 4) AS max_s_page, round(avg(CASE WHEN pages > 0 AND duration > 0 THEN duration / pages END), 4) AS avg_s_page FROM state WHERE state = 'complete' GROUP BY batch", ("state",))
def timing_summary(spark, sf_dir):
    return bt.timing_summary(_state(spark, sf_dir))


@register("SELECT 'batch_' || batch AS batch_id, doc_id, 5000.0 - start_ts AS age_s FROM state WHERE state = 'processing' AND 5000.0 - start_ts > 600", ("state",))
def stale_docs(spark, sf_dir):
    return bt.stale(_state(spark, sf_dir), 5000.0)


@register("SELECT 'batch_' || batch AS batch_id, doc_id, CASE WHEN state = 'processing' AND 5000.0 - start_ts > 600 THEN 'pending' ELSE state END AS state FROM state", ("state",))
def recover_stale(spark, sf_dir):
    return bt.recover_stale(_state(spark, sf_dir), 5000.0).select("batch_id", "doc_id", "state")


@register("SELECT 'batch_' || batch AS batch_id, doc_id, CASE WHEN state = 'failed' THEN 'pending' ELSE state END AS state, CASE WHEN state <> 'failed' THEN error END AS error FROM state", ("state",))
def retry_failed(spark, sf_dir):
    return bt.retry_failed(_state(spark, sf_dir)).select("batch_id", "doc_id", "state", "error")


@register("SELECT 'batch_' || batch AS batch_id, n, doc_id, CASE WHEN length(e) > 60 THEN left(e, 57) || '...' ELSE e END AS error FROM (SELECT batch, doc_id, coalesce(error, 'Unknown error') AS e, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS n FROM state WHERE state = 'failed') WHERE n <= 20", ("state",))
def failed_report(spark, sf_dir):
    return bt.failed_report(_state(spark, sf_dir))


_DUR = "CASE WHEN {0} IS NULL THEN 'N/A' WHEN {0} >= 3600 THEN CAST({0} // 3600 AS VARCHAR) || 'h ' || CAST({0} % 3600 // 60 AS VARCHAR) || 'm ' || CAST({0} % 60 AS VARCHAR) || 's' WHEN {0} >= 60 THEN CAST({0} // 60 AS VARCHAR) || 'm ' || CAST({0} % 60 AS VARCHAR) || 's' ELSE CAST({0} AS VARCHAR) || 's' END"


@register(f"WITH {_PROGRESS} SELECT batch_id, total, percent, '[' || repeat('█', CAST(floor(40 * percent / 100) AS INT)) || repeat('░', 40 - CAST(floor(40 * percent / 100) AS INT)) || ']' AS bar, {_DUR.format('elapsed_s')} AS elapsed, {_DUR.format('eta_s')} AS eta FROM prog", ("state",))
def batch_list(spark, sf_dir):
    return bt.batch_list(_batches(spark, sf_dir), _state(spark, sf_dir), NOW)


@register("SELECT 'batch_' || batch AS service, count(*) AS n, round(sum(duration), 3) AS total_ms, round(avg(duration), 4) AS avg_ms, count(*) FILTER (WHERE state <> 'failed') AS n_healthy, bool_and(state <> 'failed') AS all_healthy FROM state GROUP BY batch", ("state",))
def service_stats(spark, sf_dir):
    return bt.service_stats(_state(spark, sf_dir).select(F.col("batch_id").alias("service"), F.col("duration").alias("ms"), (F.col("state") != "failed").alias("healthy")))


@register("SELECT doc_id, CASE WHEN state = 'complete' THEN CAST(floor(sum(pages) OVER (PARTITION BY batch) / count(*) FILTER (WHERE state = 'complete') OVER (PARTITION BY batch)) AS BIGINT) END AS avg_ms FROM state", ("state",))
def batch_average(spark, sf_dir):
    s = _state(spark, sf_dir).select("batch_id", "doc_id", F.col("pages").alias("ms"), (F.col("state") == "complete").alias("success"))
    return bt.batch_average(s).select("doc_id", "avg_ms")


@register("SELECT doc_id, CAST((row_number() OVER (PARTITION BY batch ORDER BY doc_id) - 1) % 8 AS INT) AS instance FROM state", ("state",))
def round_robin(spark, sf_dir):
    return bt.round_robin(_state(spark, sf_dir).select("batch_id", "doc_id"), 8).select("doc_id", F.col("instance").cast("int").alias("instance"))


@register("SELECT doc_id, state = 'failed' AND NOT coalesce(contains(error, 'CUDA out of memory'), FALSE) AS retryable FROM state", ("state",))
def retry_policy(spark, sf_dir):
    s = table(spark, sf_dir, "state")
    return s.select("doc_id", ((F.col("state") == "failed") & tx.retryable(F.col("error"), F.lit(0))).alias("retryable"))


# ---- text functions --------------------------------------------------------------------------


@register(r"SELECT doc_id, md5(replace(replace(replace(text, ' th', chr(173) || ' t' || chr(65534) || 'h'), chr(173), ''), chr(65534), '')) AS clean, length(text) AS chars, 'batch_' || strftime(TIMESTAMP '2024-01-02 03:04:05' + to_seconds(doc_id), '%Y%m%d_%H%M%S') AS batch_id, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS short FROM documents")
def text_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ts = F.timestamp_seconds(F.lit(1704164645) + F.col("doc_id"))
    soft = F.replace("text", F.lit(" th"), F.lit("\u00ad t\ufffeh"))
    return d.select("doc_id", F.md5(tx.clean_hyphens(soft).cast("binary")).alias("clean"), F.length("text").alias("chars"), tx.batch_id(ts).alias("batch_id"), tx.short_error(F.col("text")).alias("short"))


@register("SELECT event_id, json_valid(CASE WHEN event_id % 4 = 0 THEN 'x{' || props ELSE props END) AS parsed, CASE WHEN value < 30 THEN 2.0 WHEN value < 100 THEN 1.5 WHEN value < 200 THEN 1.0 ELSE 0.75 END::DOUBLE AS scale FROM events")
def event_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.try_parse_json(F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("x{"), "props")).otherwise(F.col("props"))).isNotNull().alias("parsed"), g.image_scale(F.col("value")).cast("double").alias("scale"))


# ---- views, states and formats ---------------------------------------------------------------


@register("SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, seq) AS place FROM vlm", ("vlm",))
def vision_order(spark, sf_dir):
    return tb.in_page_order(table(spark, sf_dir, "vlm")).select("doc_id", "seq", "place")


@register("SELECT doc_id, seq FROM vlm WHERE seq % 3 = 1", ("vlm",))
def extra_tables(spark, sf_dir):
    v = table(spark, sf_dir, "vlm").withColumn("success", F.when(F.col("seq") % 3 > 0, F.col("seq") % 3 == 1))
    return tb.successful(v).select("doc_id", "seq")


@register("WITH v AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, seq) AS place FROM vlm), s AS (SELECT doc_id, 's' || (seq % 4) AS source, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, seq) AS place FROM items WHERE item_type = 'picture') SELECT v.doc_id, v.seq, v.place, s.source FROM v LEFT JOIN s USING (doc_id, place)", ("vlm", "items"))
def source_match(spark, sf_dir):
    s = _items(spark, sf_dir).where("item_type = 'picture'").withColumn("source", F.concat(F.lit("s"), F.col("seq") % 4))
    return tb.match_sources(table(spark, sf_dir, "vlm"), s).select("doc_id", "seq", "place", "source")


@register("SELECT doc_id, page_no, seq, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY CASE WHEN pos % 4 = 0 THEN 0 ELSE pos % 25 END, seq) AS place FROM boxes WHERE label = 'formula'", ("boxes",))
def formula_order(spark, sf_dir):
    f = _formulas(spark, sf_dir).withColumn("after_box", F.when(F.col("formula_id") != "f0", F.col("after_box")))
    return ch.lone_formulas(f).select("doc_id", "page_no", "seq", "place")


def _view(spark, sf_dir):
    i = _items(spark, sf_dir)
    c = i.select("doc_id", F.col("seq").alias("ord"), F.col("item_type").alias("chunk_type"), "page_no", F.when(F.col("seq") % 7 > 0, F.col("l")).alias("l"), "t", "r", "b")
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(2).alias("n_pages"), F.lit(792.0).alias("page_height"))
    return c, d


@register(
    """WITH rq AS (SELECT doc_id, generate_subscripts(o, 1) - 1 AS place, unnest(o) AS ord FROM (SELECT doc_id, [4, doc_id % 60, 24, 100000] AS o FROM documents)),
    c AS (SELECT doc_id, seq AS ord, item_type, page_no, CASE WHEN seq % 7 > 0 THEN l END AS l, t, r, b FROM items)
    SELECT doc_id AS request_id, place, ord, page_no, l, 'Order ' || ord || ': ' || CASE WHEN item_type IS NULL THEN 'Not found in document' WHEN item_type NOT IN ('picture', 'table') THEN 'Not a picture/table (type: ' || item_type || ')' WHEN l IS NULL THEN 'No bounding box stored' WHEN page_no > 2 THEN 'Page ' || page_no || ' out of range' END AS error
    FROM rq LEFT JOIN c USING (doc_id, ord)""",
    ("items",),
)
def chunk_view(spark, sf_dir):
    c, d = _view(spark, sf_dir)
    q = d.select(F.col("doc_id").alias("request_id"), "doc_id", F.array(F.lit(4), (F.col("doc_id") % 60).cast("int"), F.lit(24), F.lit(100000), F.lit(5)).alias("orders"))
    return vw.view_chunks(q, c, d).select("request_id", "place", "ord", "page_no", "l", "error")


@register(
    """WITH rq AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id % 60 END AS ord, CASE WHEN doc_id % 5 = 0 THEN doc_id % 4 END AS asked FROM documents),
    c AS (SELECT doc_id, seq AS ord, page_no, CASE WHEN seq % 7 > 0 THEN l END AS l, t, r, b, TRUE AS found FROM items),
    j AS (SELECT rq.*, c.*  EXCLUDE (doc_id, ord, page_no), coalesce(asked, c.page_no) AS page FROM rq LEFT JOIN c ON c.doc_id = rq.doc_id AND c.ord = rq.ord),
    e AS (SELECT *, CASE WHEN ord IS NULL AND asked IS NULL THEN 'Either page_no or chunk_order must be provided' WHEN ord IS NOT NULL AND found IS NULL THEN 'Chunk not found: document_id=' || doc_id || ', order=' || ord
      WHEN page < 1 OR page > 2 THEN 'Page ' || page || ' out of range (document has 2 pages)' WHEN ord IS NOT NULL AND l IS NULL THEN 'Chunk at order ' || ord || ' has no bounding box stored' END AS error FROM j)
    SELECT doc_id AS request_id, CASE WHEN error IS NULL THEN CASE WHEN ord IS NULL THEN 'full_page' ELSE 'chunk_region' END END AS mode, CASE WHEN error IS NULL THEN page END AS page_no, CASE WHEN error IS NULL AND ord IS NOT NULL THEN least(792, t + 100) END AS top, CASE WHEN error IS NULL AND ord IS NOT NULL THEN greatest(0, b - 50) END AS bottom, error FROM e""",
    ("items",),
)
def visual_regions(spark, sf_dir):
    c, d = _view(spark, sf_dir)
    k = F.col("doc_id")
    q = d.select(k.alias("request_id"), "doc_id", F.when(k % 3 > 0, (k % 60).cast("int")).alias("ord"), F.when(k % 5 == 0, (k % 4).cast("int")).alias("page_no"), F.lit(100.0).alias("above"), F.lit(50.0).alias("below"))
    return vw.visual_regions(q, c, d).select("request_id", "mode", "page_no", F.col("box.t").alias("top"), F.col("box.b").alias("bottom"), "error")


@register('SELECT doc_id, ord AS "order", chunk_type AS type, page_no FROM chunks', ("chunks",))
def storage_rows(spark, sf_dir):
    return wr.to_storage(_chunks(spark, sf_dir)).select("doc_id", "order", "type", "page_no")


@register(
    f"WITH {_SMALL} SELECT c.doc_id, count(*) FILTER (WHERE c.chunk_type = 'text') AS text_before, count(*) FILTER (WHERE c.chunk_type <> 'text') AS non_text, count(*) FILTER (WHERE s.ord IS NULL) AS deleted, 0 AS created, count(*) FILTER (WHERE c.chunk_type = 'text') - count(*) FILTER (WHERE s.ord IS NULL) AS text_after FROM chunks c LEFT JOIN small s ON s.doc_id = c.doc_id AND s.ord = c.ord GROUP BY c.doc_id",
    ("chunks",),
)
def merge_stats(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    key = F.concat_ws("|", "doc_id", "ord").alias("point_id")
    return ch.merge_stats(c.select("*", key), ch.merge_small(c).select("*", key))


_WHO = "CASE user_id % 5 WHEN 0 THEN 'vLLM' WHEN 1 THEN 'Ollama a' WHEN 2 THEN 'Docling ' || (user_id % 90) WHEN 3 THEN 'other' END"


@register(
    f"WITH p AS (SELECT event_id AS pid, event_type AS host, coalesce({_WHO}, '?') AS label, CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k FROM events) SELECT pid, host, label, row_number() OVER (PARTITION BY host ORDER BY k, CASE WHEN k >= 2 THEN label ELSE '' END, pid) AS place FROM p"
)
def process_view(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = e.select(F.col("event_id").alias("pid"), F.expr(_WHO).alias("label")).where("label is not null")
    return vw.display_order(vw.labelled(e.select(F.col("event_id").alias("pid"), F.col("event_type").alias("host")), names)).select("pid", "host", "label", "place")


@register("SELECT event_id AS path, value AS mtime FROM events ORDER BY value DESC, event_id LIMIT 8")
def recent_files(spark, sf_dir):
    return vw.recent_files(table(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("value").alias("mtime")))


@register(
    """WITH j AS (SELECT user_id AS job_id, event_id AS ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status FROM events)
    SELECT job_id, arg_max(status, ts) AS status, arg_max('r' || ts, ts) AS result, min(ts) AS created FROM j GROUP BY job_id"""
)
def job_status(spark, sf_dir):
    status = F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ts"), status.alias("status"), F.concat(F.lit("r"), "event_id").alias("result"), F.lit(None).cast("string").alias("error"))
    return bt.jobs(e).select("job_id", "status", "result", "created")


@register("SELECT 'batch_' || batch AS batch_id, doc_id, coalesce(error, 'Unknown error') AS error FROM state WHERE state = 'failed'", ("state",))
def document_errors(spark, sf_dir):
    return bt.errors_of(_state(spark, sf_dir))


@register("SELECT doc_id, error IS NULL AS success FROM state", ("state",))
def success_flags(spark, sf_dir):
    return bt.succeeded(_state(spark, sf_dir)).select("doc_id", "success")


@register("SELECT 'batch_' || batch AS batch_id, doc_id, duration FROM state WHERE batch = 3 AND doc_id = (SELECT min(doc_id) FROM state WHERE batch = 3 AND state = 'complete' AND end_ts > 1200) AND end_ts + 604800 > 606000", ("state",))
def document_result(spark, sf_dir):
    state = _state(spark, sf_dir)
    wanted = state.where("batch_id = 'batch_3' and state = 'complete' and end_ts > 1200").agg(F.min("doc_id")).first()[0]
    return bt.result_of(state, "batch_3", wanted, 606000.0).select("batch_id", "doc_id", "duration")


@register(
    """SELECT 'batch_' || batch AS batch_id, doc_id, CASE WHEN state = 'pending' AND doc_id % 2 = 0 THEN 'processing' WHEN state = 'processing' AND doc_id % 3 = 0 THEN 'complete' WHEN state = 'processing' AND doc_id % 3 = 1 THEN 'failed' ELSE state END AS state,
    CASE WHEN state = 'pending' AND doc_id % 2 = 0 THEN 9000.0 ELSE start_ts END AS start_ts, CASE WHEN state = 'processing' AND doc_id % 3 < 2 THEN 9500.0 ELSE end_ts END AS end_ts,
    CASE WHEN state = 'processing' AND doc_id % 3 = 0 THEN round(9500.0 - start_ts, 2) ELSE duration END AS duration, CASE WHEN state = 'processing' AND doc_id % 3 = 1 THEN 'broken' ELSE error END AS error FROM state""",
    ("state",),
)
def state_moves(spark, sf_dir):
    s = _state(spark, sf_dir)
    pick = lambda state, k, rest: s.where((F.col("state") == state) & (F.col("doc_id") % k == rest))
    out = bt.mark_processing(s, pick("pending", 2, 0), 9000.0)
    out = bt.mark_failed(bt.mark_complete(out, pick("processing", 3, 0), 9500.0), pick("processing", 3, 1), 9500.0, "broken")
    return out.select("batch_id", "doc_id", "state", "start_ts", "end_ts", "duration", "error")


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id % 2 = 0").select(F.concat(F.lit("/in/"), "event_id", F.lit(".pdf")).alias("path"))


@register("SELECT 'batch_' || batch AS batch_id, doc_id, '/in/' || doc_id || '.pdf' AS path FROM state WHERE doc_id % 2 = 0 AND (state = 'pending' OR state = 'processing' AND 5000.0 - start_ts > 600)", ("state",))
def resume_batch(spark, sf_dir):
    return bt.resume(_state(spark, sf_dir), _paths(spark, sf_dir), 5000.0).select("batch_id", F.col("doc_id").cast("long").alias("doc_id"), "path")


@register("SELECT 'batch_' || batch AS batch_id, doc_id FROM state WHERE state = 'pending' AND doc_id % 2 = 1", ("state",))
def pending_without_path(spark, sf_dir):
    return bt.without_path(_state(spark, sf_dir), _paths(spark, sf_dir)).select("batch_id", F.col("doc_id").cast("long").alias("doc_id"))


@register("SELECT 'b' AS batch_id, CAST(event_id AS VARCHAR) AS doc_id, 'pending' AS state FROM events WHERE event_id % 2 = 0")
def submit_batch(spark, sf_dir):
    return bt.submit("b", _paths(spark, sf_dir)).select("batch_id", "doc_id", "state")


@register("SELECT DISTINCT 'batch_' || batch AS batch_id, CASE WHEN batch = 2 THEN 'paused' ELSE 'running' END AS status FROM state", ("state",))
def pause_batch(spark, sf_dir):
    return bt.pause(_batches(spark, sf_dir), "batch_2").select("batch_id", "status")


@register("SELECT doc_id, n_chars / 1000.0 AS size_mb FROM documents WHERE n_chars / 1000.0 BETWEEN 0.5 AND 4 AND doc_id % 3 > 0")
def unseen_downloads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("size_mb"))
    return rd.unseen(d.unionAll(d), d.where("doc_id % 3 = 0"), 0.5, 4.0)


@register(
    """WITH w AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'q' || doc_id || '_' END AS document_id FROM documents),
    f AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE 'x_q' || doc_id || '_end' END AS stem FROM documents WHERE doc_id % 3 > 0)
    SELECT document_id, coalesce(min('/p/' || stem || '.pdf') FILTER (WHERE stem = document_id), min('/p/' || stem || '.pdf')) AS path FROM w LEFT JOIN f ON contains(stem, document_id) GROUP BY document_id"""
)
def pdf_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    wanted = d.select(F.when(even, F.concat(F.lit("d"), "doc_id")).otherwise(F.concat(F.lit("q"), "doc_id", F.lit("_"))).alias("document_id"))
    files = d.where("doc_id % 3 > 0").select(F.when(even, F.concat(F.lit("/p/d"), "doc_id", F.lit(".pdf"))).otherwise(F.concat(F.lit("/p/x_q"), "doc_id", F.lit("_end.pdf"))).alias("path"))
    return rd.find_pdf(wanted, files)


@register(f"WITH {_Q_ALL},{_BM25.split('qt AS')[0].rstrip().rstrip(',')} SELECT point_id, count(*) AS n_terms, CAST(sum(CAST(round({_W} * 1000000) AS BIGINT)) AS BIGINT) AS millionths FROM post, stats GROUP BY point_id", ("points",))
def sparse_vectors(spark, sf_dir):
    v = rt.sparse_vectors(table(spark, sf_dir, "points"))
    millionths = F.aggregate(F.map_values("sparse"), F.lit(0).cast("long"), lambda a, x: a + F.round(x * 1000000).cast("long"))
    return v.select("point_id", F.size("sparse").alias("n_terms"), millionths.alias("millionths"))


@register(
    f"""{_CHAIN}, q2 AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[^ \n\t]+')) AS w FROM q),
    s2 AS (SELECT cand.query_id, point_id, rank, len(list_intersect(w, regexp_extract_all(lower(text), '[^ \n\t]+'))) / greatest(1, len(w)) AS x FROM cand JOIN q2 USING (query_id))
    SELECT * FROM (SELECT query_id, point_id, round(x, 6) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, rank) AS final_rank FROM s2) WHERE final_rank <= 5""",
    ("points",),
)
def rerank_model(spark, sf_dir):
    q, cand, _ = _ranked(spark, sf_dir)
    return rt.rerank(cand, q, 5, md.rerank_scorer(md.Offline())).select("query_id", "point_id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


@register(
    f"""{_CHAIN} SELECT query_id, point_id, rank, document_id, page_no, chunk_type, CASE WHEN point_id % 4 = 0 THEN 'chart' END AS figure_type, CASE WHEN point_id % 5 = 0 THEN FALSE ELSE point_id % 3 = 0 END AS is_complex_table,
    CASE WHEN point_id % 7 = 0 THEN 0 ELSE CAST(point_id % 100 AS INT) END AS ord FROM cand""",
    ("points",),
)
def hit_payload(spark, sf_dir):
    """Hits with payload columns that some points lack."""
    k = F.col("point_id")
    p = _points(spark, sf_dir).withColumns({"figure_type": F.when(k % 4 == 0, "chart"), "is_complex_table": F.when(k % 5 > 0, k % 3 == 0), "ord": F.when(k % 7 > 0, (k % 100).cast("int"))})
    hits = rt.with_payload(rt.hybrid(p, _queries(spark, sf_dir, scoped=True), K), p)
    return hits.select("query_id", "point_id", "rank", "document_id", "page_no", "chunk_type", "figure_type", "is_complex_table", "ord")


@register("SELECT point_id, page_no, text FROM points WHERE doc_id = (SELECT min(doc_id) FROM points WHERE chunk_type = 'table') AND chunk_type = 'table'", ("points",))
def document_tables(spark, sf_dir):
    points = _points(spark, sf_dir).withColumn("ord", F.col("point_id"))
    return rt.document(points, points.where("chunk_type = 'table'").agg(F.min("doc_id")).first()[0], "table").select("point_id", "page_no", "text")


_UP = "CAST(floor(abs(value) * 1000) AS BIGINT)"


@register(
    f"""SELECT event_id, CASE WHEN {_UP} < 60 THEN {_UP} || 's' WHEN {_UP} < 3600 THEN printf('%dm%02ds', {_UP} // 60, {_UP} % 60) WHEN {_UP} < 86400 THEN printf('%dh%02dm', {_UP} // 3600, {_UP} % 3600 // 60) ELSE printf('%dd%02dh', {_UP} // 86400, {_UP} % 86400 // 3600) END AS up,
    CASE WHEN event_id % 3 = 0 THEN 'p4_f' || event_id ELSE 'f' || event_id END AS formula, CASE WHEN event_id % 2 = 0 THEN 'word' || event_id END AS delta, CASE WHEN event_id % 2 = 0 THEN 7 END AS value, CASE WHEN event_id % 2 = 1 THEN 'invalid JSON' END AS error,
    CASE WHEN event_id % 4 = 0 THEN 'u' || event_id WHEN event_id % 4 = 1 THEN 'o' END AS link FROM events"""
)
def format_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    line = F.when(k % 2 == 0, F.concat(F.lit('data: {"choices":[{"delta":{"content":"word'), k, F.lit('"}}]}'))).otherwise("data: [DONE]")
    said = F.when(k % 2 == 0, "Here: ```json\n{\"a\": 7}\n```").otherwise("{a: broken")
    parsed = tx.model_json(said, "a INT")
    pdf = F.when(k % 4 == 0, F.concat(F.lit("u"), k)).otherwise("")
    original = F.when(k % 4 == 1, "o").otherwise("")
    kind = F.when(k % 4 == 3, "text/html").otherwise("application/pdf")
    downloads = F.array(F.struct(F.lit("image/png").alias("mimetype"), F.struct(F.lit("i").alias("pdf"), F.lit("i").alias("original")).alias("links")), F.struct(kind.alias("mimetype"), F.struct(pdf.alias("pdf"), original.alias("original")).alias("links")))
    return e.select(
        "event_id", tx.uptime(F.abs("value") * 1000).alias("up"), tx.formula_id(F.when(k % 3 > 0, F.concat(F.lit("f"), k)), F.lit(4), k).alias("formula"), tx.stream_delta(line).alias("delta"),
        parsed["value"]["a"].alias("value"), parsed["error"].alias("error"), tx.first_pdf_link(downloads).alias("link"),
    )


_WEB = r"""WITH w AS (SELECT page_id, replace(regexp_replace(html, '(?s)<!--.*?-->|<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>', '', 'g'), chr(10), ' ') AS x FROM pages),
v AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(replace(x, '<br>', chr(10)), '<h1>', chr(30) || chr(31), 'g'), '</?(html|body|div|article|p|h1)( [^>]*)?>', chr(30), 'g'), '<[^>]*>', '', 'g'), chr(30)) AS a FROM w),
u AS (SELECT page_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM v),
z AS (SELECT page_id, i, starts_with(x, chr(31)) AS head, regexp_replace(replace(replace(trim(regexp_replace(regexp_replace(ltrim(x, chr(31)), '[ 	]+', ' ', 'g'), ' ?
 ?', chr(10), 'g'), ' ' || chr(10)), '&quot;', '"'), '&copy;', '©'), '&amp;?', '&', 'g') AS text FROM u),
it AS (SELECT page_id AS doc_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS seq, CASE WHEN head THEN 'section_header' ELSE 'text' END AS label, text FROM z WHERE text <> '')"""


@register(f"{_WEB} SELECT doc_id, seq, 'text' AS item_type, label, 0 AS level, text FROM it")
def html_items(spark, sf_dir):
    return hm.html_items(table(spark, sf_dir, "pages")).select("doc_id", "seq", "item_type", "label", "level", "text")


@register(
    f"""{_WEB}, hd AS (SELECT *, last_value(CASE WHEN label = 'section_header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS heading, CASE WHEN seq > 0 AND length(text) < 150 THEN 0 ELSE 1 END AS starts FROM it),
    gs AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY seq) AS gid FROM hd)
    SELECT doc_id, min(seq) AS ord, string_agg(text, chr(10) ORDER BY seq) AS text, coalesce(min_by(coalesce(heading, ''), seq), '') AS heading FROM gs GROUP BY doc_id, gid"""
)
def html_chunks(spark, sf_dir):
    return pl.web_chunks(table(spark, sf_dir, "pages")).select("doc_id", "ord", "text", F.array_join("headings", " > ").alias("heading"))


@register(
    f"""WITH {_ELIGIBLE}, {_J1}, {_J2}, od AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_no, t DESC, seq) AS n FROM ok),
    walk AS (SELECT doc_id, n, seq, CASE WHEN label = 'section_header' AND text <> '' THEN [text] ELSE CAST([] AS VARCHAR[]) END AS headings FROM od WHERE n = 1
      UNION ALL SELECT od.doc_id, od.n, od.seq, CASE WHEN label = 'section_header' AND text <> '' THEN list_concat(headings[1:level], [text]) ELSE headings END FROM walk JOIN od ON od.doc_id = walk.doc_id AND od.n = walk.n + 1),
    bx AS (SELECT j2.*, array_to_string(headings, ' > ') AS path FROM j2 LEFT JOIN walk ON walk.doc_id = j2.doc_id AND walk.seq = j2.seq WHERE NOT contains(lower(label), 'formula')),
    fl AS (SELECT doc_id, seq, page_no, t, item_type AS chunk_type, CASE item_type WHEN 'table' THEN '[Table]' WHEN 'picture' THEN '[Figure]' ELSE text END AS text, path FROM bx WHERE item_type <> 'text' OR trim(text, ' ') <> ''),
    rn AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page_no, t DESC, seq) - 1 AS INT) AS ord FROM fl),
    mk AS (SELECT *, CASE WHEN chunk_type = 'text' AND length(text) < 150 AND coalesce(lag(chunk_type) OVER w = 'text', FALSE) THEN 0 ELSE 1 END AS starts FROM rn WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    gp AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY ord) AS gid FROM mk)
    SELECT doc_id, min(ord) AS ord, arg_min(chunk_type, ord) AS chunk_type, string_agg(text, chr(10) ORDER BY ord) AS text, arg_min(page_no, ord) AS page_no, arg_min(path, ord) AS path FROM gp GROUP BY doc_id, gid""",
    ("items",),
)
def quick_chunks(spark, sf_dir):
    return pl.quick(_items(spark, sf_dir)).select("doc_id", "ord", "chunk_type", "text", "page_no", F.array_join("headings", " > ").alias("path"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval with rank fusion and reranking for a batch of questions."""
    return rerank_topk(spark, sf_dir)
