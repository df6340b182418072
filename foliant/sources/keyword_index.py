"""A stored keyword index: postings by term in levels of impact, so that a search reads only the levels that can matter.

`write_batch` stores the postings of a batch of points as Parquet, by bucket of their term. A posting's level is its share of the
greatest weight that a term can have in a text of average length; postings of one term and level are rows of at most about BLOCK, and a small
table holds for each of them the greatest tf and the least length. `search` first reads the best levels of each query's terms, which bounds
the score that the last of the k best must have, and then those whose greatest weight, with that of the query's other terms, reaches
that bound. So its rows and scores are those of the search over texts.

Bounds are taken from tf and length under the statistics of the moment, so batches that add or remove points change no postings that
are there. A removed point is a row that hides its postings of earlier batches, with its counts taken back. A batch that is written again replaces itself.

Defined cases: points whose text is null or has no terms count as documents and have no postings; rows that repeat a
point_id in a batch are postings of one point; an index without points finds nothing; terms that no point has are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from foliant.functions import vectors as vx
from foliant.operators import retrieval as rt
from foliant.session import exists, stored

#: Postings of one stored row, on average at most.
BLOCK = 512
LEVELS, BUCKETS = 16, 16
#: Scores are rounded to 6 digits, so bounds give way by as much.
SLACK = 2e-6


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_batch(points: DataFrame, path: str, batch: int, removed: DataFrame | None = None) -> None:
    """Stores the points (point_id, doc_id, text) of a batch under its number, which is greater than those before.

    `removed` are points (point_id, doc_id, text) of earlier batches, as they were stored, that are gone or come again in this batch.
    """
    spark, part = points.sparkSession, lambda name: f"{path}/{name}/batch={batch}"
    # texts are cut into terms once; all that is stored comes from their counts
    counts = stored(rt.counted(points, rt.repeated_ids(points)), "counts")
    stats = _lengths(counts, 1)
    if removed is not None:
        gone = stored(rt.counted(removed, rt.repeated_ids(removed)), "counts")
        stats = stats.unionByName(_lengths(gone, -1))
        gone.select("point_id").distinct().write.mode("overwrite").parquet(part("removed"))
    stats.coalesce(1).write.mode("overwrite").parquet(part("stats"))
    mean = spark.read.parquet(part("stats")).agg(F.try_divide(F.sum("dl"), F.sum("n_dl"))).first()[0] or 1.0
    share = rt._weight(F.col("tf"), F.col("dl"), F.lit(max(float(mean), 1.0))) / (rt.K1 + 1)
    p = rt.exploded(counts).withColumn("level", F.least(F.floor(share * LEVELS), F.lit(LEVELS - 1)).cast("int"))
    sizes = p.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    sizes.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(part("levels"))
    sizes = spark.read.schema("term string, level int, n long, bucket int").parquet(part("levels"))
    terms = sizes.select("bucket", "term", F.col("n").alias("df"))
    if removed is not None:
        terms = terms.unionByName(rt.exploded(gone).groupBy("term").agg((-F.count("*")).alias("df")).select(_bucket(F.col("term")).alias("bucket"), "term", "df"))
    terms.groupBy("bucket", "term").agg(F.sum("df").alias("df")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(part("terms"))
    # a hot term's level is cut into rows by a hash of the point, so no task gathers it
    cuts = rt.small(sizes.where(F.col("n") > BLOCK).select("term", "level", F.ceil(F.col("n") / BLOCK).alias("cuts")))
    cut = p.join(cuts, ["term", "level"], "left").withColumn("cut", F.pmod(F.xxhash64("point_id"), F.coalesce("cuts", F.lit(1))).cast("int"))
    rows = cut.groupBy("term", "level", "cut").agg(F.collect_list(F.struct("point_id", "doc_id", F.col("tf").cast("int").alias("tf"), "dl")).alias("postings"))
    rows.drop("cut").withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "level").write.mode("overwrite").partitionBy("bucket").parquet(part("postings"))


def _lengths(counts: DataFrame, sign: int) -> DataFrame:
    """(n, n_dl, dl) of counted points: rows, those with a text, and the sum of their lengths, times `sign`."""
    n, texts = F.col("rows"), F.when(F.col("dl").isNotNull(), F.col("rows"))
    return counts.agg(*[(sign * F.coalesce(F.sum(x), F.lit(0))).alias(name) for name, x in (("n", n), ("n_dl", texts), ("dl", n * F.col("dl")))])


class Index:
    """A stored index, whose ids are of the given types, as tables; what a search asks of it is read then."""

    def __init__(self, spark: SparkSession, path: str, point_id: str = "bigint", doc_id: str = "string"):
        table = lambda name, schema: spark.read.schema(f"{schema}, batch int").parquet(f"{path}/{name}")
        self.stats = table("stats", "n long, n_dl long, dl long")
        self.terms = table("terms", "term string, df long, bucket int")
        self.levels = table("levels", "term string, level int, n long, max_tf long, min_dl int, bucket int")
        self.postings = table("postings", f"term string, level int, postings array<struct<point_id: {point_id}, doc_id: {doc_id}, tf: int, dl: int>>, bucket int")
        there = exists(spark, f"{path}/removed")
        self.removed = table("removed", f"point_id {point_id}").groupBy("point_id").agg(F.max("batch").alias("until")) if there else None


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, document_ids, term, qtf)"""
    t = queries.select("query_id", "document_ids", F.explode(vx.terms(F.col("query"))).alias("term"))
    return t.groupBy("query_id", "document_ids", "term").agg(F.count("*").alias("qtf"))


def asked_levels(index: Index, queries: DataFrame) -> DataFrame:
    """A row for each level of each term of each query: its postings (n), and the greatest score that one of them (bound), one of
    its term (most), and a point with this posting (reach) can have."""
    asked = query_terms(queries).withColumn("bucket", _bucket(F.col("term")))
    one = F.broadcast(index.stats.agg(F.sum("n").alias("n_docs"), F.try_divide(F.sum("dl"), F.sum("n_dl")).alias("avgdl")).withColumn("one", F.lit(1)))
    words = rt.small(asked.select("bucket", "term").distinct())
    df = index.terms.join(words, ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
    sizes = index.levels.join(words, ["bucket", "term"], "left_semi").groupBy("bucket", "term", "level").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_dl").alias("min_dl"))
    rows = asked.join(df, ["bucket", "term"]).join(sizes, ["bucket", "term"]).withColumn("one", F.lit(1)).join(one, "one").drop("one")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")
    rows = rows.withColumn("bound", rt._weight(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")) * idf)
    by_term = Window.partitionBy("query_id", "term")
    most = rows.withColumn("most", F.max("bound").over(by_term))
    first = F.row_number().over(by_term.orderBy("level")) == 1
    total = F.sum(F.when(F.col("nth"), F.col("most"))).over(Window.partitionBy("query_id"))
    return most.withColumn("nth", first).withColumn("reach", F.col("bound") + total - F.col("most")).drop("nth")


def _scores(index: Index, levels: DataFrame) -> DataFrame:
    """(query_id, point_id, score): what the postings of `levels` give to points in a query's scope."""
    wanted = rt.small(levels.select("bucket", "term", "level").distinct())
    # a row of postings is read once for all queries that ask for it
    rows = index.postings.join(wanted, ["bucket", "term", "level"], "left_semi").select("term", "level", "batch", F.explode("postings").alias("x")).select("term", "level", "batch", "x.*")
    if index.removed is not None:
        rows = rows.join(index.removed, "point_id", "left").where("until is null or batch >= until").drop("until")
    hits = rows.join(levels.select("query_id", "document_ids", "term", "level", "qtf", "df", "n_docs", "avgdl"), ["term", "level"]).where(rt.in_scope(F.col("document_ids"), F.col("doc_id")))
    w = rt._weight(F.col("tf"), F.col("dl"), F.col("avgdl")) * F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")
    return hits.groupBy("query_id", "point_id").agg(F.round(F.sum(w), 6).alias("score"))


def needed_levels(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """asked_levels(), with `needed`: whether a point with a posting of the level can be among a query's k best."""
    levels = stored(asked_levels(index, queries), "levels")
    before = F.sum("n").over(Window.partitionBy("query_id", "term").orderBy(F.desc("bound"), "level").rowsBetween(Window.unboundedPreceding, -1))
    first = levels.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k)
    last = rt._ranked(_scores(index, first), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    return levels.join(last, "query_id", "left").withColumn("needed", F.col("least").isNull() | (F.col("reach") >= F.col("least") - SLACK)).drop("least")


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, point_id, score, rank): the rows of retrieval.sparse_topk() over the stored points, with fewer postings read."""
    needed = needed_levels(index, queries, k).where("needed")
    # two steps ask for the levels, and the first search behind them is made once
    return rt._ranked(_scores(index, stored(needed, "levels")), k)
