"""Text quality of pages and documents, and corpus rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from foliant.functions import text as tx


def page_quality(pages: DataFrame) -> DataFrame:
    """`pages` (doc_id, page_no, text) cleaned of soft hyphens, with counts and class."""
    t = pages.withColumn("text", tx.clean_hyphens(F.col("text")))
    return t.select("doc_id", "page_no", tx.page_class(F.col("text")).alias("page_class"), tx.ascii_alnum_count(F.col("text")).cast("long").alias("alphanum"), F.length("text").cast("long").alias("chars"))


def document_quality(pages: DataFrame, garbled_share: float = 0.30) -> DataFrame:
    """Pages by class, and needs_ocr: more than `garbled_share` of the pages that are not empty are garbled."""
    return rollup(page_quality(pages), garbled_share)


def rollup(classified: DataFrame, garbled_share: float = 0.30, *more: Column) -> DataFrame:
    """document_quality() of pages that are classified already, with `more` aggregates of them."""
    n = lambda k: F.count_if(F.col("page_class") == k)
    counts = [F.count("*").alias("pages"), n("ok").alias("ok_pages"), n("empty").alias("empty_pages"), n("garbled").alias("garbled_pages"), F.sum("alphanum").alias("alphanum_chars")]
    out = classified.groupBy("doc_id").agg(*counts, *more)
    full = F.col("pages") - F.col("empty_pages")
    return out.withColumn("needs_ocr", (full > 0) & (F.col("garbled_pages") / full > garbled_share))


def corpus_summary(results: DataFrame, wall_s: float, extrapolate_to: int = 108_000) -> DataFrame:
    """One row over parse results (success, pages, chars, elapsed_s, garbled_pages, empty_pages)."""
    ok = F.count_if("success")
    return results.agg(
        ok.alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.round(F.sum("elapsed_s"), 3).alias("cpu_s"),
        F.sum("garbled_pages").alias("garbled_pages"), F.sum("empty_pages").alias("empty_pages"), F.round(F.sum("pages") / wall_s * 60, 2).alias("pages_per_min"),
        F.round(F.sum("elapsed_s") / wall_s, 3).alias("effective_parallelism"), F.round(extrapolate_to * wall_s / F.greatest(ok, F.lit(1)) / 3600, 3).alias("extrapolated_hours"),
    )


def stratified_sample(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` documents by page count: a third from up to 20, 21 to 100, and over 100 pages each, the rest from the last; by hash within."""
    bucket = F.when(F.col("pages") <= 20, "small").when(F.col("pages") <= 100, "medium").otherwise("large")
    ranked = docs.where("pages > 0").withColumn("bucket", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(str(seed)))), "doc_id")))
    third = n // 3
    # a plain bound first, so that each task cuts its ranks before the shuffle
    return ranked.where(F.col("rank") <= max(third, n - 2 * third)).where(F.col("rank") <= F.when(F.col("bucket") == "large", n - 2 * third).otherwise(third))


def tool_summary(runs: DataFrame) -> DataFrame:
    """Extractor runs (tool, ok, seconds, chars): totals, successes and averages over the successes."""
    return runs.groupBy("tool").agg(F.round(F.sum("seconds"), 3).alias("seconds"), F.sum("chars").alias("chars"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"), F.round(F.sum(F.when(F.col("ok"), F.col("seconds"))) / F.greatest(F.count_if("ok"), F.lit(1)), 4).alias("avg_seconds"))


def usage_by_kind(usage: DataFrame) -> DataFrame:
    """Calls of a model (kind, success, tokens_in, tokens_out) by kind: how many, how many were good, and their tokens."""
    return usage.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"))


def cost_summary(usage: DataFrame, price_in: float = 0.06, price_out: float = 0.24, project_to: int = 1000) -> DataFrame:
    """Token usage (success, tokens_in, tokens_out) priced per million tokens, with averages a document and a projection."""
    cost = F.sum("tokens_in") / 1e6 * price_in + F.sum("tokens_out") / 1e6 * price_out
    ok = F.greatest(F.count_if("success"), F.lit(1))
    return usage.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if("success").alias("n_ok"), F.round(cost, 6).alias("cost"), F.round(cost / ok, 6).alias("cost_per_doc"), F.round(cost / ok * project_to, 4).alias("projected_cost"))
