"""Whole plans: retrieval from question to cited answer, ingestion from items to points, and re-merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from foliant.operators import chunks as ch
from foliant.operators import retrieval as rt
from foliant.plans import models as md
from foliant.session import stored
from foliant.sources import html, readers


def retrieve(points: DataFrame, queries: DataFrame, models: md.Models | None = None, k: int = 30, final: int = 5) -> dict[str, DataFrame]:
    """Candidates, ranked chunks, prompts, answers, citations, event frames and refusals of a batch of queries.

    What several outputs read (a few rows a query) is persisted; unpersist the candidates and ranked chunks when done.
    """
    models = models or md.Offline()
    good = rt.validate(queries).where("error is null")
    candidates = rt.with_payload(rt.hybrid(points, good, k), points).persist()
    ranked = rt.rerank(candidates, good, final).persist()
    prompt = rt.prompts(good, rt.context_blocks(ranked))
    answers = prompt.select("query_id", md.generate(F.col("prompt"), models).alias("answer"))
    return {"candidates": candidates, "ranked": ranked, "prompts": prompt, "answers": answers, "citations": rt.citations(answers, ranked), "events": rt.events(answers, ranked), "refusals": rt.refusals(good, candidates)}


def point_id(collection: str) -> Column:
    """Deterministic id, so that ingesting a document again replaces its points."""
    return F.sha2(F.concat_ws("|", F.lit(collection), F.col("doc_id").cast("string"), F.col("ord").cast("string")), 256)


def ingest(items: DataFrame, vlm: DataFrame, formulas: DataFrame, regions: DataFrame, collection: str, models: md.Models | None = None) -> DataFrame:
    """Points of whole documents: chunks, small ones merged, with vectors; rows whose vector failed are not stored."""
    built = ch.merge_small(ch.build_chunks(items, vlm, formulas, regions))
    out = built.withColumn("dense", md.embed(F.col("text"), models or md.Offline())).where(F.size("dense") > 0)
    return out.select(F.lit(collection).alias("collection"), point_id(collection).alias("point_id"), "doc_id", "ord", "chunk_type", "text", "page_no", "headings", "dense")


def quick(items: DataFrame, vlm: DataFrame | None = None) -> DataFrame:
    """Chunks from layout alone: no vision results (unless there are some of tables), formulas or regions, no vectors and no batch state; any error may be tried again by the caller."""
    page = items.select("doc_id", "page_no", "seq").limit(0)
    none = items.select("doc_id", "page_no", "seq", "t").limit(0).selectExpr("*", "'table' AS kind", "false AS success", "'' AS markdown", "false AS relevant", "'' AS description", "'' AS figure_type", "'' AS caption")
    formulas = page.selectExpr("*", "'' AS formula_id", "'' AS latex", "'' AS equation_number", "0 AS after_box", "'' AS description")
    regions = page.selectExpr("*", "0 AS start_box", "0 AS last_box", "'' AS formatted_text")
    return ch.merge_small(ch.build_chunks(items, none if vlm is None else vlm, formulas, regions))


def process(files: DataFrame, parser: Callable[[bytes, bool], list[tuple]], item: str, collection: str, models: md.Models | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, results) of files (doc_id, content) from layout to vectors, where a document that fails is a row and not the end of the run.

    A result says whether a document is wholly stored, what went wrong first, how many items, chunks and points it has, and the seconds that its layout and
    its vectors took. Both models are asked once: what they gave is persisted, and goes with unpersist() of `results.held`.
    """
    laid = readers.layout(files, parser, item, timed=True).persist()
    items = laid.where("error is null").select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.*")
    built = quick(items).withColumn("embedded", md.timed_embed(F.col("text"), models or md.Offline())).persist()
    points = built.withColumn("dense", F.col("embedded.vector")).where(F.size("dense") > 0)
    points = points.select(F.lit(collection).alias("collection"), point_id(collection).alias("point_id"), "doc_id", "ord", "chunk_type", "text", "page_no", "headings", "dense")
    count = built.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if(F.size("embedded.vector") > 0).alias("points"), F.sum("embedded.seconds").alias("embedding_s"))
    left = F.col("chunks") - F.col("points")
    both = laid.select("doc_id", "error", F.size("items").alias("items"), F.col("seconds").alias("layout_s")).join(count, "doc_id", "left").na.fill(0, ["items", "chunks", "points", "layout_s", "embedding_s"])
    error = F.coalesce("error", F.when(F.col("items") <= 0, "no items").when(left > 0, F.concat(left, F.lit(" chunks without a vector"))))
    results = both.select("doc_id", error.isNull().alias("success"), error.alias("error"), F.greatest("items", F.lit(0)).alias("items"), "chunks", "points", "layout_s", "embedding_s", (F.col("layout_s") + F.col("embedding_s")).alias("total_s"))
    results.held = [laid, built]
    return points, results


def web_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of raw web pages (page_id, html), with their tables as they stand there.

    The pages are read once: their items are written to a folder under spark.checkpoint.dir, from which the steps of layout go on.
    """
    items = stored(html.html_items(pages), "web-items")
    return quick(items, html.table_results(items))


def remerge(points: DataFrame, collection: str, models: md.Models | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged points and the changed ids; write the first before deleting by the second."""
    merged = ch.merge_to_target(points).withColumn("chunk_type", F.lit("text")).withColumn("dense", md.embed(F.col("text"), models or md.Offline()))
    new = merged.select(F.lit(collection).alias("collection"), point_id(collection).alias("point_id"), "doc_id", "ord", "chunk_type", "text", "page_no", "headings", "dense")
    every = new.unionByName(points.where("chunk_type <> 'text'").select(*new.columns))
    return every, ch.id_changes(points, every)


def remerge_plan(points: DataFrame) -> DataFrame:
    """What remerge() would do to each document, without vectors or writes: text chunks before and after, those that go into another (deleted), chunks that grow (rewritten), and those of other types."""
    merged = ch.merge_to_target(points).groupBy("doc_id").agg(F.count("*").alias("text_after"), F.count_if("merged").alias("rewritten"))
    now = points.groupBy("doc_id").agg(F.count_if(F.col("chunk_type") == "text").alias("text_before"), F.count_if(F.col("chunk_type") != "text").alias("non_text"))
    both = now.join(merged, "doc_id", "left").na.fill(0, ["text_after", "rewritten"])
    return both.select("doc_id", "text_before", "text_after", (F.col("text_before") - F.col("text_after")).alias("deleted"), "rewritten", "non_text")
