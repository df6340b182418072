"""Sorts documents by what their extracted text is good for, before anything dear is done with them.

    python -m jobs.text_triage DOCUMENTS OUTPUT [--config FILE]

Reads a Parquet table of documents (doc_id, text, lang, source), cuts each text into pages, classifies the pages, and writes one row a
document to Parquet folders by route and language:

* `text`: every page that is not empty can be read; go on with chunking
* `partial`: some pages are garbled, but no more than the share that the config allows; `ocr_pages` names them
* `ocr`: more are, so the whole document goes to optical character recognition
* `empty`: no page has enough letters and digits

Running it again replaces the output by the same rows. Rows of one doc_id are one document, whose pages count together; those without
an id are left out and counted in the log; a null or empty text has no pages and its route is `empty`.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.operators import quality
from jobs.common import config, log, started

SCHEMA = "doc_id long, source string, pages long, ok_pages long, empty_pages long, garbled_pages long, alphanum_chars long, ocr_pages string, route string, lang string"


def pages(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, page_no, text): the texts in pieces of `size` characters, numbered from 1."""
    cut = documents.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).alias("at", "text"))
    return cut.select("doc_id", (F.col("at") + 1).alias("page_no"), "text")


def triage(documents: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """One row a document, with its route."""
    known = documents.where("doc_id is not null")
    bad = F.collect_list(F.when(F.col("page_class") == "garbled", F.col("page_no")))
    judged = quality.rollup(quality.page_quality(pages(known, settings["page_chars"])), settings["garbled_share"], F.array_join(F.sort_array(bad), ",").alias("ocr_pages"))
    counts = ["pages", "ok_pages", "empty_pages", "garbled_pages", "alphanum_chars"]
    # documents without a page have no class, but a row
    one = known.groupBy("doc_id").agg(F.min("source").alias("source"), F.min("lang").alias("lang"))
    out = one.join(judged, "doc_id", "left").na.fill(0, counts).na.fill("", ["ocr_pages"])
    route = F.when(F.col("pages") == F.col("empty_pages"), "empty").when(F.col("needs_ocr"), "ocr").when(F.col("garbled_pages") > 0, "partial").otherwise("text")
    return out.select("doc_id", "source", *counts, "ocr_pages", route.alias("route"), "lang")


def read_back(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def run(spark: SparkSession, documents: str, output: str, settings: dict[str, Any]) -> DataFrame:
    """Writes the routes of the table at `documents` to `output`, and returns what is there then."""
    table = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    log.info("text_triage reads %d rows, %d of them without an id, from %s", table.count(), table.where("doc_id is null").count(), documents)
    # folders by route and language, each in as many files as its size asks for
    triage(table, settings).hint("rebalance", "route", "lang").write.mode("overwrite").partitionBy("route", "lang").parquet(output)
    done = read_back(spark, output)
    for row in done.groupBy("route").agg(F.count("*").alias("n"), F.sum("pages").alias("pages")).orderBy("route").collect():
        log.info("text_triage wrote %d documents of %d pages with route %s to %s", row["n"], row["pages"], row["route"], output)
    return done


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("documents")
    args.add_argument("output")
    args.add_argument("--config")
    got = args.parse_args()
    started()
    spark = SparkSession.builder.appName("text_triage").getOrCreate()
    try:
        run(spark, got.documents, got.output, config("text_triage", got.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
