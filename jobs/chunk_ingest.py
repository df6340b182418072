"""Keeps a collection of search chunks up to date with a folder of documents that grows.

    python -m jobs.chunk_ingest DOCUMENTS OUTPUT CHECKPOINT [--config FILE]

Streams the Parquet files at DOCUMENTS (doc_id, text, lang, source) that no earlier run has taken, builds chunks of each document's
lines, joins small ones, and writes them with their ids and term counts to OUTPUT, in a folder a batch and in that by bucket of the document.
Then it stops; the next run takes what has come since. CHECKPOINT holds Spark's record of the files taken.

A batch that runs again after a failure has the same files and replaces its own folder, so nothing is there twice. A document that comes
again in a later batch replaces its earlier self for readers of read_back(), also where its text is now null and it has no chunks. Of rows of one
doc_id in one batch the one with the greatest text counts; rows without an id are left out and counted in the log.
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import vectors as vx
from foliant.operators import chunks as ch
from foliant.plans import pipelines
from foliant.session import exists
from foliant.sources import writers
from jobs.common import config, log, started, whole_path

COLUMNS = "collection string, point_id string, doc_id long, ord int, chunk_type string, text string, page_no int, lang string, n_chars long, n_terms long"
#: The folders' own columns come last when they are read.
SCHEMA = f"{COLUMNS}, batch long, bucket int"


def latest(documents: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source), one row an id."""
    return documents.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("text", "lang", "source")).alias("x")).select("doc_id", "x.*")


def chunks(documents: DataFrame, settings: dict[str, Any]) -> DataFrame:
    """The chunks of `documents`, one row an id, and for each document without any a row whose `ord` is null."""
    lines = documents.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.trim("text") != "")
    rows = lines.select(
        "doc_id", "ord", F.when(F.trim("text").rlike(r"^\|.*\|$"), "table").otherwise("text").alias("chunk_type"), "text",
        (F.floor(F.col("ord") / settings["lines_per_page"]) + 1).cast("int").alias("page_no"), F.array("source", "lang").alias("headings"),
    )
    merged = ch.merge_small(rows, settings["min_chunk_chars"])
    made = merged.select("doc_id", "ord", "chunk_type", "text", "page_no", F.get("headings", 1).alias("lang"))
    none = documents.where(~F.coalesce(F.exists(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(False)))
    every = made.unionByName(none.select("doc_id", "lang", *[F.lit(None).cast(t).alias(c) for c, t in (("ord", "int"), ("chunk_type", "string"), ("text", "string"), ("page_no", "int"))]))
    name = F.lit(settings["collection"])
    return every.select(
        name.alias("collection"), pipelines.point_id(settings["collection"]).alias("point_id"), "doc_id", "ord", "chunk_type", "text", "page_no", "lang",
        F.length("text").cast("long").alias("n_chars"), F.size(vx.terms(F.col("text"))).cast("long").alias("n_terms"),
    )


def read_back(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of each document's latest batch."""
    if not exists(spark, output):
        return spark.createDataFrame([], COLUMNS)
    every = spark.read.schema(SCHEMA).parquet(output)
    newest = every.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["doc_id", "batch"], "left_semi").where("ord is not null").select(*[c.split()[0] for c in COLUMNS.split(", ")])


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict[str, Any]) -> DataFrame:
    """Takes the files at `documents` that are new, waits until their batches are written, and returns what a reader finds then."""
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema

    def batch(rows: DataFrame, number: int) -> None:
        folder = f"{output}/batch={number}"
        made = chunks(latest(rows), settings).withColumn("bucket", writers.bucket_of(F.col("doc_id"), settings["buckets"]))
        made.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        wrote = rows.sparkSession.read.schema(f"{COLUMNS}, bucket int").parquet(folder).agg(F.count("ord").alias("chunks"), F.count_distinct("doc_id").alias("documents")).first()
        given = rows.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
        log.info("chunk_ingest read %d new rows, %d of them without an id, and wrote %d chunks of %d documents to %s", given["n"], given["nameless"], wrote["chunks"], wrote["documents"], folder)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(whole_path(documents))
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("chunk_ingest took all that was new at %s", documents)
    return read_back(spark, output)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    args.add_argument("documents")
    args.add_argument("output")
    args.add_argument("checkpoint")
    args.add_argument("--config")
    got = args.parse_args()
    started()
    spark = SparkSession.builder.appName("chunk_ingest").getOrCreate()
    try:
        run(spark, got.documents, got.output, got.checkpoint, config("chunk_ingest", got.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
