"""Views: chunks of a document by order, regions of pages, and tables of a monitor.

Rendering is left to the caller; these give the rows to render, or why there are none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from foliant.functions import geometry as g

#: Most chunks of one request, and files that the monitor lists.
MOST_CHUNKS, MOST_FILES = 4, 8


def view_chunks(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, place, ord, page_no, l, t, r, b, error) of the first orders of each request (request_id, doc_id, orders).

    chunks have doc_id, ord, chunk_type, page_no and a box, documents doc_id and n_pages. Only pictures and tables with a
    box on a page that is there have no error.
    """
    asked = requests.select("request_id", "doc_id", F.posexplode(F.slice("orders", 1, MOST_CHUNKS)).alias("place", "ord"))
    there = chunks.select("doc_id", "ord", "chunk_type", F.coalesce("page_no", F.lit(1)).alias("page_no"), "l", "t", "r", "b", F.lit(True).alias("found"))
    both = asked.join(there, ["doc_id", "ord"], "left").join(documents.select("doc_id", "n_pages"), "doc_id", "left")
    kind = F.coalesce("chunk_type", F.lit("text"))
    wrong = (
        F.when(F.col("found").isNull(), "Not found in document").when(~kind.isin("picture", "table"), F.concat(F.lit("Not a picture/table (type: "), kind, F.lit(")")))
        .when(F.col("l").isNull(), "No bounding box stored").when((F.col("page_no") < 1) | (F.col("page_no") > F.col("n_pages")), F.concat(F.lit("Page "), "page_no", F.lit(" out of range")))
    )
    return both.select("request_id", "place", "ord", "page_no", "l", "t", "r", "b", F.concat(F.lit("Order "), "ord", F.lit(": "), wrong).alias("error"))


def visual_regions(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(request_id, mode, page_no, box, error) of requests (request_id, doc_id, ord, page_no, above, below).

    With an order the region is the chunk's box, grown above and below, on the page asked for or else the chunk's; without one the whole page.
    documents have doc_id, n_pages and page_height.
    """
    there = chunks.select("doc_id", "ord", F.col("page_no").alias("own"), "l", "t", "r", "b", F.lit(True).alias("found"))
    both = requests.join(there, ["doc_id", "ord"], "left").join(documents.select("doc_id", "n_pages", "page_height"), "doc_id", "left")
    by_chunk = F.col("ord").isNotNull()
    both = both.withColumn("page", F.coalesce("page_no", "own"))
    error = (
        F.when(~by_chunk & F.col("page_no").isNull(), "Either page_no or chunk_order must be provided")
        .when(by_chunk & F.col("found").isNull(), F.concat(F.lit("Chunk not found: document_id="), F.col("doc_id").cast("string"), F.lit(", order="), "ord"))
        .when(F.col("page").isNull(), F.concat(F.lit("Chunk at order "), "ord", F.lit(" has no page_no stored")))
        .when((F.col("page") < 1) | (F.col("page") > F.col("n_pages")), F.concat(F.lit("Page "), "page", F.lit(" out of range (document has "), "n_pages", F.lit(" pages)")))
        .when(by_chunk & F.col("l").isNull(), F.concat(F.lit("Chunk at order "), "ord", F.lit(" has no bounding box stored")))
    )
    good = error.isNull()
    box = F.when(good & by_chunk, g.expanded(F.col("above"), F.col("below"), F.col("page_height")))
    mode = F.when(good, F.when(by_chunk, "chunk_region").otherwise("full_page"))
    return both.select("request_id", mode.alias("mode"), F.when(good, F.col("page")).alias("page_no"), box.alias("box"), error.alias("error"))


def labelled(processes: DataFrame, labels: DataFrame) -> DataFrame:
    """Processes (pid) with their label; unknown ones have '?'."""
    return processes.join(labels.select("pid", "label"), "pid", "left").withColumn("label", F.coalesce("label", F.lit("?")))


def display_order(processes: DataFrame) -> DataFrame:
    """`place` from 1 on each host by kind of label, then by label; the two kinds that come first keep their order of pid."""
    label = F.col("label")
    kind = F.when(label == "vLLM", 0).when(label.startswith("Ollama"), 1).when(label.startswith("Docling"), 2).otherwise(3)
    w = Window.partitionBy("host").orderBy(kind, F.when(kind >= 2, label).otherwise(""), "pid")
    return processes.withColumn("place", F.row_number().over(w))


def recent_files(files: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """The newest `most` files (path, mtime); the limit is the feature."""
    return files.orderBy(F.desc("mtime"), "path").limit(most)
