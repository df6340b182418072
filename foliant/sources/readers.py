"""Sources: files, pages, results, settings, logs and state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import text as tx

#: Noise that a log reader drops.
LOG_NOISE = r"(?i)(GET /health|heartbeat|DEBUG)"


def pdf_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, length, content, doc_id) of a folder's files; an error if there are none. Only columns that are used are read."""
    got = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    got = got.dropDuplicates(["path"]).withColumn("doc_id", tx.stem(F.col("path")))
    if got.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return got


def pdf_tree(spark: SparkSession, folder: str) -> DataFrame:
    """All PDFs below a folder, in either case."""
    return pdf_files(spark, folder, "*.{pdf,PDF}", recursive=True)


def extract(files: DataFrame, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """Page texts by a parser of bytes; a file that fails has an error and no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                try:
                    rows.append((doc, parser(content), None))
                except Exception as e:
                    rows.append((doc, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page_texts", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "doc_id string, page_texts array<string>, error string")


def extract_by_tool(files: DataFrame, parsers: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """(tool, doc_id, ok, seconds, pages, chars, error): every parser over every file, each file read once; for quality.tool_summary()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                for tool, parser in parsers.items():
                    began = time.perf_counter()
                    try:
                        texts, error = parser(content), None
                    except Exception as e:
                        texts, error = [], f"{type(e).__name__}: {e}"
                    rows.append((tool, doc, error is None, time.perf_counter() - began, len(texts), sum(map(len, texts)), error))
            yield pd.DataFrame(rows, columns=["tool", "doc_id", "ok", "seconds", "pages", "chars", "error"])

    return files.select("doc_id", "content").mapInPandas(run, "tool string, doc_id string, ok boolean, seconds double, pages long, chars long, error string")


def pages_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, page_no, text) with soft hyphens removed; pages count from 1."""
    return parsed.select("doc_id", F.posexplode("page_texts").alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_no"), tx.clean_hyphens(F.col("text")).alias("text"))


def layout_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of layout documents in JSON (one a line); each takes its first place on a page."""
    docs = spark.read.schema(schema).json(path)
    parts = [docs.select("doc_id", F.posexplode_outer(k).alias("seq", "x"), F.lit(k[:-1]).alias("item_type")) for k in ("texts", "tables", "pictures")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("x is not null")
    at = F.get("x.prov", 0)
    return every.select("doc_id", "seq", "item_type", "x.label", "x.level", "x.text", at["page_no"].alias("page_no"), *[at["bbox"][k].alias(k) for k in "ltrb"])


def results(spark: SparkSession, path: str, schema: str, sources: DataFrame | None = None) -> DataFrame:
    """Parse results in JSON with pages, without broken files, and only of documents that are there."""
    got = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("pages > 0")
    return got if sources is None else got.join(sources.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")


def settings(files: DataFrame) -> DataFrame:
    """(key, value) of KEY=value lines of whole files (value), as spark.read.text(..., wholetext=True) gives them; the first line of a key counts."""
    lines = files.select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    parts = F.split("line", "=", 2)
    return kept.select("n", F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value")).groupBy("key").agg(F.min_by("value", F.struct("n", "value")).alias("value"))


def gpus(lines: DataFrame) -> DataFrame:
    """index, name and total memory of comma-separated lines; short ones are dropped."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return lines.withColumn("f", f).where(F.size("f") >= 3).select(F.col("f")[0].cast("int").alias("index"), F.col("f")[1].alias("name"), F.col("f")[2].cast("int").alias("memory_mb"))


def gpu_plan(cards: DataFrame, overhead_gb: float, embedder_gb: float) -> DataFrame:
    """Worker counts for a host's cards by the memory left on the largest."""
    top = cards.agg(F.max_by("name", "memory_mb").alias("name"), (F.max("memory_mb") / 1024).alias("gb"), F.count("*").alias("n"))
    free = F.col("gb") - overhead_gb - embedder_gb
    # By free gigabytes below the bound, layout instances, share for the vision model, concurrency, pages a minute.
    tiers = [(10, 1, 0.25, 1, 15), (25, 2, 0.30, 2, 45), (40, 4, 0.40, 3, 90), (70, 6, 0.50, 3, 140)]
    pick = lambda k, last: F.coalesce(*[F.when(free < t[0], F.lit(t[k])) for t in tiers], F.lit(last))
    n = F.greatest(F.col("n"), F.lit(1))
    none = F.col("n") == 0
    many = lambda c, cap: F.when(n > 1, F.least(c * n, F.lit(cap))).otherwise(c)
    return top.select(
        "name", F.when(none, 1).otherwise(many(pick(1, 8), 32)).alias("instances"), F.when(none, 0.0).otherwise(pick(2, 0.55)).alias("vision_share"),
        F.when(none, 1).otherwise(many(pick(3, 3), 12)).alias("concurrency"), F.when(none, 5).otherwise(pick(4, 180) * n).alias("pages_per_min"),
    )


def log_lines(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """Log lines without noise; as a stream only new files' lines arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.text(folder).where(~F.col("value").rlike(LOG_NOISE))


def tail(files: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New lines (path, line_no, value) of log files (path, content) after the remembered offsets (path, offset), and the offsets to remember.

    A file shorter than its offset was rotated and is read from its start; a last line without its end waits for the next call.
    """
    both = files.join(offsets, "path", "left").withColumn("from", F.coalesce(F.when(F.col("offset") <= F.length("content"), F.col("offset")), F.lit(0)).cast("int"))
    rest = both.withColumn("text", F.decode(F.expr("substring(content, from + 1)"), "UTF-8")).withColumn("text", F.regexp_extract("text", r"(?s)^.*\n", 0))
    lines = rest.where("text <> ''").select("path", F.posexplode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line_no", "value")).where(~F.col("value").rlike(LOG_NOISE))
    return lines, rest.select("path", (F.col("from") + F.octet_length("text")).alias("offset"))


def search_pages(spark: SparkSession, fetch: Callable[[int], list[tuple]], schema: str, most: int) -> DataFrame:
    """Hits of a remote search, page by page from 0 until there are `most` different ids (first column), an empty page or an error."""
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Pages(DataSourceReader):
        def read(self, partition: object) -> Iterator[tuple]:
            seen: set = set()
            page = 0
            while len(seen) < most:
                try:
                    hits = fetch(page)
                except Exception:
                    return
                if not hits:
                    return
                for hit in hits:
                    if hit[0] not in seen and len(seen) < most:
                        seen.add(hit[0])
                        yield hit
                page += 1

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return "foliant_search"

        def schema(self) -> str:
            return schema

        def reader(self, schema: object) -> DataSourceReader:
            return Pages()

    spark.dataSource.register(Search)
    return spark.read.format("foliant_search").load()


def layout(files: DataFrame, parser: Callable[[bytes, bool], list[tuple]], item: str, wanted: DataFrame | None = None, images: bool = True, timed: bool = False) -> DataFrame:
    """(doc_id, items, error, with `timed` also seconds) by a layout model of (bytes, with images); a file that fails, or a document of `wanted` without a file, has an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                began = time.perf_counter()
                try:
                    found, error = parser(content, images), None
                except Exception as e:
                    found, error = None, str(e)
                rows.append((doc, found, error, time.perf_counter() - began))
            yield pd.DataFrame(rows, columns=["doc_id", "items", "error", "seconds"])

    got = files.select("doc_id", "content").mapInPandas(run, f"doc_id string, items array<struct<{item}>>, error string, seconds double")
    got = got if timed else got.drop("seconds")
    if wanted is None:
        return got
    whole = wanted.select("doc_id").join(got.withColumn("there", F.lit(True)), "doc_id", "left")
    return whole.select("doc_id", "items", F.when(F.col("there").isNull(), "File not found").otherwise(F.col("error")).alias("error"), *(["seconds"] if timed else []))


def points(spark: SparkSession, path: str) -> DataFrame:
    """All points of a stored collection; nothing is cut off at a page of results."""
    return spark.read.parquet(path)


def state(spark: SparkSession, path: str, *states: str) -> DataFrame:
    got = spark.read.parquet(path)
    return got.where(F.col("state").isin(*states)) if states else got


def uploads(names: DataFrame) -> DataFrame:
    """File names that are PDFs, in any case."""
    return names.where(F.lower("name").endswith(".pdf"))


def unseen(found: DataFrame, there: DataFrame, min_mb: float = 0.0, max_mb: float = float("inf")) -> DataFrame:
    """Downloads (doc_id, size_mb) inside the size window that are not there yet, each once."""
    sized = found.where((F.col("size_mb").isNull() | (F.col("size_mb") <= max_mb)) & F.coalesce(F.col("size_mb") >= min_mb, F.lit(True)))
    return sized.dropDuplicates(["doc_id"]).join(there.select("doc_id"), "doc_id", "left_anti")


#: Characters of the piece of an id by which stems are looked up.
GRAM = 8


def find_pdf(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, path): the file of that stem, else the least path whose stem contains the id.

    For the second, the ids left over meet the stems that have their first GRAM characters (of a shorter id, all) somewhere, and are then
    looked for whole; so a stem gives at most GRAM rows a character, whatever lengths ids have.
    """
    f = files.select("path", tx.stem(F.col("path")).alias("stem"))
    exact = wanted.select("document_id").distinct().join(f, F.col("document_id") == F.col("stem"), "left").groupBy("document_id").agg(F.min("path").alias("path"))
    rest = exact.where("path is null").select("document_id")
    ids = rest.where(F.length("document_id") > 0).withColumn("gram", F.left("document_id", F.lit(GRAM)))
    lengths = ids.select(F.length("gram").alias("k"), F.lit(1).alias("one")).distinct()  # at most GRAM rows
    grams = F.transform(F.sequence(F.lit(1), F.length("stem") - F.col("k") + 1), lambda i: F.substring(F.col("stem"), i, F.col("k")))
    parts = f.withColumn("one", F.lit(1)).join(F.broadcast(lengths), "one").where(F.length("stem") >= F.col("k")).select("path", "stem", F.explode(F.array_distinct(grams)).alias("gram"))
    loose = ids.join(parts, "gram").where(F.col("stem").contains(F.col("document_id"))).groupBy("document_id").agg(F.min("path").alias("loose"))
    return exact.join(loose, "document_id", "left").select("document_id", F.coalesce("path", "loose").alias("path"))
