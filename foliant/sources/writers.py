"""Sinks: collections of points, result files, state and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Buckets of a stored collection; all rows of a document are in one.
BUCKETS = 64


def create_collection(spark: SparkSession, name: str, schema: str) -> None:
    """A table partitioned by document hash, if it is not there."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}, bucket INT) USING parquet PARTITIONED BY (bucket)")


def store_bucketed(points: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The points as a bucketed table at `path`, sorted by document; tables of as many buckets join on doc_id without a shuffle."""
    files = points.repartition(buckets, "doc_id")
    sort = [c for c in ("doc_id", "ord") if c in points.columns]
    files.write.mode("overwrite").format("parquet").bucketBy(buckets, "doc_id").sortBy(*sort).option("path", path).saveAsTable(name)
    return points.sparkSession.table(name)


def drop_collection(spark: SparkSession, name: str) -> bool:
    """True if there was one."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def bucket_of(doc_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(buckets)).cast("int")


def _touched(documents: DataFrame, buckets: int) -> list[int]:
    """The buckets of some documents, at most `buckets` numbers."""
    return [r[0] for r in documents.select(bucket_of(F.col("doc_id"), buckets)).distinct().collect()]


def upsert(new: DataFrame, old: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of all buckets that `new` has documents in: those of `old` with the documents of `new` replaced by their rows in `new`.

    Rows without a vector are not stored. Write them with write_points(..., touched=new); other buckets are neither read (where `old` was
    stored by it) nor written.
    """
    new = new.where(F.size("dense") > 0)
    number = F.col("bucket") if "bucket" in old.columns else bucket_of(F.col("doc_id"), buckets)
    near = old.where(number.isin(_touched(new, buckets)))
    return near.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def write_points(points: DataFrame, path: str, buckets: int = BUCKETS, touched: DataFrame | None = None) -> None:
    """Replaces the buckets of the documents `touched` (doc_id; all buckets if it is None) by the rows that `points` has for them.

    A bucket that gets no rows is removed, so deleted documents are gone. Hot buckets are split over files.
    """
    spark = points.sparkSession
    out = points.withColumn("bucket", bucket_of(F.col("doc_id"), buckets))
    numbers = list(range(buckets)) if touched is None else _touched(touched, buckets)
    out = out.where(F.col("bucket").isin(numbers))
    there = {r[0] for r in out.select("bucket").distinct().collect()}
    out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for k in set(numbers) - there:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={k}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def collection_stats(points: DataFrame) -> DataFrame:
    """One row: stored points and their documents."""
    return points.agg(F.count("*").alias("points"), F.count_distinct("doc_id").alias("documents"))


def to_storage(chunks: DataFrame) -> DataFrame:
    """Chunks as they are stored: chunk_type is named type, ord order and meta metadata."""
    names = {"chunk_type": "type", "ord": "order", "meta": "metadata"}
    return chunks.withColumnsRenamed({k: v for k, v in names.items() if k in chunks.columns})


def delete_document(points: DataFrame, doc_id: object) -> tuple[DataFrame, DataFrame]:
    """The rows left, and a one-row count of those deleted."""
    hit = F.col("doc_id") == F.lit(doc_id)
    return points.where(~hit | hit.isNull()), points.where(hit).agg(F.count("*").alias("deleted"))


def delete_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("point_id"), "point_id", "left_anti")


def result_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One nested row a document: its chunks in order, counts by type and the document's fields."""
    kinds = ["text", "table", "picture", "formula"]
    cols = [c for c in ("ord", "chunk_type", "text", "page_no", "headings") if c in chunks.columns]
    stats = F.struct(F.count("*").alias("total"), *[F.count_if(F.col("chunk_type") == k).alias(k) for k in kinds]).alias("stats")
    nested = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("chunks"), stats)
    return documents.join(nested, "doc_id", "left")


def write_results(results: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """One JSON line a document, in folders by bucket of the document."""
    results.withColumn("bucket", bucket_of(F.col("doc_id"), buckets)).write.mode("overwrite").partitionBy("bucket").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_run(summary: DataFrame, documents: DataFrame, path: str) -> None:
    """Run metadata, and the sorted ids of documents that need OCR and that failed."""
    summary.write.mode("overwrite").json(f"{path}/run_meta")
    ids = lambda c: documents.where(c).select(F.col("doc_id").cast("string").alias("value")).orderBy("value")
    ids("needs_ocr").write.mode("overwrite").text(f"{path}/needs_ocr")
    ids("not success").write.mode("overwrite").text(f"{path}/failed")


def write_text_by_tool(texts: DataFrame, path: str) -> None:
    """Texts (tool, doc_id, text) as JSON lines in a folder a tool."""
    texts.select("tool", "doc_id", "text").write.mode("overwrite").partitionBy("tool").json(path)


def images(tables: DataFrame, limit: int) -> DataFrame:
    """The first `limit` table images as bytes, with the manifest's fields; `limit` is the feature."""
    return tables.where("image_base64 is not null").orderBy("table_id").limit(limit).select("table_id", F.unbase64("image_base64").alias("png"), F.concat("table_id", F.lit(".png")).alias("file"))


def write_images(tables: DataFrame, path: str, limit: int) -> None:
    """images() with their bytes as Parquet, and beside it the manifest as JSON lines: id, file name, size and whether the bytes begin as a PNG file does."""
    rows = images(tables, limit)
    rows.write.mode("overwrite").parquet(f"{path}/images")
    stored = tables.sparkSession.read.schema(rows.schema).parquet(f"{path}/images")
    head = F.substring("png", 1, 8) == F.unhex(F.lit("89504E470D0A1A0A"))
    stored.select("table_id", "file", F.length("png").alias("bytes"), head.alias("is_png")).coalesce(1).sortWithinPartitions("table_id").write.mode("overwrite").json(f"{path}/manifest")


def encoded(values: DataFrame) -> DataFrame:
    """Nested values of a record as JSON, others as text."""
    as_text = lambda f: F.to_json(f.name) if f.dataType.typeName() in ("struct", "map", "array") else F.col(f.name).cast("string")
    return values.select(*[as_text(f).alias(f.name) for f in values.schema])


def write_env(spark: SparkSession, settings: dict[str, object], path: str) -> None:
    """The settings as a text file of KEY=value lines, which readers.settings() reads."""
    spark.createDataFrame([(env_lines(settings).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def env_lines(settings: dict[str, object]) -> str:
    return "".join(f"{k}={v}\n" for k, v in settings.items())
