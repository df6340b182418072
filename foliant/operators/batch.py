"""Batch state: counts, progress, timings, transitions, stale documents and reports.

doc_state has batch_id, doc_id, state (pending, processing, complete, failed), start_ts, end_ts,
duration, pages and error. Times are seconds since the epoch and `now` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from foliant.functions import text as tx

STATES = ["pending", "processing", "complete", "failed"]
STALE_AFTER = 600


def latest(doc_state: DataFrame) -> DataFrame:
    """One row a document: the one of the last time stamp."""
    at = F.coalesce("end_ts", "start_ts", F.lit(0.0))
    order = F.struct(at.alias("at"), F.col("state").alias("state"))
    return doc_state.groupBy("batch_id", "doc_id").agg(F.max_by(F.struct(*[c for c in doc_state.columns if c not in ("batch_id", "doc_id")]), order).alias("s")).select("batch_id", "doc_id", "s.*")


def counts(doc_state: DataFrame) -> DataFrame:
    """Documents by state; a document in two states counts in both, and so does the total."""
    one = doc_state.select("batch_id", "doc_id", "state").where(F.col("state").isin(STATES)).distinct()
    return one.groupBy("batch_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES], F.count("*").alias("total"))


def progress(doc_state: DataFrame, batches: DataFrame, now: float) -> DataFrame:
    """Percent done, elapsed seconds, documents a minute and the estimated seconds left."""
    c = batches.select("batch_id", "created_ts").join(counts(doc_state), "batch_id", "left").na.fill(0, [*STATES, "total"])
    done = F.col("complete") + F.col("failed")
    elapsed = F.lit(now) - F.col("created_ts")
    rate = F.when((elapsed > 0) & (F.col("complete") > 0), F.col("complete") / elapsed * 60).otherwise(0.0)
    left = F.col("pending") + F.col("processing")
    eta = F.when(rate > 0, F.floor(left / rate * 60))
    return c.select("batch_id", *STATES, "total", F.when(F.col("total") > 0, F.round(done / F.col("total") * 100, 1)).otherwise(0.0).alias("percent"), F.floor(elapsed).alias("elapsed_s"), F.round(rate, 2).alias("docs_per_min"), F.when(eta > 0, eta).alias("eta_s"), ((left == 0) & (F.col("total") > 0)).alias("is_complete"))


def timing_summary(doc_state: DataFrame) -> DataFrame:
    """Durations (zero ones do not count), wall clock, and seconds a page of documents with pages."""
    d = F.nullif(F.col("duration"), F.lit(0.0))
    per = F.when((F.col("pages") > 0) & (F.col("duration") > 0), F.col("duration") / F.col("pages"))
    done = doc_state.where("state = 'complete'")
    r = lambda c, n=4: F.round(c, n)
    return done.groupBy("batch_id").agg(
        F.count(d).alias("n"), r(F.min(d)).alias("min_s"), r(F.max(d)).alias("max_s"), r(F.avg(d)).alias("avg_s"), r(F.sum(d)).alias("sum_s"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"),
        r(F.max("end_ts") - F.min("start_ts")).alias("wall_s"), F.sum(F.coalesce("pages", F.lit(0))).alias("total_pages"), r(F.min(per)).alias("min_s_page"), r(F.max(per)).alias("max_s_page"), r(F.avg(per)).alias("avg_s_page"),
    )


def stale(doc_state: DataFrame, now: float, timeout: float = STALE_AFTER) -> DataFrame:
    """Documents in processing for more than `timeout` seconds."""
    return doc_state.where((F.col("state") == "processing") & (F.lit(now) - F.col("start_ts") > timeout)).select("batch_id", "doc_id", (F.lit(now) - F.col("start_ts")).alias("age_s"))


def _move(doc_state: DataFrame, ids: DataFrame, to: str, **values: Column) -> DataFrame:
    hit = doc_state.join(ids.select("batch_id", "doc_id").distinct().withColumn("_hit", F.lit(True)), ["batch_id", "doc_id"], "left")
    out = hit.withColumns({k: F.when(F.col("_hit"), v).otherwise(F.col(k)) for k, v in values.items()})
    return out.withColumn("state", F.when(F.col("_hit"), F.lit(to)).otherwise(F.col("state"))).select(*doc_state.columns)


def submit(batch_id: str, paths: DataFrame) -> DataFrame:
    """All documents of `paths` (path) as pending rows of a new batch; ids are file stems."""
    rows = paths.select(F.lit(batch_id).alias("batch_id"), tx.stem(F.col("path")).alias("doc_id")).distinct()
    empty = {"start_ts": "double", "end_ts": "double", "duration": "double", "pages": "int", "error": "string"}
    return rows.select("batch_id", "doc_id", F.lit("pending").alias("state"), *[F.lit(None).cast(t).alias(k) for k, t in empty.items()])


def mark_processing(doc_state: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    return _move(doc_state, ids, "processing", start_ts=F.lit(now))


def mark_complete(doc_state: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    return _move(doc_state, ids, "complete", end_ts=F.lit(now), duration=F.round(F.lit(now) - F.coalesce("start_ts", F.lit(now)), 2))


def mark_failed(doc_state: DataFrame, ids: DataFrame, now: float, error: str) -> DataFrame:
    return _move(doc_state, ids, "failed", end_ts=F.lit(now), error=F.lit(error))


def retry_failed(doc_state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Failed documents (all, or those of `ids`) back to pending, without their error."""
    failed = doc_state.where("state = 'failed'")
    chosen = failed if ids is None else failed.join(ids, ["batch_id", "doc_id"], "left_semi")
    return _move(doc_state, chosen, "pending", error=F.lit(None).cast("string"))


def recover_stale(doc_state: DataFrame, now: float, timeout: float = STALE_AFTER) -> DataFrame:
    return _move(doc_state, stale(doc_state, now, timeout), "pending")


def resume(doc_state: DataFrame, paths: DataFrame, now: float, timeout: float = STALE_AFTER) -> DataFrame:
    """Pending documents after recovery that have a path, to be run again."""
    pending = recover_stale(doc_state, now, timeout).where("state = 'pending'").select("batch_id", "doc_id")
    return pending.join(paths.select(tx.stem(F.col("path")).alias("doc_id"), "path"), "doc_id")


def without_path(doc_state: DataFrame, paths: DataFrame) -> DataFrame:
    return doc_state.where("state = 'pending'").select("batch_id", "doc_id").join(paths.select(tx.stem(F.col("path")).alias("doc_id")), "doc_id", "left_anti")


def failed_report(doc_state: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` failed documents of each batch with a shortened error."""
    w = Window.partitionBy("batch_id").orderBy("doc_id")
    rows = doc_state.where("state = 'failed'").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return rows.select("batch_id", "n", "doc_id", tx.short_error(F.coalesce("error", F.lit("Unknown error"))).alias("error"))


def batch_list(batches: DataFrame, doc_state: DataFrame, now: float) -> DataFrame:
    """Batches, newest id first, with a bar and a readable time left."""
    p = progress(doc_state, batches, now)
    return p.select("batch_id", "total", "percent", tx.progress_bar(F.col("percent")).alias("bar"), tx.duration(F.col("elapsed_s")).alias("elapsed"), tx.duration(F.col("eta_s")).alias("eta")).orderBy(F.desc("batch_id"))


def pause(batches: DataFrame, batch_id: str) -> DataFrame:
    """Only the status changes; documents that wait still run."""
    return batches.withColumn("status", F.when(F.col("batch_id") == batch_id, "paused").otherwise(F.col("status")))


def clear(table: DataFrame, batch_id: str) -> DataFrame:
    return table.where(F.col("batch_id") != batch_id)


def not_expired(results: DataFrame, now: float, ttl_s: float = 7 * 86400) -> DataFrame:
    return results.where(F.col("end_ts") + ttl_s > now)


def service_stats(requests: DataFrame) -> DataFrame:
    """Requests (service, ms, healthy): count, total, average (0 without any), healthy ones."""
    return requests.groupBy("service").agg(F.count("*").alias("n"), F.round(F.sum("ms"), 3).alias("total_ms"), F.round(F.coalesce(F.avg("ms"), F.lit(0.0)), 4).alias("avg_ms"), F.count_if("healthy").alias("n_healthy"), F.every("healthy").alias("all_healthy"))


def batch_average(results: DataFrame) -> DataFrame:
    """Successful rows each with the whole milliseconds that one took on average; sums are combined before the shuffle and joined back."""
    per = results.groupBy("batch_id").agg(F.floor(F.sum("ms") / F.count_if("success")).alias("avg_ms"))
    return results.join(per, "batch_id", "left").withColumn("avg_ms", F.when(F.col("success"), F.col("avg_ms")))


def round_robin(tasks: DataFrame, instances: int) -> DataFrame:
    """`instance` of each task in order of document, batch by batch.

    Tasks are sorted by ranges, and numbers in a range are added to the counts of the ranges before it, so a hot batch is no single task.
    """
    if not instances:
        return tasks.withColumn("instance", F.lit(0))
    ranged = tasks.repartitionByRange("batch_id", "doc_id").withColumn("_range", F.spark_partition_id())
    counts = ranged.groupBy("batch_id", "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("batch_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("batch_id", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("batch_id", "_range").orderBy("doc_id")) - 1
    numbered = ranged.withColumn("_at", at).join(offsets, ["batch_id", "_range"])
    return numbered.withColumn("instance", F.pmod(F.col("_at") + F.col("_before"), F.lit(instances))).drop("_range", "_at", "_before")


def result_of(results: DataFrame, batch_id: str, doc_id: object, now: float) -> DataFrame:
    """A document's result, while it has not expired."""
    return not_expired(results, now).where((F.col("batch_id") == batch_id) & (F.col("doc_id") == F.lit(doc_id)))


def errors_of(doc_state: DataFrame) -> DataFrame:
    """(batch_id, doc_id, error) of the documents that failed, with the whole error."""
    return doc_state.where("state = 'failed'").select("batch_id", "doc_id", F.coalesce("error", F.lit("Unknown error")).alias("error"))


def succeeded(rows: DataFrame) -> DataFrame:
    """`success` of each row: it has no error."""
    return rows.withColumn("success", F.col("error").isNull())


def jobs(events: DataFrame) -> DataFrame:
    """The state of each job from its events (job_id, ts, status, result, error): queued, processing, completed or failed, the last one counts."""
    rank = F.when(F.col("status") == "queued", 0).when(F.col("status") == "processing", 1).otherwise(2)
    return events.groupBy("job_id").agg(F.max_by(F.struct("status", "result", "error"), F.struct("ts", rank.alias("rank"))).alias("s"), F.min("ts").alias("created")).select("job_id", "s.*", "created")
