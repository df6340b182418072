"""Streams: documents ingested as they arrive, and the life of a document with a timeout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.batch import STALE_AFTER

EVENT = "batch_id string, doc_id string, state string, ts timestamp"


def lifecycle(events: DataFrame, timeout_s: int = STALE_AFTER) -> DataFrame:
    """State changes of documents from a stream of (batch_id, doc_id, state, ts).

    A document that stays in processing for more than `timeout_s` of event time goes back to
    pending; its row says so with `recovered`. State is one row a document and goes when it is done.
    """

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (since,) = state.get
            state.remove()
            yield pd.DataFrame({"batch_id": [key[0]], "doc_id": [key[1]], "state": ["pending"], "since": [since], "recovered": [True]})
            return
        got = pd.concat(list(rows)).sort_values("ts", kind="stable")
        last = got.iloc[-1]
        if last["state"] == "processing":
            ms = int(last["ts"].timestamp() * 1000)
            state.update((ms,))
            state.setTimeoutTimestamp(max(ms + timeout_s * 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"batch_id": key[0], "doc_id": key[1], "state": got["state"], "since": (got["ts"].map(lambda t: int(t.timestamp() * 1000))), "recovered": False})

    keyed = events.withWatermark("ts", "0 seconds").groupBy("batch_id", "doc_id")
    return keyed.applyInPandasWithState(step, "batch_id string, doc_id string, state string, since long, recovered boolean", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_stream(spark: SparkSession, folder: str, schema: str, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Builds points of each new file of items and appends them; a batch that runs again replaces its own output."""

    def each(batch: DataFrame, epoch: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by state in windows of event time, for live progress."""
    return events.withWatermark("ts", late).groupBy("batch_id", F.window("ts", window), "state").agg(F.count("*").alias("n"))
