"""When a batch of documents is done: an event by counters of its documents' states, kept from micro-batch to micro-batch.

Each batch has a map from document to the last state that it is known to be in, and counters of the open, complete and failed ones. A state change
that comes twice, or after a later one, changes nothing. When no document is open a timer waits for `quiet_s` of event time, since more may be
submitted; then the batch is `completed`, and its state goes. A batch with open documents and without news for `keep_s` is `abandoned`. News
after that begins it anew. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).

Defined cases: rows without a batch or document, or in a state that is not known, are left out; of changes at the same moment the one farther on in the life
of a document counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: States of a document in the order of its life; those from the third on end it.
STATES = ("pending", "processing", "failed", "complete")
RESULT = "batch_id string, outcome string, total long, complete long, failed long, last_ts timestamp"


class Completion(StatefulProcessor):
    def __init__(self, quiet_s: int, keep_s: int):
        self.quiet_ms, self.keep_ms = quiet_s * 1000, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.documents = handle.getMapState("documents", "doc_id string", "ts long, state int")
        self.counts = handle.getValueState("counts", "open long, complete long, failed long, last_ts long, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = {"open": 0, "complete": 0, "failed": 0}
        *known, last, due = self.counts.get() if self.counts.exists() else (0, 0, 0, -1, -1)
        n.update(zip(n, known, strict=True))
        # one look at the state for each document of the micro-batch
        latest: dict[str, tuple[int, int]] = {}
        for b in rows:
            for doc, state, ts in zip(b["doc_id"], b["rank"], b["ms"], strict=True):
                latest[doc] = max(latest.get(doc, (-1, -1)), (int(ts), int(state)))
        kind = lambda state: "open" if state < 2 else STATES[state]
        changed = False
        for doc, new in latest.items():
            old = self.documents.getValue((doc,))
            if old is not None and new <= tuple(old):
                continue
            if old is not None:
                n[kind(old[1])] -= 1
            n[kind(new[1])] += 1
            self.documents.updateValue((doc,), new)
            last, changed = max(last, new[0]), True
        if changed:
            if due >= 0:
                self.handle.deleteTimer(due)
            due = last + (self.keep_ms if n["open"] else self.quiet_ms)
            self.handle.registerTimer(due)
            self.counts.update((*n.values(), last, due))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        open_, complete, failed, last, due = self.counts.get()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.documents.clear()
            self.counts.clear()
            yield pd.DataFrame({"batch_id": [key[0]], "outcome": ["abandoned" if open_ else "completed"], "total": [open_ + complete + failed], "complete": [complete], "failed": [failed], "last_ts": [pd.Timestamp(last, unit="ms")]})

    def close(self) -> None:
        pass


def batch_completion(events: DataFrame, quiet_s: int = 60, keep_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """(batch_id, outcome, total, complete, failed, last_ts) of batches as they end, from a stream of (batch_id, doc_id, state, ts)."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state")).cast("int") - 1
    known = events.withWatermark("ts", late).where(F.col("state").isin(*STATES)).where("batch_id is not null and doc_id is not null and ts is not null")
    rows = known.select("batch_id", "doc_id", "ts", rank.alias("rank"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy("batch_id").transformWithStateInPandas(Completion(quiet_s, keep_s), RESULT, "append", "eventTime")
