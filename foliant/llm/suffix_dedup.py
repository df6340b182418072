"""Suffix-array deduplication with sparse suffixes.

Of each text only the suffixes that begin at minimisers are kept: the place of the least
hash of SEED words in every run of GAP such places, so any PASSAGE words that two texts
share hold a common retained suffix. Suffixes are sorted by their first SEED words and
compared with their neighbours; those with an equal neighbour are extended left and right
over all PASSAGE words around them, which are sorted and compared in turn. What is equal to a
neighbour is repeated, so a word is covered exactly if it stands in PASSAGE consecutive words
(A-Z lower-cased) that occur at two places or more. Overlapping and touching pieces are one span.

Sorting is by range of hash and row, so a common passage is spread over tasks; the one run at each edge
of a task's range is compared with those of the other ranges.

Defined cases: texts with fewer than PASSAGE words and null or empty texts have no spans;
equal texts are one text with several places, so each is one span of all its words; rows
without an id are left out; rows that repeat an id and text give their spans once for each row; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb
from foliant.llm.components import bounded, cut, drop

PASSAGE, SEED = 50, 26
GAP = PASSAGE - SEED + 1


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tb.LOWER[buf]
    ws, we, doc = tb.spans(low, offs, tb.NONSPACE)
    return tb.span_hash(tb.prefix(low), ws, we), doc


def _other(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each word, so that what counts as equal agrees in 128 bits."""
    return tb.mix(hashes ^ np.uint64(0xA0761D6478BD642F))


def minimisers(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the words of all texts) and seed hashes of the retained suffixes; a tie keeps the first place."""
    h, at = tb.window_hash(hashes, doc, SEED)
    if len(h) < GAP:
        return at[:0], h[:0]
    view = sliding_window_view(h, GAP)
    same = doc[at[: len(view)]] == doc[at[GAP - 1 :]]
    step = 1 << 16
    picks = [np.unique(np.arange(i, min(i + step, len(view)))[s] + view[i : i + step][s].argmin(1)) for i in range(0, len(view), step) if (s := same[i : i + step]).any()]
    pick = np.unique(np.concatenate(picks)) if picks else np.zeros(0, np.int64)
    return at[pick], h[pick]


def equal_neighbours(rows: DataFrame) -> DataFrame:
    """(key, pos) of the rows (h, c, key, pos) whose two hashes occur twice or more, by sorting and comparing neighbours."""
    return equal_rows(rows).select("key", "pos")


def equal_rows(rows: DataFrame) -> DataFrame:
    """The rows themselves."""
    ordered = rows.repartitionByRange("h", "c", "key", "pos").sortWithinPartitions("h", "c", "key", "pos")

    @tb.tidied
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """edge: 0 for a row with an equal neighbour, 1 for a lone row at an edge, 2 for a run at an edge that needs none."""
        names = ["h", "c", "key", "pos", "edge"]
        held: pa.RecordBatch | None = None
        twin = False  # the held row equals the one before it
        first = True

        def out(b: pa.RecordBatch, edge: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(edge.astype(np.int32))], names).filter(pa.array(keep))

        for b in batches:
            if not b.num_rows:
                continue
            b = pa.RecordBatch.from_arrays([pc.cast(c, t) for c, t in zip(b.columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names[:4])
            joined = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h = joined.column(0).to_numpy()
            hit = np.zeros(len(h), bool)
            c = joined.column(1).to_numpy()
            same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
            hit[1:] |= same
            hit[:-1] |= same
            hit[0] |= twin
            done = len(h) - 1
            edge = np.zeros(len(h), int)
            if first and done:
                if hit[0]:
                    yield out(joined.slice(0, 1), np.array([2]), np.array([True]))
                else:
                    hit[0], edge[0] = True, 1
                first = False
            if done:
                yield out(joined.slice(0, done), edge[:done], hit[:done])
            held, twin = joined.slice(done, 1), bool(hit[-1])
        if held is not None:
            if twin:
                yield out(held, np.array([0]), np.array([True]))
            yield out(held, np.array([2 if twin else 1]), np.array([True]))

    found = cut(ordered.mapInArrow(compare, "h long, c long, key long, pos int, edge int"))
    # at most two rows of each range
    edges = found.where("edge > 0")
    shared = edges.groupBy("h", "c").agg(F.count("*").alias("n")).where("n > 1").select("h", "c")
    names = ["h", "c", "key", "pos"]
    return found.where("edge = 0").select(*names).unionAll(edges.where("edge = 1").join(shared, ["h", "c"], "left_semi").select(*names))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, end_word, n_words) of the repeated passages; end_word is the first word after."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("text"))
    places = rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    unique = rows.select("key", "text").join(bounded(places.where("copies > 1").select("key")), "key", "left_anti")
    copied = rows.join(bounded(places.where("copies > 1").select("key", F.col("rep").alias("doc_id"))), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    texts = unique.unionByName(copied.select("key", "text"))

    @tb.tidied
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            for i, j, buf, offs in tb.chunks(b.column("text")):
                hashes, doc = _words(buf, offs)
                at, h = minimisers(hashes, doc)
                c, places = tb.window_hash(_other(hashes), doc, SEED)
                c = c[np.searchsorted(places, at)]
                head = np.searchsorted(doc, np.arange(j - i))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys[i:j][doc[at]]), pa.array((at - head[doc[at]]).astype(np.int32))], ["h", "c", "key", "pos"])

    @tb.tidied
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, marks = b.column("key").to_numpy(), b.column("marks")
            for i, j, buf, offs in tb.chunks(b.column("text")):
                hashes, doc = _words(buf, offs)
                h, at = tb.window_hash(hashes, doc, PASSAGE)
                head = np.searchsorted(doc, np.arange(j - i))
                want = np.zeros(len(hashes) + 1, np.int64)
                for d in range(j - i):
                    p = marks[i + d].values.to_numpy(zero_copy_only=False) + head[d]
                    np.add.at(want, np.maximum(p - (GAP - 1), head[d]), 1)
                    np.add.at(want, p + 1, -1)
                take = np.cumsum(want)[at] > 0
                c = tb.window_hash(_other(hashes), doc, PASSAGE)[0][take]
                h, at = h[take], at[take]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(keys[i:j][doc[at]]), pa.array((at - head[doc[at]]).astype(np.int32))], ["h", "c", "key", "pos"])

    @tb.tidied
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[], [], []]
            for key, starts in zip(b.column("key").to_pylist(), b.column("starts"), strict=True):
                s = np.unique(starts.values.to_numpy(zero_copy_only=False))
                cuts = np.flatnonzero(s[1:] > s[:-1] + PASSAGE)
                first, last = s[np.concatenate(([0], cuts + 1))], s[np.concatenate((cuts, [len(s) - 1]))]
                for x, y in zip(first.tolist(), last.tolist(), strict=True):
                    for c, v in zip(out, (key, x, y + PASSAGE), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["key", "first_word", "end_word"])

    @tb.tidied
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tb.chunks(b.column("text")):
                n = np.bincount(tb.spans(buf, offs, tb.NONSPACE)[2], minlength=j - i)
                yield pa.RecordBatch.from_arrays([b.column("key").slice(i, j - i), pa.array(np.zeros(j - i, np.int64)), pa.array(n.astype(np.int64))], ["key", "first_word", "end_word"])

    suffixes = cut(texts.mapInArrow(anchors, "h long, c long, key long, pos int"))
    marks = cut(equal_neighbours(suffixes).groupBy("key").agg(F.collect_list("pos").alias("marks")))
    drop(suffixes)
    # in a text with equals elsewhere every word is covered, but other texts may share a part of it
    held = texts.join(bounded(marks.select("key")), "key", "left_semi").join(marks, "key")
    windows = cut(held.mapInArrow(extend, "h long, c long, key long, pos int"))
    starts = equal_neighbours(windows).groupBy("key").agg(F.collect_list("pos").alias("starts"))
    spans = starts.mapInArrow(merge, "key long, first_word long, end_word long")
    full = cut(copied.select("key", "text").mapInArrow(whole, "key long, first_word long, end_word long").where(F.col("end_word") >= PASSAGE))
    spans = spans.join(full.select("key"), "key", "left_anti").unionByName(full)
    return rows.select("doc_id", "key").join(spans, "key").select("doc_id", "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("n_words"))
