"""Substring deduplication by level-wise doubling.

A window is some consecutive words of one text. Windows repeated at one length alone are extended to about twice that
length: first the windows of SEED words (half of the width asked for), then those of the width that hold a repeated seed, then those of twice the
width whose two halves are both repeated, and so on until no candidates survive. A word goes if it stands in a window
of the width whose words also start anywhere else; longer levels say how long the repeated passages are.

Of the first level only the windows at minimisers are kept, the least of every GAP seeds, since any window of the
width that two places share holds the same one of them; so it writes about a tenth of a row a word. From the second level
on windows are told by 128 bits, and a longer window by the hashes of its halves, so that texts are not read again: what
is repeated of a text is one row of arrays, whose places are at most its words. Equal windows are found by sorting by range of hash and place, so one that
stands in a third of all texts is spread over tasks, and each level sends its windows once by hash and once by text.

Defined cases: words are runs of anything but the six ASCII spaces, unchanged; a text with fewer words than the width loses nothing; a
null text has no words and gives an empty one; equal texts are copies, so each loses all its words if it has enough of them,
rows that repeat an id too; a window may overlap its other place; rows without an id are documents like others; an empty table gives an
empty result; columns other than the results are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb
from foliant.llm.components import bounded, cut, drop, fresh, others, quoted, release
from foliant.llm.suffix_dedup import equal_neighbours, equal_rows

WIDTH = 35
RESULTS = ("text", "n_words", "n_removed", "longest")


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ws, we, doc = tb.spans(buf, offs, tb.NONSPACE)
    return tb.span_hash(tb.prefix(buf), ws, we), doc


def seeds(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the least seed of every `gap` seeds of one text; of equal ones the first of them."""
    seed = (width + 1) // 2
    gap = width - seed + 1
    h, at = tb.window_hash(hashes, doc, seed)
    if len(h) < gap:
        return h[:0], at[:0]
    runs, same = sliding_window_view(h, gap), doc[at[: len(h) - gap + 1]] == doc[at[gap - 1 :]]
    step = 1 << 16
    least = [i + np.flatnonzero(same[i : i + step]) + runs[i : i + step][same[i : i + step]].argmin(1) for i in range(0, len(runs), step)]
    pick = np.unique(np.concatenate(least))
    return h[pick], at[pick]


def heads(doc: np.ndarray, n: int) -> np.ndarray:
    """The first word of each of n texts."""
    return np.searchsorted(doc, np.arange(n))


def _first_level(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, buf, offs in tb.chunks(b.column("text")):
            hashes, doc = word_hashes(buf, offs)
            h, at = seeds(hashes, doc, width)
            yield _windows(b.column("key").slice(i, j - i), doc[at], at - heads(doc, j - i)[doc[at]], h, np.zeros_like(h))


def _windows(keys: pa.Array, owner: np.ndarray, pos: np.ndarray, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), keys.take(pa.array(owner)), pa.array(pos.astype(np.int32))], ["h", "c", "key", "pos"])


def _second_level(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Windows of the width that hold one of the marked seeds of their text."""
    reach = width - (width + 1) // 2
    for b in batches:
        for i, j, buf, offs in tb.chunks(b.column("text")):
            hashes, doc = word_hashes(buf, offs)
            head = heads(doc, j - i)
            near = np.zeros(len(hashes) + 1, np.int64)
            marks = b.column("marks").slice(i, j - i)
            at = marks.flatten().to_numpy(zero_copy_only=False) + np.repeat(head, marks.value_lengths().to_numpy(zero_copy_only=False))
            np.add.at(near, np.maximum(at - reach, head[doc[at]]), 1)
            np.add.at(near, at + 1, -1)
            h, at = tb.window_hash(hashes, doc, width)
            take = np.cumsum(near)[at] > 0
            c = tb.window_hash(tb.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), doc, width)[0]
            yield _windows(b.column("key").slice(i, j - i), doc[at[take]], (at - head[doc[at]])[take], h[take], c[take])


def _doubled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The windows of 2 * width words whose halves are both among the places `at` (pos, h, c) of one text, in order."""
    for b in batches:
        at = b.column("at")
        pos, h, c = (x.to_numpy() for x in at.flatten().flatten())
        owner = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
        place = (owner << 32) + pos
        right = np.searchsorted(place, place + width)
        left = np.flatnonzero((right < len(place)) & (place[np.minimum(right, len(place) - 1)] == place + width))
        right = right[left]
        joined = [tb.mix(x.view(np.uint64)[left] * np.uint64(0x9E3779B97F4A7C15) + tb.mix(x.view(np.uint64)[right])) for x in (h, c)]
        yield _windows(b.column("key"), owner[left], pos[left], *joined)


WINDOW = "h long, c long, key long, pos int"


def by_text(windows: DataFrame) -> DataFrame:
    """(key, at) of the repeated ones of the cut `windows`, which are dropped: the places of each text in order, with their hashes."""
    out = cut(equal_rows(windows).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "h", "c"))).alias("at")))
    drop(windows)
    release(out.sparkSession)
    return out


def repeated_windows(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, starts, longest) of the texts (key, text), one row a key, that hold repeated windows: where those of `width` words
    start, and the greatest length of width, 2 * width, 4 * width, ... at which some window is still repeated."""
    first = cut(texts.mapInArrow(tb.tidied(partial(_first_level, width=width)), WINDOW))
    marks = cut(equal_neighbours(first).groupBy("key").agg(F.collect_list("pos").alias("marks")))
    drop(first)
    keys = bounded(marks.select("key"))
    held = texts.join(keys, "key", "left_semi").join(marks, "key")
    places = by_text(cut(held.mapInArrow(tb.tidied(partial(_second_level, width=width)), WINDOW)))
    drop(marks, keys)
    starts = cut(places.select("key", F.col("at.pos").alias("starts")))
    reached = []
    while not places.isEmpty():
        reached.append(cut(places.select("key", F.lit(width).alias("length"))))
        longer = cut(places.mapInArrow(tb.tidied(partial(_doubled, width=width)), WINDOW))
        drop(places)
        places, width = by_text(longer), 2 * width
    drop(places)
    if not reached:
        return starts.withColumn("longest", F.lit(0))
    longest = reduce(DataFrame.unionByName, reached).groupBy("key").agg(F.max("length").alias("longest"))
    out = cut(starts.join(longest, "key"))
    drop(starts, *reached)
    return out


def _kept(width: int):
    @F.arrow_udf("struct<text: string, n_words: bigint, n_removed: bigint>")
    def kept(text: pa.Array, starts: pa.Array, whole: pa.Array) -> pa.Array:
        texts, counts, gone = [], [], []
        for i, j, buf, offs in tb.chunks(text):
            ws, we, doc = tb.spans(buf, offs, tb.NONSPACE)
            head = np.append(heads(doc, j - i), len(ws))
            raw = buf.tobytes()
            for d in range(j - i):
                a, z = int(head[d]), int(head[d + 1])
                stay = np.ones(z - a, bool)
                if whole[i + d].as_py():
                    stay[:] = z - a < width
                elif starts[i + d].is_valid:
                    cover = np.zeros(z - a + width + 1, np.int64)
                    at = starts[i + d].values.to_numpy(zero_copy_only=False)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + width, -1)
                    stay = np.cumsum(cover)[: z - a] == 0
                on = a + np.flatnonzero(stay)
                texts.append(b" ".join([raw[x:y] for x, y in zip(ws[on].tolist(), we[on].tolist(), strict=True)]).decode())
                counts.append(z - a)
                gone.append(z - a - len(on))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_words", "n_removed"])

    return kept


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """`docs` with its text cut down to the words that no repeated window covers, joined by one space, and with n_words (before),
    n_removed and longest (0, or the greatest doubled length at which a window of the text is repeated)."""
    rest = [F.col(quoted(c)) for c in others(docs, *RESULTS)]
    key, starts, longest, whole, got = fresh(docs.columns, "key", "starts", "longest", "whole", "got")
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    least = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1 << 63))
    copied = cut(texts.groupBy("key").agg(F.count("*").alias("n"), F.min(least).alias("rep")).where("n > 1").select("key", "rep"))
    keys = bounded(copied.select("key"))
    once = texts.join(keys, "key", "left_anti").select("key", "text")
    one = texts.withColumn("rep", least).join(bounded(copied), ["key", "rep"], "left_semi").dropDuplicates(["key"]).select("key", "text")
    # copies go by their flag alone, so that no hot text meets a list of places
    found = cut(repeated_windows(once.unionByName(one), width).join(keys, "key", "left_anti"))
    touched = bounded(found.select("key"))
    of = lambda t, *more: t.select(F.col("key").alias(key), *more)
    flagged = docs.withColumn(key, F.xxhash64("text")).join(of(keys, F.lit(True).alias(whole)), key, "left")
    some = flagged.join(of(touched), key, "left_semi").join(of(found, F.col("starts").alias(starts), F.col("longest").alias(longest)), key)
    none = flagged.join(of(touched), key, "left_anti").withColumn(starts, F.lit(None).cast("array<int>")).withColumn(longest, F.lit(0))
    out = some.unionByName(none).withColumn(got, _kept(width)("text", starts, whole))
    full = F.when(F.col(whole) & (F.col(f"{got}.n_words") >= width), width * F.pow(F.lit(2), F.floor(F.log2(F.floor(F.col(f"{got}.n_words") / width)))))
    return out.select(*rest, f"{got}.text", f"{got}.n_words", f"{got}.n_removed", F.coalesce(full, F.col(longest)).cast("long").alias("longest"))
