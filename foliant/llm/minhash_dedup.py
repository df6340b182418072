"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star edges.

Each text's distinct word shingles are hashed once; the least hash of every bin is its
signature, and an empty bin takes the value of the first full bin on a probe sequence of its
own. Texts with equal sets are one class from here on. Class representatives meet in
buckets of equal bands. Within a bucket the pairs are a star: a centre and the others, confirmed on full
sets. Buckets that are then in several components are searched for the links left by coding
each set against a centre and joining the rarest edits (components.coded_links), so no
link of theirs is lost and pairs do not grow with the square of a group.

Defined cases: a text with fewer words than a shingle counts its whole sequence as one; a
null or empty text, or one without words, has no shingles and is linked with nothing;
repeated rows and equal sets share a component; rows without an id are left out, since links
are between ids; an id that occurs with several texts is one node that joins their links, and each row keeps its own count;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb
from foliant.llm.components import bounded, bucket_links, cut, drop, grown

#: Rows of a band and bands: a pair at similarity 0.8 shares no band with probability 3e-6.
ROWS, BANDS = 6, 42

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, in order of both."""
    n = len(offs) - 1
    low = tb.LOWER[buf]
    ws, we, doc = tb.spans(low, offs, tb.NONSPACE)
    words = tb.span_hash(tb.prefix(low), ws, we)
    h, at = tb.window_hash(words, doc, k)
    owner = doc[at]
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    for d in np.flatnonzero((count > 0) & (count < k)):
        whole, _ = tb.window_hash(words[first[d] : first[d] + count[d]], np.zeros(count[d], np.int64), int(count[d]))
        h, owner = np.append(h, whole), np.append(owner, d)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    return owner[new], h[new]


def _probes(bins: int) -> np.ndarray:
    j = np.arange(bins, dtype=np.uint64)[:, None]
    t = np.arange(8 * bins, dtype=np.uint64)[None]
    return (tb.mix(j * _A + t * _B + np.uint64(1)) % np.uint64(bins)).astype(np.int32)


def signatures(owner: np.ndarray, h: np.ndarray, n: int, bins: int, probes: np.ndarray) -> np.ndarray:
    """n x bins least hashes, densified; zeros for an empty set."""
    slot = ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    new = np.concatenate(([True], (slot[1:] != slot[:-1]) | (owner[1:] != owner[:-1]))) if len(h) else np.zeros(0, bool)
    sig, full = np.zeros((n, bins), np.uint64), np.zeros((n, bins), bool)
    sig[owner[new], slot[new]] = h[new]
    full[owner[new], slot[new]] = True
    some = full.any(1)
    d, j = np.nonzero(~full & some[:, None])
    src = full.copy()
    for t in range(probes.shape[1]):
        if not len(d):
            break
        p = probes[j, t]
        hit = src[d, p]
        sig[d[hit], j[hit]] = sig[d[hit], p[hit]]
        d, j = d[~hit], j[~hit]
    if len(d):  # no probe met a full bin: the first full one
        sig[d, j] = sig[d, src.argmax(1)[d]]
    return sig


def sign(docs: DataFrame, shingle: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n, s1, s2, bands): set size, two digests of the set, and the band hashes (none for an empty set)."""
    schema = "doc_id long, n long, s1 long, s2 long, bands array<long>"

    @tb.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probes(rows * bands)
        for b in batches:
            for i, j, buf, offs in tb.chunks(b.column("text")):
                m = j - i
                owner, h = shingle_sets(buf, offs, shingle)
                n = np.bincount(owner, minlength=m)
                sums = []
                for c in (_A, _B):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(h ^ c), dtype=np.uint64)))
                    at = np.concatenate(([0], np.cumsum(n)))
                    sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                sig = signatures(owner, h, m, rows * bands, probes).reshape(m, bands, rows)
                band = np.arange(bands, dtype=np.uint64)[None] * _B
                for r in range(rows):
                    band = tb.mix(band * _A + sig[:, :, r])
                band = band[n > 0].reshape(-1).view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(band))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n", "s1", "s2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, schema)


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked, lo, hi, na, nb) of `pairs`: whether 100 * intersection >= percent * union of their full sets, their distance and the sizes.

    Only texts of pairs move. The centre of many pairs is a hot key of a plain inner join, which adaptive
    execution splits.
    """
    needed = bounded(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").join(needed, "doc_id", "left_semi")
    side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))

    @tb.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 400):
                b = batch.slice(i, 400)
                m = b.num_rows
                keys = []
                for t in ("ta", "tb"):
                    got = []
                    for x, _, buf, offs in tb.chunks(b.column(t)):
                        owner, h = shingle_sets(buf, offs, shingle)
                        got.append((owner + x, h))
                    keys.append((np.concatenate([o for o, _ in got]), np.concatenate([h for _, h in got])))
                (oa, ha), (ob, hb) = keys
                na, nb = np.bincount(oa, minlength=m), np.bincount(ob, minlength=m)
                every = np.concatenate((tb.keyed(ha, oa), tb.keyed(hb, ob)))
                both = np.bincount(np.concatenate((oa, ob))[tb.repeated(every)], minlength=m) // 2
                either = na + nb - both
                far = pa.array(1 - both / np.maximum(either, 1))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((both > 0) & (100 * both >= percent * either)), far, far, pa.array(na), pa.array(nb)], ["a", "b", "linked", "lo", "hi", "na", "nb"])

    judged = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, linked boolean, lo double, hi double, na long, nb long")
    # an id of several texts is linked if one of them is, and its distance is known within theirs
    return judged.groupBy("a", "b").agg(F.max("linked").alias("linked"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("na").alias("na"), F.max("nb").alias("nb"))


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(id, set) of the texts of `ids`, as sorted hashes of their shingles."""
    few = bounded(ids.select(F.col("id").alias("doc_id")).distinct())

    @tb.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tb.chunks(b.column("text")):
                owner, h = shingle_sets(buf, offs, shingle)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=j - i)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["id", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.join(few, "doc_id", "left_semi").mapInArrow(run, "id long, set array<long>").where("size(set) > 0")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row with an id; `kept` marks the least id of each component."""
    signed = cut(sign(docs, shingle, rows, bands))
    reps = signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"))
    reps = cut(reps)
    members = reps.select(F.col("rep").alias("id"), F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket")).distinct()
    # copies, and rows of one id with different texts, are one node
    several = reps.where("rep < last").select("s1", "s2", "n", "rep")
    same = signed.where("n > 0").join(several, ["s1", "s2", "n"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    label = bucket_links(members, lambda pairs: confirm(pairs, docs, shingle, percent), lambda ids: full_sets(ids, docs, shingle), percent, f"100 * least(n, na) >= {percent} * greatest(n, na)")
    same = cut(same)
    if not same.isEmpty():
        label, old = grown(label, same), label
        drop(old)
    rows_ = signed.select("doc_id", "n")
    joined = rows_.withColumn("component", F.col("doc_id")) if label is None else rows_.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    drop(reps, same)
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
