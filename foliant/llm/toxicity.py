"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the mean of the embeddings of its hash and of the hashes of its byte
n-grams. Filters of widths 1, 2 and 3 slide over the words, the maximum of each over the
whole text feeds a logistic output. A filter's share in each word of a window is a fixed
vector of that word, so distinct words of a chunk are projected once and windows are sums
of such vectors. Thresholds are calibrated by language on all labelled texts that are neither held
out nor trained on, whatever the size of the fit's sample, from counts of their scores; language never enters the score.

Defined cases: a null or empty text has pooled values of zero and so a score like any other
text; with fewer than two classes to learn from, the score is the share of label 1 (0 when
there are no labels); a language without enough labels takes the threshold of all; a null
language is a language of its own; repeated label rows count once, as the larger label; rows with a
null id pass through and count as not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from foliant.llm import textbytes as tb
from foliant.llm.components import bounded, fresh, others, quoted

if TYPE_CHECKING:  # Python workers import this module, and pandas would take some 40 MB of each
    import pandas as pd

#: Bounds of the fit's sample: labelled rows of each class, and characters of all its texts, which are taken whole; scoring takes all texts.
FIT_ROWS, FIT_CHARS = 2000, 12_000_000
BUCKETS, DIM, FILTERS, WIDTHS, GRAMS = 1 << 15, 16, 16, (1, 2, 3), (5, 7)
#: Bytes of the texts that a worker scores at a time; its arrays take some 80 bytes for each.
SCORE_BYTES = 1 << 18
#: score at which `predicted` is 1
CUT = 0.7
#: Range that language thresholds are kept in, and the labels of each class that a language needs for its own.
THRESHOLDS, LEAST_LABELS = (0.3, 0.9), 20
#: Scores are counted in this many steps for the thresholds.
STEPS = 1000


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word its text and number among the distinct words; for distinct words the feature buckets and where each begins."""
    low = tb.LOWER[buf]
    ws, we, doc = tb.spans(low, offs, tb.ALNUM)
    _, first, word = np.unique(tb.span_hash(tb.prefix(low), ws, we), return_index=True, return_inverse=True)
    s, e = ws[first], we[first]
    size = e - s + 2
    ends = np.cumsum(size)
    begins = ends - size
    # the distinct words in a row, each between spaces, and the word that each byte belongs to
    owner = np.repeat(np.arange(len(s)), size)
    raw = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inner = np.arange(len(raw)) - begins[owner]
    mid = (inner > 0) & (inner < size[owner] - 1)
    raw[mid] = low[(s[owner] + inner - 1)[mid]]
    pre = tb.prefix(raw)
    owners, hashes = [np.arange(len(s))], [tb.span_hash(pre, begins, ends)]
    for n in GRAMS:
        at = np.flatnonzero(inner + n <= size[owner])
        owners.append(owner[at])
        hashes.append(tb.span_hash(pre, at, at + n))
    own, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(own, kind="stable")
    return doc, word.reshape(-1), (h[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(own[order], np.arange(len(s)))


@dataclass
class Net:
    emb: np.ndarray  # BUCKETS x DIM
    conv: np.ndarray  # sum(WIDTHS) x DIM x FILTERS
    bias: np.ndarray  # len(WIDTHS) x FILTERS
    out: np.ndarray  # len(WIDTHS) * FILTERS + 1
    prior: float | None = None
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, seed: int = 7) -> Net:
        r = np.random.default_rng(seed)
        f = lambda *s, k: (r.standard_normal(s) * k).astype(np.float32)
        return cls(f(BUCKETS, DIM, k=0.006), f(sum(WIDTHS), DIM, FILTERS, k=0.2), np.zeros((len(WIDTHS), FILTERS), np.float32), f(len(WIDTHS) * FILTERS + 1, k=0.1))

    def words(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros((0, DIM), np.float32)
        count = np.diff(np.concatenate((starts, [len(buckets)])))
        return np.add.reduceat(self.emb[buckets], starts, axis=0) / count[:, None].astype(np.float32)

    def pool(self, vec: np.ndarray, word: np.ndarray, doc: np.ndarray, n: int, keep: bool = False):
        """Pooled filters of each text (n x all filters, zero at least) and, if kept, the first word of each winning window (-1: none)."""
        pooled = np.zeros((n, len(WIDTHS), FILTERS), np.float32)
        where = np.full((n, len(WIDTHS), FILTERS), -1, np.int64)
        at = 0
        for k, w in enumerate(WIDTHS):
            if len(word) >= w:
                m = len(word) - w + 1
                x = np.repeat(self.bias[k][None], m, 0)
                for j in range(w):
                    x += (vec @ self.conv[at + j])[word[j : j + m]]
                ok = np.flatnonzero(doc[:m] == doc[w - 1 :])
                if len(ok):
                    x, d = x[ok] if len(ok) < m else x, doc[:m][ok]
                    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                    top = np.maximum.reduceat(x, cut, axis=0)
                    pooled[d[cut], k] = np.maximum(top, 0)
                    if keep:
                        for i, (a, b) in enumerate(zip(cut, [*cut[1:], len(d)], strict=True)):
                            where[d[a], k] = np.where(top[i] > 0, ok[a + x[a:b].argmax(0)], -1)
            at += w
        return (pooled, where) if keep else pooled

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return pooled.reshape(len(pooled), -1) @ self.out[:-1] + self.out[-1]

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if self.prior is not None:
            return np.full(n, self.prior)
        doc, word, buckets, starts = features(buf, offs)
        z = self.logit(self.pool(self.words(buckets, starts), word, doc, n)).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))

    def train(self, texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 16, rate: float = 0.05, seed: int = 11) -> Net:
        """Adagrad on the logistic loss; the gradient of a pooled value goes to its winning window alone."""
        r = np.random.default_rng(seed)
        params = [self.emb, self.conv, self.bias, self.out]
        speed = [np.full_like(p, 1e-6) for p in params]
        weight = np.where(y == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum())))
        packs = []
        order = r.permutation(len(texts))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            for a, b, buf, offs in tb.chunks(pa.array([texts[k] for k in pick]), 1 << 40):
                packs.append((features(buf, offs), y[pick[a:b]], weight[pick[a:b]]))
        first = np.concatenate(([0], np.cumsum(WIDTHS)))[:-1]
        for _ in range(epochs):
            for p in r.permutation(len(packs)):
                (doc, word, buckets, starts), t, wt = packs[p]
                n = len(t)
                vec = self.words(buckets, starts)
                pooled, where = self.pool(vec, word, doc, n, keep=True)
                z = self.logit(pooled)
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - t) * wt / n).astype(np.float32)
                flat = pooled.reshape(n, -1)
                g_out = np.concatenate((err @ flat, [err.sum()])).astype(np.float32) + 1e-4 * self.out
                g_pool = (err[:, None] * self.out[:-1]).reshape(pooled.shape)
                g_conv, g_bias, g_vec = np.zeros_like(self.conv), np.zeros_like(self.bias), np.zeros_like(vec)
                for k, w in enumerate(WIDTHS):
                    d, f = np.nonzero(where[:, k] >= 0)
                    g, at = g_pool[d, k, f], where[d, k, f]
                    np.add.at(g_bias[k], f, g)
                    for j in range(w):
                        i = word[at + j]
                        np.add.at(g_conv[first[k] + j].T, f, g[:, None] * vec[i])
                        np.add.at(g_vec, i, g[:, None] * self.conv[first[k] + j][:, f].T)
                used = np.flatnonzero(np.abs(g_vec).sum(1))
                ends = np.concatenate((starts[1:], [len(buckets)]))
                rows = np.concatenate([buckets[starts[i] : ends[i]] for i in used]) if len(used) else np.zeros(0, np.int64)
                share = np.repeat(g_vec[used] / (ends - starts)[used, None].astype(np.float32), (ends - starts)[used], axis=0)
                uniq, inv = np.unique(rows, return_inverse=True)
                g_emb = np.zeros((len(uniq), DIM), np.float32)
                np.add.at(g_emb, inv.reshape(-1), share)
                speed[0][uniq] += g_emb**2
                self.emb[uniq] -= 4 * rate * g_emb / np.sqrt(speed[0][uniq])
                for x, g, s in zip(params[1:], (g_conv, g_bias, g_out), speed[1:], strict=True):
                    s += g * g
                    x -= rate * g / np.sqrt(s)
        return self


def _scores(net: Net, texts: list[str]) -> np.ndarray:
    got = [net.score(buf, offs) for _, _, buf, offs in tb.chunks(pa.array(texts, pa.string()))]
    return np.concatenate(got) if got else np.zeros(0)


def judged(net: Net, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch in parts of about SCORE_BYTES of text, with their scores."""
    for i, j, buf, offs in tb.chunks(batch.column("text"), SCORE_BYTES):
        yield batch.slice(i, j - i), net.score(buf, offs)


def _keys(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    """(doc_id, key) of `rows` as a local table, for which no Python worker starts."""
    return spark.createDataFrame(pa.table([pa.array(rows[c].to_numpy(np.int64)) for c in ("doc_id", "key")], ["doc_id", "key"]))


def best_cut(score: np.ndarray, y: np.ndarray, default: float) -> float:
    """The threshold of the fewest errors, in the middle of its gap; THRESHOLDS bounds it."""
    if len(y) == 0 or min((y == 1).sum(), (y == 0).sum()) < LEAST_LABELS:
        return default
    order = np.argsort(score)
    s, t = score[order], y[order]
    wrong = np.concatenate(([0], np.cumsum(t == 1))) + (t == 0).sum() - np.concatenate(([0], np.cumsum(t == 0)))
    edges = np.concatenate(([0.0], (s[1:] + s[:-1]) / 2, [1.0]))
    best = np.flatnonzero(wrong == wrong.min())
    return float(np.clip(edges[best[len(best) // 2]], *THRESHOLDS))


def best_step(counts: np.ndarray, default: float) -> float:
    """The threshold of the fewest errors within THRESHOLDS, in the middle of its gap, from counts of scores by label (0, 1) and step."""
    if counts.sum(1).min() < LEAST_LABELS:
        return default
    below = np.concatenate((np.zeros((2, 1), np.int64), np.cumsum(counts, 1)), axis=1)
    wrong = below[1] + counts[0].sum() - below[0]
    low, high = (round(t * STEPS) for t in THRESHOLDS)
    best = low + np.flatnonzero(wrong[low : high + 1] == wrong[low : high + 1].min())
    return float(best[len(best) // 2] / STEPS)


def _kept_out(y: np.ndarray) -> np.ndarray:
    """The rows that the net is not trained on: every fifth of a class of ten or more."""
    check = np.zeros(len(y), bool)
    for label in (0, 1):
        at = np.flatnonzero(y == label)
        check[at[::5] if len(at) >= 10 else at[:0]] = True
    return check


def fit(rows: pd.DataFrame, epochs: int = 8) -> tuple[Net, dict[str | None, float]]:
    """From columns text, lang and y: a net trained on four fifths, its scale fitted on the rest, and thresholds by language on these rows alone. The key None holds the threshold of all."""
    rows = rows.reset_index(drop=True)
    y = rows["y"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    net = Net.new()
    if len(set(y.tolist())) < 2:
        net.prior = float(y.mean()) if len(y) else 0.0
        return net, {None: CUT}
    texts = rows["text"].fillna("").tolist()
    check = _kept_out(y)
    take = ~check
    net.train([texts[i] for i in np.flatnonzero(take)], y[take], epochs)
    on = check if check.any() else take
    z = np.log((p := np.clip(_scores(net, [texts[i] for i in np.flatnonzero(on)]), 1e-9, 1 - 1e-9)) / (1 - p))
    a, c, t = 1.0, 0.0, y[on]
    for _ in range(200):  # Platt scaling
        q = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        a, c = max(0.2, a - 0.1 * ((q - t) * z).mean() / max(1.0, (z * z).mean())), c - 0.5 * (q - t).mean()
    net.scale = (float(a), float(c))
    s = _scores(net, texts)
    every = best_cut(s, y, CUT)
    lang = rows["lang"].fillna("\0").to_numpy()
    return net, {None: every} | {str(k): best_cut(s[lang == k], y[lang == k], every) for k in sorted(set(lang))}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def seen_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels that are not held out."""
    return labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def fitting(sizes: pd.DataFrame, rows: int, chars: int) -> list[int]:
    """The index of those of `sizes` (y, n) that are taken: of each class `rows` and `chars` at most, in order."""
    out = []
    for _, some in sizes.groupby("y"):
        taken, used = [], 0
        for at, n in zip(some.index, some["n"], strict=True):
            if len(taken) < rows and used + n <= chars:
                taken.append(at)
                used += n
        out += taken or [some["n"].idxmin()]
    return sorted(out)


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_chars: int) -> pd.DataFrame:
    """At most `fit_rows` labelled texts of each class and half of `fit_chars` characters of each, none held out, those of the lowest id hash; texts are whole.

    A text that does not fit into what is left is passed over, and of a class in which none fits the shortest is taken.
    Only lengths of at most three times as many rows come to the driver before the texts that are taken.
    """
    seen = seen_labels(labels)
    pick = lambda v: seen.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(pick(0).unionAll(pick(1))), "doc_id").withColumn("key", F.xxhash64("text"))
    by = F.xxhash64("doc_id").alias("h")
    sizes = texts.select(by, "doc_id", "key", "y", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct().orderBy("h", "doc_id", "key").limit(3 * 2 * fit_rows).toPandas()
    sizes = sizes.loc[fitting(sizes, fit_rows, fit_chars // 2)]
    chosen = _keys(docs.sparkSession, sizes)
    found = texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).toPandas()
    return found.sort_values(["doc_id", "key"], kind="stable")


def thresholds(docs: DataFrame, labels: DataFrame, net: Net, trained: pd.DataFrame) -> dict[str | None, float]:
    """Thresholds by language from all labelled rows that are neither held out nor among `trained` (doc_id, key). The key None holds the threshold of all."""
    spark = docs.sparkSession
    used = _keys(spark, trained)
    rows = docs.select("doc_id", "text", "lang").join(bounded(seen_labels(labels)), "doc_id").withColumn("key", F.xxhash64("text"))
    rows = rows.join(F.broadcast(used.distinct()), ["doc_id", "key"], "left_anti").select("text", F.coalesce("lang", F.lit("\0")).alias("lang"), "y")
    sc = spark.sparkContext.broadcast(net)

    @tb.tidied
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut, p in judged(sc.value, b):
                at = np.clip(np.floor(p * STEPS), 0, STEPS - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([cut.column("lang"), cut.column("y"), pa.array(at)], ["lang", "y", "step"])

    counts: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(step, "lang string, y int, step int").groupBy("lang", "y", "step").count().collect():
        counts.setdefault(r["lang"], np.zeros((2, STEPS), np.int64))[r["y"], r["step"]] = r["count"]
    every = best_step(sum(counts.values(), np.zeros((2, STEPS), np.int64)), CUT)
    return {None: every} | {k: best_step(counts[k], every) for k in sorted(counts)}


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, epochs: int = 8) -> DataFrame:
    """All columns of `docs` with held_out, score, predicted, threshold (of its language) and rejected (score at or over it)."""
    rows = sample(docs, labels, fit_rows, fit_chars)
    net, cuts = fit(rows, epochs)
    if net.prior is None:
        cuts = thresholds(docs, labels, net, rows[~_kept_out(rows["y"].to_numpy(np.int64))])
    del rows
    tb.trim()
    sc = docs.sparkSession.sparkContext.broadcast(net)

    @tb.tidied
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            for cut, p in judged(sc.value, b):
                yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(p)], [*names, into])

    own = others(docs, "held_out", "score", "predicted", "threshold", "rejected")
    (into,) = fresh(docs.columns, "_score")
    slim = docs.select(*map(quoted, own))
    at = F.lit(cuts[None])
    for lang, cut in cuts.items():
        if lang is not None:
            at = F.when(F.coalesce(F.col("lang"), F.lit("\0")) == lang, F.lit(cut)).otherwise(at)
    scored = slim.mapInArrow(score, T.StructType([*slim.schema.fields, T.StructField(into, T.DoubleType())]))
    value = F.col(into)
    return scored.select(*map(quoted, own), held_out(F.col("doc_id")).alias("held_out"), value.alias("score"), (value >= CUT).cast("int").alias("predicted"), at.alias("threshold"), (value >= at).alias("rejected"))
