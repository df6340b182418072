"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field is trained in numpy on a bounded sample of `labels.quality`: the lines of texts
marked 0 count as boilerplate, those of texts marked 1 as content. Viterbi decoding labels
the lines of every whole text, and the share of words in content lines decides retention.

Defined cases: a null or empty text has no words and no lines, so it fails the base rule;
without usable labels the field has zero weights and every line is content; blank lines are
not part of the sequence; repeated rows are judged one by one; rows with a null id pass
through; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb

#: Bound on the labelled rows that the field is fitted on.
FIT_DOCS = 3000
#: Bound on the lines of one text that the fit uses, a run that begins where a hash of the text says; judging always takes all.
FIT_LINES = 400
#: Least share of words in content lines.
MIN_CONTENT = 0.5
SYMBOLS = ~tb._table("#*$%&|<>")
_UPPER = np.array([0x41 <= b <= 0x5A for b in range(256)])
_LETTER = np.array([0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0xC0 for b in range(256)])
_DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def _step(x: np.ndarray, *cuts: float) -> list[np.ndarray]:
    """One column for each interval that the cuts leave."""
    at = np.searchsorted(np.asarray(cuts), x, "right")
    return [at == i for i in range(len(cuts) + 1)]


def line_features(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts of each text, and for lines with a word their text, words and features."""
    n = len(offs) - 1
    ws, we, wdoc = tb.spans(buf, offs, tb.NONSPACE)
    pre = tb.prefix(buf)
    hashes = tb.span_hash(pre, ws, we)
    win, at = tb.window_hash(hashes, wdoc, 5)
    edge = np.zeros(len(ws) + 1, np.int64)
    hit = at[tb.repeated(tb.keyed(win, wdoc[at]))]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + 5, -1)
    again = np.cumsum(edge)[: len(ws)] > 0
    ls, le, ldoc = tb.lines(buf, offs)
    first, last = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    some = last > first
    ls, le, ldoc, first, last = ls[some], le[some], ldoc[some], first[some], last[some]
    key = tb.keyed(tb.span_hash(pre, ls, le), ldoc)
    twin = tb.repeated(key)
    _, one = np.unique(key, return_index=True)
    words = (last - first).astype(float)
    count = lambda t: tb.within(t[buf], ls, le).astype(float)
    letters = np.maximum(count(_LETTER), 1)
    size = (le - ls).astype(float)
    bang = tb.within(buf == 0x21, ls, le)
    cols = [
        *_step(words, 3, 6, 16),
        *_step(count(SYMBOLS) / words, 0.02, 0.1, 0.3),
        *_step(count(_UPPER) / letters, 0.15, 0.3, 0.6),
        *_step(count(_DIGIT) / size, 0.05, 0.2),
        *_step(bang / words, 0.1, 0.4),
        *_step(tb.within(again, first, last) / words, 0.01, 0.2, 0.6),
        *_step(size / words, 4, 9, 14),
        twin,
        ~twin,
        _STOP[buf[le - 1]] if len(le) else np.zeros(0, bool),
        np.ones(len(ls), bool),
    ]
    return {
        "n_words": np.bincount(wdoc, minlength=n),
        "word_chars": tb.per_text(tb.LEAD[buf] & tb.NONSPACE[buf], offs),
        "n_symbols": tb.per_text(SYMBOLS[buf], offs),
        "n_dup_lines": np.bincount(ldoc, minlength=n) - np.bincount(ldoc[one], minlength=n),
        "n_repeat_words": np.bincount(wdoc, weights=again, minlength=n).astype(np.int64),
        "line_doc": ldoc,
        "line_words": words,
        "features": np.stack(cols, 1) if len(ls) else np.zeros((0, len(cols)), bool),
    }


class LineField:
    """Two labels, 0 content and 1 boilerplate: `emit` (features x 2), `move` (2 x 2) and `start` (2)."""

    def __init__(self, n: int):
        self.emit, self.move, self.start = np.zeros((n, 2)), np.zeros((2, 2)), np.zeros(2)

    def fit(self, sequences: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.5, ridge: float = 1e-3) -> LineField:
        """Gradient ascent on the mean log likelihood; all sequences of one length go through forward-backward at once."""
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for x, y in sequences:
            by_length.setdefault(len(x), []).append((x, y))
        packs = [(np.stack([x for x, _ in v]).astype(float), np.array([y for _, y in v])) for k, v in sorted(by_length.items()) if k]
        total = sum(x.shape[0] * x.shape[1] for x, _ in packs)
        if not total or len({y for _, y in sequences}) < 2:
            return self
        speed = [np.full_like(p, 1e-8) for p in (self.emit, self.move, self.start)]
        for _ in range(rounds):
            grads = [-ridge * self.emit * total, -ridge * self.move * total, -ridge * self.start * total]
            for x, y in packs:
                self._gradient(x, y, grads)
            for p, g, s in zip((self.emit, self.move, self.start), grads, speed, strict=True):
                g = g / total
                s += g * g
                p += rate * g / np.sqrt(s)
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray, grads: list[np.ndarray]) -> None:
        m, n, _ = x.shape
        score = x @ self.emit
        score[:, 0] += self.start
        fwd, bwd = np.empty((m, n, 2)), np.zeros((m, n, 2))
        fwd[:, 0] = score[:, 0]
        for t in range(1, n):
            fwd[:, t] = score[:, t] + np.logaddexp(fwd[:, t - 1, :1] + self.move[0], fwd[:, t - 1, 1:] + self.move[1])
        for t in range(n - 2, -1, -1):
            nxt = score[:, t + 1] + bwd[:, t + 1]
            bwd[:, t] = np.logaddexp(self.move[:, 0] + nxt[:, :1], self.move[:, 1] + nxt[:, 1:])
        log_z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])[:, None, None]
        node = -np.exp(fwd + bwd - log_z)
        node[np.arange(m), :, y] += 1
        grads[0] += np.einsum("mnf,mnk->fk", x, node)
        grads[2] += node[:, 0].sum(0)
        if n > 1:
            pair = np.exp(fwd[:, :-1, :, None] + self.move + (score + bwd)[:, 1:, None, :] - log_z[..., None])
            grads[1] -= pair.sum((0, 1))
            grads[1][[0, 1], [0, 1]] += np.bincount(y, minlength=2) * (n - 1)

    def decode(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Viterbi labels of the lines; a tie goes to content."""
        score = features.astype(float) @ self.emit
        gain = (score[:, 1] - score[:, 0]).tolist()
        new = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        fresh = new.tolist()
        (cc, cb), (bc, bb) = self.move.tolist()
        s = float(self.start[1] - self.start[0])
        d = 0.0  # lead of boilerplate over content
        back: list[tuple[int, int]] = []
        leads: list[float] = []
        for g, f in zip(gain, fresh, strict=True):
            if f:
                d = s + g
                back.append((0, 0))
            else:
                to_c, to_b = d + bc > cc, d + bb > cb
                d = max(cb, d + bb) - max(cc, d + bc) + g
                back.append((to_c, to_b))
            leads.append(d)
        out = np.zeros(len(gain), np.int8)
        label = 0
        for i in range(len(gain) - 1, -1, -1):
            if i == len(gain) - 1 or fresh[i + 1]:
                label = int(leads[i] > 0)
            else:
                label = int(back[i + 1][label])
            out[i] = label
        return out


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> LineField:
    """Fits on at most `fit_docs` labelled texts, those of the lowest id hash; their line features come to the driver, not their texts."""
    chosen = (
        labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg((1 - F.max("quality")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("key"), "text", F.col("y").cast("int").alias("y"))

    @tb.tidied
    def feats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            for i, j, buf, offs in tb.chunks(b.column("text")):
                got = line_features(buf, offs)
                cut = np.searchsorted(got["line_doc"], np.arange(j - i + 1)).tolist()
                at = [p + key % max(1, q - p - FIT_LINES + 1) for p, q, key in zip(cut, cut[1:], keys[i:j], strict=False)]
                made = [np.packbits(got["features"][p : min(q, p + FIT_LINES)], axis=1).tobytes() for p, q in zip(at, cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[i:j], pa.int64()), pa.array(made, pa.binary()), b.column("y").slice(i, j - i)], ["key", "x", "y"])

    width = line_features(np.zeros(0, np.uint8), np.zeros(1, np.int64))["features"].shape[1]
    # rows that repeat an id and text count once, and an id with many texts can't bring more than the bound
    found = rows.mapInArrow(feats, "key long, x binary, y int").dropDuplicates(["key"]).orderBy("key").limit(fit_docs).toPandas()
    unpack = lambda x: np.unpackbits(np.frombuffer(x, np.uint8).reshape(-1, -(-width // 8)), axis=1)[:, :width]
    found = found.sort_values(["y", "x"])
    return LineField(width).fit([(unpack(x), int(y)) for x, y in zip(found["x"], found["y"], strict=True)])


def quality_rules(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT, fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row per document with the base counts, the content share and the verdict."""
    field = fit(docs, labels, fit_docs)

    @tb.tidied
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offs in tb.chunks(b.column("text")):
                got = line_features(buf, offs)
                content = field.decode(got["features"], got["line_doc"]) == 0
                n = got["n_words"]
                share = np.bincount(got["line_doc"], weights=got["line_words"] * content, minlength=j - i) / np.maximum(n, 1)
                failed = (n < 10) | (100 * got["n_repeat_words"] > 20 * n)
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                arrays = [b.column("doc_id").slice(i, j - i), *(pa.array(got[k].astype(np.int64)) for k in names)]
                arrays += [pa.array(share), pa.array(failed), pa.array(~failed & (share >= min_content))]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, SCHEMA)
