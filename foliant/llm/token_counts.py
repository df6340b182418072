"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic
programming carries the best score and the piece count of that best path and no
back-pointers. Ties follow the tokenizer: at each end the longest of equally good pieces.

Defined cases: a null or empty text has 0 tokens; unknown characters count as their bytes
under byte fallback, else each run of them counts once; very long texts are counted whole;
repeated rows are counted one by one; other columns are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from foliant.llm import textbytes as tb
from foliant.llm import unigram as ug
from foliant.llm.components import others, quoted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class Counter:
    """Piece counts of texts; those of islands are remembered up to a bound. What stands between two spaces is an island with the mark of the first."""

    def __init__(self, model: ug.Unigram, room: int = 2 * ug.CACHE):
        self.model = model
        self.head = ug.SPACE if model.vocabulary.dummy_prefix else ""
        self.bytes = model.vocabulary.byte_fallback and len(model.byte_ids) == 256
        self.words = ug.Memory(lambda word: self.count(ug.SPACE + word), room)

    def count(self, island: str) -> int:
        n = len(island)
        if self.model.single.issuperset(island):  # no unknown character: every node is reached
            top: list[float] = [0] + [float("-inf")] * n
            start, many = [0] * (n + 1), [0] * (n + 1)
            for end, (size, _, score) in self.model.found.iter(island):
                end += 1
                begin = end - size
                x = top[begin] + score
                if x > top[end] or (x == top[end] and begin < start[end]):
                    top[end], start[end], many[end] = x, begin, many[begin] + 1
            return many[n]
        best, many, unknown = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        single, unk = self.model.single, self.model.unk_score
        at, high, took, lost = 0, None, 0, False
        longest = 0
        found = self.model.found.iter(island)
        nxt = next(found, None)
        for e in range(1, n + 1):
            high, longest = None, 0
            while nxt is not None and nxt[0] == e - 1:
                size, _, score = nxt[1]
                x = best[e - size] + score
                if high is None or x > high or (x == high and size > longest):
                    high, took, longest, lost = x, many[e - size] + 1, size, False
                nxt = next(found, None)
            at = e - 1
            if island[at] not in single and (high is None or best[at] + unk > high):
                high, lost = best[at] + unk, True
                took = many[at] + (len(island[at].encode()) if self.bytes else 0 if unknown[at] else 1)
            best[e], many[e], unknown[e] = high, took, lost
        return many[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        if self.model.cuts and self.head and ug.SPACE not in text:
            words = text.split(" ")
            if "" not in words:
                return sum(map(self.words.__getitem__, words))
        return sum(map(self.count, self.model.islands(self.model.prepare(text))))


def token_counts(docs: DataFrame, model_path: str = MODEL, column: str = "text", into: str = "n_tokens") -> DataFrame:
    """`docs` with the number of tokens of `column`."""
    vocabulary = ug.Vocabulary.load(model_path)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own = others(docs, into.lower())
    docs = docs.select(*map(quoted, own))

    @tb.tidied
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ug.shared(sent.value))
        for b in batches:
            n = np.fromiter((counter.text(x) for x in _strings(b.column(column))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n)], [*own, into])

    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, T.StructField(into, T.LongType())]))


def _strings(column: pa.Array, step: int = 500) -> Iterator[str]:
    """Values one by one, a few at a time in Python's memory."""
    for i in range(0, len(column), step):
        yield from (x or "" for x in column.slice(i, step).to_pylist())


def count_by_path(model: ug.Unigram, text: str) -> int:
    """The same count from the whole best path, for tests."""
    s = model.prepare(text or "")
    return len(model.solve(s)) if s else 0


