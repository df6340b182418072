"""SentencePiece encoding and decoding by a max-plus parallel scan.

A long text is cut into chunks at fixed places. A piece may run over a chunk's end, so the
state at a boundary is how many characters it runs over. Each chunk yields the matrix of
best scores from the states at its start to those at its end; max-plus products of such
matrices are associative, so blocks of chunks are combined at once and then scanned,
which gives the scores of the states at every boundary. With these each chunk is traced
back alone, for every state at its end, and the maps from end state to start state are
composed from the last chunk to the first, block by block. A text of less than two chunks has no boundary
to scan over and is solved in one task, word by word.

Scores are whole numbers, so results do not depend on how a text is cut. Ties follow the
library: at each end the longest of equally good pieces.

Defined cases: a null or empty text has no ids and decodes to an empty text; unknown
characters become byte pieces under byte fallback; rows that repeat are encoded alike; long
texts are told apart by their digest, so rows with one id and different texts stay apart;
columns of `docs` are kept, but for one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foliant.llm import textbytes as tb
from foliant.llm import unigram as ug
from foliant.llm.components import cut, fresh, others, quoted
from foliant.llm.token_counts import MODEL

if TYPE_CHECKING:
    import pandas as pd

#: Characters of a chunk; texts of two chunks and more are spread over tasks. BLOCK chunks are combined at a time.
CHUNK_CHARS, BLOCK = 1 << 14, 64
#: Rows and bytes of a batch sent to Python that keep its memory small: a row holds a whole text and its ids.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Rows and bytes of the texts that are encoded together, and words that a worker remembers from one batch to the next.
PART_ROWS, PART_BYTES, REMEMBER = 500, 1 << 20, 60_000
_NONE = -(1 << 62)


class Encoder:
    """Ids of texts as bytes. The different islands of a batch of texts are solved together, and remembered up to a bound.

    An island goes by its word, without the one mark that it begins with; others go by themselves, with a mark before them if they have none.
    """

    def __init__(self, model: ug.Unigram, room: int = REMEMBER):
        self.model, self.room = model, room
        self.words: dict[str, bytes] = {}

    def _words(self, s: str) -> list[str]:
        if s.startswith(ug.SPACE):
            words = s[1:].split(ug.SPACE)
            if "" not in words:
                return words
        one = lambda x: x[1:] if x[1:2] not in ("", ug.SPACE) else x
        return [one(x) if x.startswith(ug.SPACE) else ug.SPACE + x for x in self.model.islands(s)]

    def prepared(self, texts: list[str]) -> list[bytes]:
        """Ids of prepared texts, or of parts between two cuts."""
        if not self.model.cuts:
            return [np.array([i for x in self.model.islands(s) for i in self.model.solve(x)], np.int32).tobytes() for s in texts]
        split = [self._words(s) for s in texts]
        wanted = set().union(*split)
        new = wanted - self.words.keys()
        if len(self.words) + len(new) > self.room:
            self.words = {w: self.words[w] for w in wanted - new}
        solved = self.model.solve_all([ug.SPACE + w if not w.startswith(ug.SPACE) else w[1:] if w[1:2] not in ("", ug.SPACE) else w for w in new])
        self.words.update(zip(new, solved, strict=True))
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > ug.REMEMBERED:
                del self.words[w]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        return self.prepared([self.model.prepare(x) if x else "" for x in texts])


class ChunkLattice:
    """One chunk `core` followed by `halo`, the characters that a last piece may run over."""

    def __init__(self, model: ug.Unigram, core: str, halo: str, before: str):
        self.model, self.s, self.n = model, core + halo, len(core)
        self.states = max(1, model.longest)
        is_cut = lambda i: core[i] == ug.SPACE and (core[i - 1] if i else before) != ug.SPACE
        self.head = next((i for i in range(self.n) if is_cut(i)), None) if model.cuts else None
        self.tail = next((i for i in range(self.n - 1, -1, -1) if is_cut(i)), None) if self.head is not None else None

    def _ends(self, best: list[int | None], at: int) -> list[int]:
        """Scores of the states at the chunk's end, of a lattice that begins at `at`."""
        got = [best[self.n - at + o] if self.n - at + o < len(best) else None for o in range(self.states)]
        return [_NONE if x is None else x for x in got]

    def matrix(self) -> np.ndarray:
        """states x states best scores; _NONE where no path leads.

        All paths take the same way between the first and the last cut, so its score, the same in all
        cells, is left out: no choice depends on it.
        """
        out = np.full((self.states, self.states), _NONE, np.int64)
        if self.head is None:
            for o in range(min(self.states, len(self.s) + 1)):
                if o >= self.n:
                    out[o, o - self.n] = max(out[o, o - self.n], 0)
                else:
                    best, _ = self.model.lattice(self.s[o:], self.n - o)
                    out[o] = self._ends(best, o)
            return out
        ends = np.array(self._ends(self.model.lattice(self.s[self.tail :], self.n - self.tail)[0], self.tail))
        for o in range(min(self.states, self.head + 1)):
            best = self.model.lattice(self.s[o : self.head])[0][-1]
            out[o] = np.where(ends > _NONE, ends + best, _NONE)
        return out

    def traces(self, entry: np.ndarray, encoder: Encoder) -> Iterator[tuple[int, int, bytes]]:
        """(end state, start state, ids of the pieces that start in the chunk) for each end state that can be reached."""
        m, starts = self.model, {o: int(x) for o, x in enumerate(entry) if x > _NONE}
        pack = lambda path: np.array(m.ids(path), np.int32).tobytes()
        if self.head is None:
            best, back = m.lattice(self.s, self.n, {o: x for o, x in starts.items() if o <= len(self.s)})
            for o, x in enumerate(self._ends(best, 0)):
                if x > _NONE:
                    path, begin = m.trace(self.s, back, self.n + o)
                    yield o, begin, pack(path)
            return
        best, back = m.lattice(self.s[: self.head], None, {o: x for o, x in starts.items() if o <= self.head})
        path, begin = m.trace(self.s[: self.head], back, self.head)
        front = pack(path) + encoder.prepared([self.s[self.head : self.tail]])[0]
        s = self.s[self.tail :]
        best, back = m.lattice(s, self.n - self.tail)
        for o, x in enumerate(self._ends(best, self.tail)):
            if x > _NONE:
                yield o, begin, front + pack(m.trace(s, back, self.n - self.tail + o)[0])


def times(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Max-plus product of a vector or matrix with a matrix."""
    x = np.where((v[..., :, None] > _NONE) & (m > _NONE), v[..., :, None] + m, _NONE)
    return x.max(-2)


def cut_text(model: ug.Unigram, text: str, size: int) -> Iterator[tuple[int, str, str, str]]:
    """(number, core, halo, character before) of a prepared text's chunks."""
    s = model.prepare(text)
    for k, i in enumerate(range(0, len(s), size)):
        yield k, s[i : i + size], s[i + size : i + size + model.longest - 1], s[i - 1 : i]


def scan_entries(first: np.ndarray, matrices: list[np.ndarray]) -> list[np.ndarray]:
    """The boundary scores before each of the matrices."""
    out = [first]
    for m in matrices[:-1]:
        out.append(times(out[-1], m))
    return out


def parts_of(column: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of rows in order, of at most PART_ROWS rows and PART_BYTES bytes or one text."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    i = 0
    while i < len(column):
        j = min(max(i + 1, int(np.searchsorted(size, size[i] + PART_BYTES, "right")) - 1), i + PART_ROWS)
        yield i, j
        i = j


def _start(states: int) -> np.ndarray:
    v = np.full(states, _NONE, np.int64)
    v[0] = 0
    return v


def _vec(blob: bytes, states: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(-1, states)


def encode_long(texts: DataFrame, sent: Broadcast, chunk_chars: int = CHUNK_CHARS, block: int = BLOCK) -> DataFrame:
    """Ids of distinct long texts: (digest, text) to (digest, ids binary)."""
    import pandas as pd  # here, as it would take some 40 MB of each worker that encodes short texts alone

    size = max(chunk_chars, 1)

    @tb.tidied
    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ug.shared(sent.value)
        for b in batches:
            for digest, text in zip(b["digest"], b["text"], strict=True):
                for row in cut_text(model, text, size):
                    yield pd.DataFrame([(digest, *row)], columns=["digest", "k", "core", "halo", "before"])

    @tb.tidied
    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ug.shared(sent.value)
        for b in batches:
            made = [ChunkLattice(model, c, h, p).matrix().tobytes() for c, h, p in zip(b["core"], b["halo"], b["before"], strict=True)]
            yield pd.DataFrame({"digest": b["digest"], "block": b["k"] // block, "k": b["k"], "m": made})

    def combine(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        states = ug.shared(sent.value).longest
        got = None
        for blob in b.sort_values("k")["m"]:
            m = _vec(blob, states)
            got = m if got is None else times(got, m)
        return pd.DataFrame([(key[0], key[1], got.tobytes())], columns=["digest", "block", "m"])

    def enter(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """Boundary scores before each block (or, within one, each chunk)."""
        states = ug.shared(sent.value).longest
        b = b.sort_values("block" if "k" not in b else "k")
        first = _start(states) if "v" not in b else _vec(b["v"].iloc[0], states)[0]
        vs = scan_entries(first, [_vec(x, states) for x in b["m"]])
        return b.drop(columns=["m", "v"], errors="ignore").assign(v=[v.tobytes() for v in vs])

    @tb.tidied
    def traces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ug.shared(sent.value)
        encoder = Encoder(model)
        for b in batches:
            for r in b.itertuples():
                lattice = ChunkLattice(model, r.core, r.halo, r.before)
                rows = [(r.digest, r.k // block, r.k, o, s, ids) for o, s, ids in lattice.traces(_vec(r.v, lattice.states)[0], encoder)]
                yield pd.DataFrame(rows, columns=["digest", "block", "k", "o", "s", "ids"])

    def maps(b: pd.DataFrame) -> list[tuple[int, dict[int, int]]]:
        out: dict[int, dict[int, int]] = {}
        for k, o, s in zip(b["at"], b["o"], b["s"], strict=True):
            out.setdefault(int(k), {})[int(o)] = int(s)
        return sorted(out.items(), reverse=True)

    def join_maps(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """The map of a block: from the state at its end to that at its start."""
        steps = maps(b)
        rows = []
        for o in steps[0][1]:
            s: int | None = o
            for _, m in steps:
                s = m.get(s) if s is not None else None
            if s is not None:
                rows.append((key[0], key[1], o, s))
        return pd.DataFrame(rows, columns=["digest", "at", "o", "s"])

    def leave(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        """The end state of each block (or chunk) on the best path."""
        state = int(b["end"].iloc[0]) if "end" in b else 0
        rows = []
        for k, m in maps(b):
            rows.append((key[0], k, state))
            state = m[state]
        return pd.DataFrame(rows, columns=["digest", "at", "end"])

    parts = cut(texts.mapInPandas(chunks, "digest string, k long, core string, halo string, before string").repartition("digest", "k"))
    mats = cut(parts.mapInPandas(matrices, "digest string, block long, k long, m binary"))
    blocks = mats.groupBy("digest", "block").applyInPandas(combine, "digest string, block long, m binary")
    before = blocks.groupBy("digest").applyInPandas(enter, "digest string, block long, v binary")
    entries = mats.join(before, ["digest", "block"]).groupBy("digest", "block").applyInPandas(enter, "digest string, block long, k long, v binary")
    traced = cut(parts.join(entries, ["digest", "k"]).mapInPandas(traces, "digest string, block long, k long, o int, s int, ids binary"))
    steps = traced.select("digest", "block", F.col("k").alias("at"), "o", "s")
    whole = steps.groupBy("digest", "block").applyInPandas(join_maps, "digest string, at long, o int, s int")
    ends = whole.groupBy("digest").applyInPandas(leave, "digest string, at long, end int").withColumnRenamed("at", "block")
    path = steps.join(ends, ["digest", "block"]).groupBy("digest", "block").applyInPandas(leave, "digest string, at long, end int")
    taken = traced.join(path.select("digest", F.col("at").alias("k"), F.col("end").alias("o")), ["digest", "k", "o"])
    out = taken.groupBy("digest").agg(F.expr("listagg(ids) within group (order by k)").alias("ids"))
    if sent.value.byte_fallback:
        return out

    @tb.tidied
    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A run of unknown characters that chunks have cut is one unknown piece again."""
        unk = ug.shared(sent.value).unk_id
        for b in batches:
            arrays = [np.frombuffer(x or b"", np.int32) for x in b["ids"]]
            yield b.assign(ids=[a[~((a == unk) & (np.concatenate(([-1], a[:-1])) == unk))].tobytes() if len(a) else b"" for a in arrays])

    return out.mapInPandas(collapse, "digest string, ids binary")


def encode(docs: DataFrame, model_path: str = MODEL, column: str = "text", into: str = "ids", chunk_chars: int = CHUNK_CHARS, decoded: str | None = None) -> DataFrame:
    """`docs` with the ids of `column`, four bytes each, lowest first (unpack() reads them), and if `decoded` is named the text of these ids.

    Decoding here takes the same pass, and so one Python worker a task instead of the two that decode() after encode() has.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ug.Vocabulary.load(model_path))
    made = [into] if decoded is None else [into, decoded]
    own = others(docs, *(x.lower() for x in made))
    docs = docs.select(*map(quoted, own))

    @tb.tidied
    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ug.shared(sent.value)
        encoder = Encoder(model)
        for b in batches:
            for i, j in parts_of(b.column(column)):
                part = b.slice(i, j - i)
                ids = encoder.texts([x or "" for x in part.column(column).to_pylist()])
                back = [] if decoded is None else [pa.array([model.decode(unpack(x)) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), *back], [*own, *made])

    size = F.coalesce(F.length(column), F.lit(0))
    (digest,) = fresh([*own, *made], "_digest")
    fields = [T.StructField(into, T.BinaryType()), T.StructField(decoded or "", T.StringType())][: len(made)]
    small = docs.where(size < 2 * chunk_chars).mapInArrow(short, T.StructType([*docs.schema.fields, *fields]))
    large = docs.where(size >= 2 * chunk_chars).withColumn(digest, F.sha2(F.col(column).cast("binary"), 256))
    texts = large.select(F.col(digest).alias("digest"), F.col(column).alias("text")).dropDuplicates(["digest"])
    ids = encode_long(texts, sent, chunk_chars).select(F.col("digest").alias(digest), F.col("ids").alias(into))
    large = large.join(ids, digest, "left").select(*map(quoted, own), quoted(into))
    return small.unionByName(large if decoded is None else decode(large, model_path, into, decoded))


def decode(encoded: DataFrame, model_path: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """`encoded` with the text of its ids."""
    sent = encoded.sparkSession.sparkContext.broadcast(ug.Vocabulary.load(model_path))
    own = others(encoded, into.lower())
    encoded = encoded.select(*map(quoted, own))

    @tb.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ug.shared(sent.value)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = [model.decode(unpack(x)) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.string())], [*own, into])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))


def small_batches(spark: SparkSession) -> None:
    """For applications: sets the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes at most, which bounds the memory of Python workers and of what is sent to them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def unpack(ids: bytes | None) -> list[int]:
    return np.frombuffer(ids or b"", np.int32).tolist()
