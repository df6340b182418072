"""Model seams: batch functions behind Arrow UDFs, with deterministic offline defaults."""

from __future__ import annotations

import hashlib
import itertools
import time
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


#: Line ends, tabs and spaces of every width.
BLANKS = "\t\n\f\r" + "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")


class Models(Protocol):
    """What a deployment provides; each method takes and gives lists of one batch."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def rerank(self, queries: list[str], texts: list[str]) -> list[float]: ...
    def enrich(self, kinds: list[str], images: list[bytes], contexts: list[str]) -> list[str]: ...
    def generate(self, prompts: list[str]) -> list[str]: ...


class Offline:
    """Hashed bag-of-words vectors, word overlap, and an extractive answer that cites the first chunk.

    Every text with more than spaces, tabs and line ends has a vector of length 1: one whose words cancel out, or that has only other blanks, gets the place of its hash.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        hashed = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = hashed(w)
                out[i, h % self.dim] += 1 if h >> 63 else -1
            if not out[i].any() and (t or "").strip(BLANKS):
                out[i, hashed(t.lower()) % self.dim] = 1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()

    def rerank(self, queries: list[str], texts: list[str]) -> list[float]:
        pairs = zip(queries, texts, strict=True)
        return [len(set(q.lower().split()) & set(t.lower().split())) / max(1, len(set(q.lower().split()))) for q, t in pairs]

    def enrich(self, kinds: list[str], images: list[bytes], contexts: list[str]) -> list[str]:
        return ['{"description": "", "figure_type": "figure", "relevant": true}' if k == "picture" else '{"markdown": ""}' for k in kinds]

    def generate(self, prompts: list[str]) -> list[str]:
        return ['See [1].\n```sources\n[{"ref": 1, "document_id": "", "page_no": null, "chunk_type": "", "excerpt": ""}]\n```' for _ in prompts]


class ClientError(Exception):
    """An instance says that the request itself is wrong; it is not sent again."""


class Throttled(Exception):
    """An instance asks for fewer requests."""


def failover(instances: Sequence[Callable], attempts: int = 3, delay: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Callable:
    """A call that tries each instance once, the next one first each time, and all of them again after a pause that doubles.

    A pause is twice as long after a throttled round. A ClientError ends the call at once; else the last error does.
    """
    turn = itertools.count()

    def call(*args: object) -> object:
        pause, last = delay, None
        for k in range(attempts):
            first, throttled = next(turn), False
            for i in range(len(instances)):
                try:
                    return instances[(first + i) % len(instances)](*args)
                except ClientError:
                    raise
                except Exception as e:
                    last, throttled = e, throttled or isinstance(e, Throttled)
            if k + 1 < attempts:
                wait(pause * (2 if throttled else 1))
                pause *= 2
        raise last or RuntimeError("no instances")

    return call


def embed(text: Column, models: Models, batch: int = 512) -> Column:
    """Vectors of a text column; a batch that fails yields empty vectors for its rows alone (failover() makes methods that try again)."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[list[float]] = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].fillna("").tolist()
                try:
                    got = models.embed(texts)
                except Exception:
                    got = [[] for _ in texts]
                out += [[] if not t else v for t, v in zip(texts, got, strict=True)]
            yield pd.Series(out)

    return F.pandas_udf(run, "array<float>")(text)


def _one_by_one(models: Models, texts: list[str]) -> list[list[float]]:
    """Vectors of a batch; if it fails each text is tried alone, and only those that fail then have none."""
    try:
        return models.embed(texts)
    except Exception:
        return [[]] if len(texts) == 1 else [_one_by_one(models, [t])[0] for t in texts]


def timed_embed(text: Column, models: Models, batch: int = 512) -> Column:
    """Struct of the vector of embed() and the text's share of the seconds that its batch took."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            vectors: list[list[float]] = []
            seconds: list[float] = []
            for i in range(0, len(s), batch):
                texts = s.iloc[i : i + batch].fillna("").tolist()
                began = time.perf_counter()
                got = _one_by_one(models, texts)
                seconds += [(time.perf_counter() - began) / len(texts)] * len(texts)
                vectors += [[] if not t else v for t, v in zip(texts, got, strict=True)]
            yield pd.DataFrame({"vector": vectors, "seconds": seconds})

    return F.pandas_udf(run, "vector array<float>, seconds double")(text)


def rerank_scorer(models: Models):
    """A scorer for operators.retrieval.rerank(); a failing batch has no scores."""

    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(models.rerank(q.tolist(), t.tolist()), dtype="float64")
        except Exception:
            return pd.Series([None] * len(q), dtype="float64")

    udf = F.pandas_udf(run, "double")
    return lambda query, text: udf(query, text)


def generate(prompt: Column, models: Models) -> Column:
    return F.pandas_udf(lambda s: pd.Series(models.generate(s.tolist())), "string")(prompt)
