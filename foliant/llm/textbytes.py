"""Vectorised helpers over the UTF-8 bytes of an Arrow text column.

All separators used by the operators are ASCII, so words and lines are found on bytes;
a null text counts as an empty one. Work goes in chunks of about CHUNK_BYTES, and a
longer text is a chunk of its own, so memory follows the longest single text.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(chars: str) -> np.ndarray:
    out = np.ones(256, bool)
    out[[ord(c) for c in chars]] = False
    return out


#: words of [^\x20\x09-\x0D]+
NONSPACE = _table(" \t\n\x0b\x0c\r")
#: words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
#: bytes that begin a code point
LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pow(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i < n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1 if base == _BYTE_BASE else 1 << 16)
        made = []
        for b in (base, np.uint64(pow(int(base), -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
        got = (made[0], made[1])
        if size <= 2 * CHUNK_BYTES:
            _powers[int(base)] = got
    return got


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() takes the hash of any byte span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _pow(_BYTE_BASE, len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = _pow(_BYTE_BASE, len(pre))[1]
    return mix((pre[ends] - pre[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * _WORD_BASE)


def window_hash(hashes: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one group (text), and where each begins."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, inv = _pow(_WORD_BASE, n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=pre[1:])
    at = np.flatnonzero(group[: n - k + 1] == group[k - 1 :])
    return mix((pre[at + k] - pre[at]) * inv[at] + np.uint64(k)), at


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `limit` bytes."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that `table` marks."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = table[buf]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    before = np.concatenate(([False], m[:-1]))
    before[heads] = False
    after = np.concatenate((m[1:], [False]))
    after[heads[heads > 0] - 1] = False
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (without the newline) and text numbers of the lines, split at \\n; none in an empty text."""
    cut = np.flatnonzero(buf == 10)
    heads = offs[:-1][offs[:-1] < offs[1:]]
    starts = np.sort(np.concatenate((heads, cut + 1)))
    doc = np.searchsorted(offs, starts, "right") - 1
    # a newline at the end of a text opens an empty last line, which begins where the next text does
    extra = np.isin(starts, heads) & np.concatenate(([False], starts[1:] == starts[:-1]))
    last = np.flatnonzero(np.concatenate((extra[1:], [False])))
    doc[last] = np.searchsorted(offs, starts[last] - 1, "right") - 1
    doc[starts == len(buf)] = np.searchsorted(offs, len(buf) - 1, "right") - 1
    ends = np.minimum(np.concatenate((starts[1:], [len(buf)])), offs[doc + 1])
    has_cut = (ends > starts) & (buf[np.maximum(ends - 1, 0)] == 10)
    return starts, ends - has_cut, doc


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Count of marked bytes in each text."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[offs[1:]] - total[offs[:-1]]


def within(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `marks` over each [start, end)."""
    total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
    return total[ends] - total[starts]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Marks each key that occurs twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(len(keys), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    return hit


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes told apart by text."""
    return mix(hashes + (doc.astype(np.uint64) + np.uint64(1)) * _BYTE_BASE)


def trim() -> None:
    """Gives memory that a fit has used back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives memory back when its task ends, since workers that wait for other tasks keep theirs."""

    @wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
