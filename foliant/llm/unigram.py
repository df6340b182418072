"""A SentencePiece vocabulary read as a unigram model, with exact best segmentations.

The pieces and scores come from a model file, whatever algorithm it was trained for; scores
of BLOCKED and less, which merge models give to pieces that they never build, count as one less
than the lowest other score. Scores are whole numbers of 1 / `scale`, so
sums are exact and the order of additions never matters. A character that is no piece costs
the least score less 10, and with byte fallback it counts as its bytes. Among equal
scores the library's rule holds: at each end the piece that starts first wins.

No piece continues over a mark for a space that follows another character, so a text falls
apart there: every path passes such a cut, and what lies between two cuts (an island) is
solved alone and remembered while there is room.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np

SPACE = "▁"
BLOCKED = -1e8
#: Islands that a worker remembers: those met since the last turn, and as many before.
CACHE = 150_000
#: Longest island that is remembered, in characters, so that the bound on islands bounds memory.
REMEMBERED = 64

#: Places (words x longest word) that solve_all() takes at a time.
PLACES = 1 << 15
#: What stands behind a word's end where words of several lengths are in one array.
_PAST = 0x110000

NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6


@dataclass(frozen=True)
class Vocabulary:
    """What a model file holds, in a form that can be sent to executors (about half a megabyte)."""

    pieces: tuple[tuple[str, float, int], ...]
    dummy_prefix: bool
    byte_fallback: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads the file on the driver. Only models without text normalisation are taken."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only models with identity normalisation and escaped, untrimmed whitespace are supported")
        floor = min((p.score for p in proto.pieces if p.type == NORMAL and p.score > BLOCKED), default=0.0) - 1
        return cls(tuple((p.piece, p.score if p.score > BLOCKED else floor, p.type) for p in proto.pieces), norm.add_dummy_prefix, proto.trainer_spec.byte_fallback)


class Unigram:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        usable = [(p, i, s, k) for i, (p, s, k) in enumerate(v.pieces) if k in (NORMAL, USER)]
        normal = [s for _, _, s, k in usable if k == NORMAL]
        top, low = max(normal, default=0.0), min(normal, default=0.0)
        score = {p: len(p.encode()) * top - 0.1 if k == USER else s for p, _, s, k in usable}
        self.scale = 1 if all(float(s).is_integer() for s in score.values()) else 1 << 20
        self.unk_score = round((low - 10) * self.scale)
        self.unk_id = next((i for i, (_, _, k) in enumerate(v.pieces) if k == UNKNOWN), 0)
        self.byte_ids = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(v.pieces) if k == BYTE}
        self.longest = max((len(p) for p, *_ in usable), default=1)
        self.found = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.weights = {p: (i, round(score[p] * self.scale)) for p, i, _, _ in usable}
        for p, (i, weight) in self.weights.items():
            self.found.add_word(p, (len(p), i, weight))
            if len(p) == 1:
                self.single.add(p)
        self.found.make_automaton()
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p, *_ in usable)
        text = [b""] * len(v.pieces)
        for i, (p, _, k) in enumerate(v.pieces):
            text[i] = p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else bytes([int(p[3:-1], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b""
        self.text = text

    def prepare(self, text: str) -> str:
        out = text.replace(" ", SPACE)
        return SPACE + out if out and self.vocabulary.dummy_prefix else out

    def islands(self, prepared: str) -> list[str]:
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", prepared) if self.cuts else [prepared] if prepared else []

    def lattice(self, s: str, core: int | None = None, entry: dict[int, int] | None = None) -> tuple[list[int | None], list[tuple[int, int] | None]]:
        """Best score of each node of `s` and the (start, id) of the piece that ends there; id -1 is an unknown character.

        Pieces start before `core` only. `entry` gives the nodes where paths begin and their scores.
        """
        n = len(s)
        core = n if core is None else core
        best: list[int | None] = [None] * (n + 1)
        back: list[tuple[int, int] | None] = [None] * (n + 1)
        for node, score in (entry if entry is not None else {0: 0}).items():
            best[node] = score
        by_end: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        for end, match in self.found.iter(s):
            by_end[end].append(match)
        for e in range(1, n + 1):
            top, came = best[e], back[e]
            found = by_end[e - 1]
            if len(found) > 1:
                found.sort(reverse=True)  # the longest first, so that a later equal never wins
            if entry is not None and top is not None:
                came = None  # an entry node: the piece that ends here began before the chunk
            for size, piece, score in found:
                start = e - size
                if start < core and (b := best[start]) is not None and (top is None or b + score > top or (b + score == top and came is not None and start < came[0])):
                    top, came = b + score, (start, piece)
            if s[e - 1] not in self.single and e - 1 < core and (b := best[e - 1]) is not None and (top is None or b + self.unk_score > top):
                top, came = b + self.unk_score, (e - 1, -1)
            best[e], back[e] = top, came
        return best, back

    def trace(self, s: str, back: list[tuple[int, int] | None], node: int) -> tuple[list[tuple[int, str]], int]:
        """Pieces (id, surface) of the best path that ends at `node`, and the node where it began."""
        out = []
        while (b := back[node]) is not None:
            out.append((b[1], s[b[0] : node]))
            node = b[0]
        return out[::-1], node

    def ids(self, path: list[tuple[int, str]]) -> list[int]:
        """Ids of a path; unknown characters become byte pieces, or one unknown piece for each run without byte fallback."""
        out: list[int] = []
        fallback = self.vocabulary.byte_fallback and len(self.byte_ids) == 256
        was = False
        for piece, surface in path:
            if piece >= 0:
                out.append(piece)
            elif fallback:
                out += [self.byte_ids[b] for b in surface.encode()]
            elif not was:
                out.append(self.unk_id)
            was = piece < 0
        return out

    def solve(self, island: str) -> list[int]:
        """Ids of the best path; without unknown characters every node is reached, which saves the general lattice."""
        if not self.single.issuperset(island):
            best, back = self.lattice(island)
            return self.ids(self.trace(island, back, len(island))[0])
        n = len(island)
        best: list[float] = [0] + [float("-inf")] * n
        start, piece = [0] * (n + 1), [0] * (n + 1)
        for end, (size, which, score) in self.found.iter(island):
            end += 1
            begin = end - size
            x = best[begin] + score
            if x > best[end] or (x == best[end] and begin < start[end]):
                best[end], start[end], piece[end] = x, begin, which
        out = []
        while n:
            out.append(piece[n])
            n = start[n]
        return out[::-1]

    @cached_property
    def trie(self) -> Trie:
        return Trie(self)

    def solve_all(self, islands: list[str]) -> list[bytes]:
        """solve() of each island, as bytes, for many at once: one array step for each place and size of piece instead of a loop for each island.

        Long islands are solved alone, so that arrays have few places that no island reaches.
        """
        out = [b""] * len(islands)
        lens = np.fromiter(map(len, islands), np.int64, len(islands))
        for k in np.flatnonzero(lens > REMEMBERED + 1).tolist():
            out[k] = np.array(self.solve(islands[k]), np.int32).tobytes()
        order = np.argsort(-lens, kind="stable")
        order = order[(lens[order] > 0) & (lens[order] <= REMEMBERED + 1)].tolist()
        at = 0
        while at < len(order):
            part = order[at : at + max(1, PLACES // len(islands[order[at]]))]
            for k, ids in zip(part, self.trie.solve([islands[k] for k in part]), strict=True):
                out[k] = ids
            at += len(part)
        return out

    def score(self, prepared: str) -> int:
        """Best score of a whole text."""
        return sum(self.lattice(x)[0][-1] or 0 for x in self.islands(prepared))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and the leading space that encoding put there goes."""
        out = b"".join(map(self.text.__getitem__, ids))
        if self.vocabulary.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


class Trie:
    """The pieces as nodes of a trie in arrays. Node 0 is none, and the last one stands for an unknown character."""

    def __init__(self, model: Unigram):
        self.model = model
        step: dict[int, int] = {}
        piece, score = [-1, -1], [float("-inf")] * 2
        for p, (i, weight) in model.weights.items():
            node = 1
            for c in p:
                key = node << 21 | ord(c)
                node = step.setdefault(key, len(piece))
                if node == len(piece):
                    piece.append(-1)
                    score.append(float("-inf"))
            piece[node], score[node] = i, float(weight)
        self.unknown = len(piece)
        self.piece, self.score = np.array([*piece, -1], np.int32), np.array([*score, float(model.unk_score)])
        self.first = np.zeros(_PAST + 1, np.int32)
        for key, node in step.items():
            if key >> 21 == 1:
                self.first[key & (1 << 21) - 1] = node
        self.keys = np.array(sorted(step) or [-1], np.int64)
        self.to = np.array([step.get(int(k), 0) for k in self.keys], np.int32)
        self.inner = np.zeros(len(self.piece), bool)
        self.inner[[k >> 21 for k in step]] = True

    def nodes(self, chars: np.ndarray) -> np.ndarray:
        """The piece (a node, or 0) of each size less 1 that starts at each place (character, word)."""
        length, width = chars.shape
        out = np.zeros((min(self.model.longest, length), length, width), np.int32)
        flat = chars.ravel()
        node = self.first[flat]
        out[0] = np.where(self.piece[node] >= 0, node, np.where(flat < _PAST, self.unknown, 0)).reshape(length, width)
        at = np.flatnonzero(node)
        node = node[at]
        for size in range(1, len(out)):
            inside = (at < (length - size) * width) & self.inner[node]
            at, node = at[inside], node[inside]
            key = node.astype(np.int64) << 21 | flat[at + size * width]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            at, node = at[hit], self.to[found[hit]]
            if not len(at):
                break
            whole = self.piece[node] >= 0
            out[size].ravel()[at[whole]] = node[whole]
        return out

    def solve(self, words: list[str]) -> list[bytes]:
        """Ids of words that are given from the longest to the shortest. Larger sizes come first, so that a shorter piece wins only if it is better."""
        width, lens = len(words), np.fromiter(map(len, words), np.int64, len(words))
        length = int(lens[0])
        chars = np.full((width, length), _PAST, np.int64)
        chars[np.arange(length) < lens[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars = np.ascontiguousarray(chars.T)
        nodes = self.nodes(chars)
        best, took = np.zeros((length + 1, width)), np.zeros((length + 1, width), np.int64)
        reach = width - np.searchsorted(lens[::-1], np.arange(length + 1))
        for e in range(1, length + 1):
            k = reach[e]
            top, came = np.full(k, -np.inf), np.zeros(k, np.int64)
            for size in range(min(e, len(nodes)), 0, -1):
                node = nodes[size - 1, e - size, :k]
                some = np.flatnonzero(node)
                x = best[e - size, some] + self.score[node[some]]
                better = x > top[some]
                some = some[better]
                top[some], came[some] = x[better], size
            best[e, :k], took[e, :k] = top, came
        path = np.zeros((length + 1, width), np.int32)
        at, word = lens.copy(), np.arange(width)
        while len(word):
            size = took[at, word]
            path[at, word] = nodes[size - 1, at - size, word]
            at = at - size
            word, at = word[at > 0], at[at > 0]
        path = path.T
        owner, end = np.nonzero(path)
        node = path[owner, end]
        ids, owner = self._written(self.piece[node], owner, chars[end - 1, owner], node == self.unknown)
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=width)))) * 4
        blob = ids.tobytes()
        return [blob[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _written(self, ids: np.ndarray, owner: np.ndarray, char: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ids() makes of unknown characters."""
        m = self.model
        if not unknown.any():
            return ids, owner
        if not (m.vocabulary.byte_fallback and len(m.byte_ids) == 256):
            again = np.concatenate(([False], unknown[1:] & unknown[:-1] & (owner[1:] == owner[:-1])))
            return np.where(unknown, m.unk_id, ids).astype(np.int32)[~again], owner[~again]
        at = np.flatnonzero(unknown)
        each, which = np.unique(char[at], return_inverse=True)
        spelt = [[m.byte_ids[b] for b in chr(c).encode()] for c in each]
        many = np.array([len(x) for x in spelt])
        table = np.array([x + [0] * (4 - len(x)) for x in spelt], np.int32)
        times = np.ones(len(ids), np.int64)
        times[at] = many[which]
        begin = (np.cumsum(times) - times)[at]
        out = np.repeat(ids, times)
        for k in range(4):
            has = many[which] > k
            out[begin[has] + k] = table[which[has], k]
        return out, np.repeat(owner, times)


class Memory(dict):
    """What was found for words, the latest `room` and the `room` before; words that come back stay."""

    def __init__(self, find, room: int = CACHE):
        super().__init__()
        self.find, self.room = find, room
        self.before: dict = {}

    def __missing__(self, word: str):
        if len(word) > REMEMBERED:
            return self.find(word)
        if len(self) >= self.room:
            self.before = dict(self)
            self.clear()
        got = self.before.get(word)
        if got is None:
            got = self.find(word)
        self[word] = got
        return got


_models: dict[int, Unigram] = {}


def shared(vocabulary: Vocabulary) -> Unigram:
    """One model a worker process."""
    key = hash(vocabulary)
    if key not in _models:
        _models.clear()
        _models[key] = Unigram(vocabulary)
    return _models[key]
