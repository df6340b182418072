"""Substring dedup and the prefix trie against brute force, with odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from foliant.llm import prefix_trie as pt
from foliant.llm import queries
from foliant.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_dedup(texts, width):
    words = [WORD.findall(t or "") for t in texts]

    def places(k):
        seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
        return [[i for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1] for w in words]

    at, longest, k = places(width), [0] * len(words), width
    level = at
    while any(level):
        longest = [k if x else old for x, old in zip(level, longest, strict=True)]
        k *= 2
        level = places(k)
    out = []
    for w, starts, far in zip(words, at, longest, strict=True):
        gone = {j for i in starts for j in range(i, i + width)}
        out.append((" ".join(x for j, x in enumerate(w) if j not in gone), len(w), len(gone), far))
    return out


def check_dedup(spark, rows, width):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, k1 string, Longest string, `a.b` int")
    got = substring_dedup(docs, width)
    assert got.columns == ["doc_id", "k1", "a.b", "text", "n_words", "n_removed", "longest"]
    want = Counter(zip((i for i, _ in rows), plain_dedup([t for _, t in rows], width), strict=True))
    assert Counter((x[0], (x.text, x.n_words, x.n_removed, x.longest)) for x in got.collect()) == want


def test_substring_dedup_small_alphabet(spark):
    r = random.Random(3)
    word = lambda: r.choice("abc")
    texts = [" ".join(word() for _ in range(r.randrange(40))) for _ in range(150)]
    for width in (5, 6):
        check_dedup(spark, list(enumerate(texts)), width)


def test_substring_dedup_odd_texts(spark):
    r = random.Random(4)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    shared, copy, long = words(80), " ".join(words(90)), words(6000)
    put = lambda a, b, part: " ".join(words(a) + part + words(b))
    rows = [(1, put(3, 9, shared)), (2, put(30, 0, shared)), (3, put(0, 2, shared[:34])), (4, put(5, 5, shared[10:45])), (5, copy), (6, copy), (6, copy), (7, copy + " end"), (8, " ".join(long)), (9, " ".join([*long[:3000], "x", *long[3000:]])),
            (10, " ".join(["ha"] * 200)), (11, "ha " * 35), (12, None), (13, ""), (14, " \n\t "), (None, put(2, 2, shared)), (15, copy.upper()), (16, " ".join(shared)), (17, "short copy"), (18, "short copy"), (19, put(4, 4, long[100:150]).replace(" ", "\n\n"))]
    check_dedup(spark, rows, 35)
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def rebuilt(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    members, nodes = defaultdict(list), {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(p))
        nodes[m[0], len(p)] = (members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return nodes


def as_nodes(rows):
    return {(x.conv_id, x.depth): (x.parent_conv_id, x.n_convs, x.n_children, x.n_leaves, x.saved_tokens, x.ends_sha256) for x in rows}


def conversations(spark, rows):
    return spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn long, role string, text string, p1 string, rank int")


def test_trie_of_rebuilt_conversations(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "b", "é"])) for c in range(-4, 300) for t in range(r.randrange(7)) if r.random() < 0.95]
    rows += [(7, t, "user", f"long {t}") for t in range(20, 3000)] + [(8, None, None, None), (8, None, "user", None), (9, 1, "user", "same"), (9, 1, "user", "same"), (None, 1, "user", "lost"), (10**12, 1, "user", "far")]
    turns, convs = queries.forked(pt.number_turns(conversations(spark, rows)))
    got = pt.prefix_trie(turns, convs).collect()
    short = rebuilt(rows)
    assert Counter(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()) == Counter({(c, len(v), len(v)): 1 for c, v in short.items() if v})
    # the long conversation is left out of the plain nodes, which are quadratic, but for its count
    assert len(got) == len({tuple(v[:d]) for v in short.values() for d in range(len(v) + 1)})
    head = {c: v[:12] for c, v in short.items()}
    want = plain_trie(head)
    mine = as_nodes(got)
    for key, (parent, n, kids, leaves, saved, ends) in want.items():
        if key[1] < 12:
            assert mine[key][:4] == (parent, n, kids, leaves), key
    at = {(x.position, x.end_position) for x in got}
    assert sorted(a for a, _ in at) == list(range(1, len(got) + 1)) and max(b for _, b in at) == len(got)


def test_trie_digests_and_savings(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 9000, 3) for t in range(2)] + [(20_000 + c, t, "user", f"{c % 7} {t}") for c in range(300) for t in range(c % 4)]
    got = as_nodes(pt.conversation_trie(conversations(spark, rows)).collect())
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    assert got == plain_trie(convs)


def test_trie_without_turns_or_rows(spark):
    empty = conversations(spark, [(1, 1, "a", "b")]).limit(0)
    assert pt.conversation_trie(empty).count() == 0
    turns = pt.number_turns(empty).withColumnRenamed("place", "depth")
    only = pt.prefix_trie(turns, spark.createDataFrame([(5,), (3,), (3,)], "conv_id long"))
    assert as_nodes(only.collect()) == {(3, 0): (None, 2, 0, 1, 0, hashlib.sha256(b"3,5").hexdigest())}


def test_sample_passes_over_texts_that_do_not_fit():
    import pandas as pd

    from foliant.llm.toxicity import fitting

    for at in range(12):
        sizes = pd.DataFrame({"y": [k % 2 for k in range(12)], "n": [1000 if k == at else 10 for k in range(12)]})
        assert fitting(sizes, 10, 100) == [k for k in range(12) if k != at]
        assert fitting(sizes, 2, 100) == sorted(k for y in (0, 1) for k in [x for x in range(12) if x % 2 == y and x != at][:2])
    sizes = pd.DataFrame({"y": [0, 1, 1, 0], "n": [5, 900, 800, 6]})
    assert fitting(sizes, 10, 100) == [0, 2, 3] and fitting(sizes.iloc[:0], 10, 100) == []


def test_a_long_labelled_text_does_not_end_the_fit(spark):
    from foliant.llm.toxicity import sample

    rows = [(k, ("bad " if k % 2 else "good ") * 5, "en") for k in range(40)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    for long in (0, 3, 8, 39):
        docs = spark.createDataFrame([(k, t * 100 if k == long else t, g) for k, t, g in rows], "doc_id long, text string, lang string")
        got = sample(docs, marks, 100, 2000)
        assert set(got["doc_id"]) == {k for k in range(40) if k != long and zlib.crc32(str(k).encode()) % 3 != 1}


def test_windows_are_hashed_as_their_slices_were(spark):
    from pyspark.sql import functions as F

    from foliant.llm import decontaminate as dc

    words = spark.createDataFrame([([f"w{i}" for i in range(9)],)], "t array<string>")
    made = words.select(dc.windows(F.col("t")).alias("h"), F.array(*[F.xxhash64(F.slice("t", i + 1, dc.WINDOW)) for i in range(5)]).alias("w"))
    assert "slice" not in words.select(dc.windows(F.col("t")).alias("h"))._jdf.queryExecution().analyzed().toString()
    got = made.first()
    assert got.h == got.w


def test_workers_of_the_pipeline_models_do_without_pandas(spark):
    """A worker that unpickles the scoring or encoding function imports its module, and keeps all that this one imports."""
    import subprocess
    import sys

    code = "import sys, foliant.llm.toxicity, foliant.llm.sentencepiece_codec; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
    import pandas as pd

    from foliant.llm.toxicity import _keys

    rows = pd.DataFrame({"doc_id": [3, -(1 << 62)], "key": [1 << 62, 0], "y": [0, 1]})
    table = _keys(spark, rows)
    assert "ExistingRDD" not in table._jdf.queryExecution().toString()
    assert table.collect() == [(3, 1 << 62), (-(1 << 62), 0)] and _keys(spark, rows.iloc[:0]).count() == 0


def test_toxicity_scores_a_batch_in_small_parts():
    """Peak of the arrays while a batch of 6 MB is scored: 6 MB, and 23 MB in parts of 1 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from foliant.llm import toxicity as tx

    net, text = tx.Net.new(), " ".join(f"word{k % 997}" for k in range(2_500))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([text, None, ""] * 100)], ["doc_id", "text"])
    batch = pa.concat_batches([batch] * 3)
    net.score(np.zeros(0, np.uint8), np.zeros(2, np.int64))
    tracemalloc.start()
    got = [(part.num_rows, len(p), p.copy()) for part, p in tx.judged(net, batch)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    assert sum(n for n, _, _ in got) == 900 and all(n == m for n, m, _ in got)
    whole = tx._scores(net, batch.column("text").to_pylist())
    assert np.allclose(np.concatenate([p for _, _, p in got]), whole, atol=1e-6)


def test_buckets_in_portions_give_the_same_links(spark, monkeypatch):
    """Each portion's shuffle is let go before the next one, and the rows of all are one table."""
    from pyspark.sql import functions as F

    from foliant.llm import components

    rows = [(b * 7919 - (1 << 40), i, 0) for b in range(60) for i in ({b, b + 1, b * b % 50} if b % 3 else {b})]
    confirm = lambda pairs: pairs.select("a", "b", (F.abs(F.col("a") - F.col("b")) < 9).alias("linked"), F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(9).alias("na"), F.lit(9).alias("nb"))
    let_go, release = [], components.release
    monkeypatch.setattr(components, "release", lambda s: (let_go.append(s), release(s)))

    def run(portions):
        let_go.clear()
        members = spark.createDataFrame(rows, "bucket long, id long, n int")
        got = components.bucket_links(members, confirm, lambda ids: ids.select("id", F.array(F.col("id")).alias("set")), 80, portions=portions)
        return sorted(map(tuple, got.select("id", "component").collect())), len(let_go)

    (one, few), (four, many) = run(1), run(4)
    assert one == four and len(one) > 20 and many == few + 3
    table = spark.range(3)
    assert sorted(r.id for r in components.cut(table, table.where("id > 5"), table.where("id > 1")).collect()) == [0, 1, 2, 2]
