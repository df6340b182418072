"""Byte helpers, quality rules, licences, toxicity and tokens against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from foliant.llm import license_scan as ls
from foliant.llm import quality_rules as qr
from foliant.llm import sentencepiece_codec as sc
from foliant.llm import textbytes as tb
from foliant.llm import token_counts as tc
from foliant.llm import toxicity as tx
from foliant.llm import unigram as ug
from tests.conftest import SF

WORD = r"[^\x20\x09-\x0D]+"
texts = st.lists(st.text(alphabet="ab C\n\t é#0▁", max_size=40), min_size=1, max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_lines_and_base_counts(rows):
    for i, j, buf, offs in tb.chunks(pa.array(rows), 60):
        got = qr.line_features(buf, offs)
        starts, ends, doc = tb.lines(buf, offs)
        for k, t in enumerate(rows[i:j]):
            mine = [bytes(buf[s:e]).decode() for s, e, d in zip(starts, ends, doc, strict=True) if d == k]
            assert mine == (t.split("\n") if t else [])
            words = re.findall(WORD, t)
            wins = Counter(tuple(words[p : p + 5]) for p in range(len(words) - 4))
            again = {q for p in range(len(words) - 4) if wins[tuple(words[p : p + 5])] > 1 for q in range(p, p + 5)}
            full = [x for x in t.split("\n") if re.search(WORD, x)]
            assert got["n_words"][k] == len(words) and got["word_chars"][k] == sum(map(len, words))
            assert got["n_symbols"][k] == len(re.findall(r"[#*$%&|<>]", t))
            assert got["n_dup_lines"][k] == len(full) - len(set(full)) and got["n_repeat_words"][k] == len(again)


def test_line_field_learns_and_decodes_like_brute_force():
    r = np.random.default_rng(0)
    seqs = []
    for _ in range(200):
        y, n = int(r.integers(2)), int(r.integers(1, 6))
        x = np.ones((n, 3))
        x[:, 0] = r.random(n) < (0.8 if y else 0.2)
        x[:, 1] = r.random(n) < 0.5
        seqs.append((x, y))
    field = qr.LineField(3).fit(seqs)
    right = sum(int((field.decode(x, np.zeros(len(x))) == y).mean() > 0.5) for x, y in seqs)
    assert right > 140
    for x, _ in seqs[:30]:
        score = x @ field.emit
        best = max(range(2 ** len(x)), key=lambda c: _path(field, score, [c >> i & 1 for i in range(len(x))]))
        got = field.decode(x, np.zeros(len(x))).tolist()
        assert _path(field, score, got) == pytest.approx(_path(field, score, [best >> i & 1 for i in range(len(x))]))


def _path(field, score, labels):
    return field.start[labels[0]] + sum(score[i, k] for i, k in enumerate(labels)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:], strict=False))


def test_quality_keeps_labelled_content(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = qr.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.kept[got.quality == 1]).mean() > 0.97 and (got.kept[got.quality == 0]).mean() < 0.35


def test_license_base_and_statistics():
    scanner = ls.Scanner()
    r = random.Random(4)
    vocab = "under the mit license apache version 2 cc by nc is x released".split()
    rows = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(60)] + ["", "Under The MIT-License!", "apache license, version 2.0"]
    for i, j, buf, offs in tb.chunks(pa.array(rows), 500):
        n, found = scanner.scan(buf, offs)
        for k in range(j - i):
            assert sorted(found[k]["base"] if k in found else []) == ls.base_by_regex(rows[i + k])
            assert n[k] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[i + k].lower()))
    tokens = [scanner.number[w] for w in "the mit license the apache license version 2 0 the license you may".split()]
    for e, (_, n) in enumerate(scanner.automaton.stream(tokens)):
        inside = lambda part: any(seq[p : p + len(part)] == part for seq in scanner.seqs for p in range(len(seq)))
        assert n == max(x for x in range(e + 2) if not x or inside(tokens[e + 1 - x : e + 1]))


def test_license_templates_add_labels(spark):
    body = ls.TEMPLATES["gpl-3"][0]
    cut = body.replace("redistribute", "share")
    df = spark.createDataFrame([(1, f"Intro. {body}. End"), (2, cut), (3, "nothing here"), (4, None), (None, "under the MIT license")], "doc_id long, text string")
    got = {r.doc_id: r for r in ls.license_scan(df).collect()}
    assert (got[1].labels, got[1].score) == ("gpl-3", 1.0) and got[1].spans[0].first_word == 1
    assert got[2].labels == "gpl-3" and 0.8 <= got[2].score < 1
    assert (got[3].labels, got[3].n_words) == ("", 2) and got[4].n_words == 0 and got[None].base_labels == "mit"


@pytest.fixture(scope="module")
def labelled():
    d, y = (pd.read_parquet(f"{SF}/../sf0.1/{n}.parquet") for n in ("documents", "labels"))
    m = d.merge(y, on="doc_id")
    return m.assign(held=[zlib.crc32(str(i).encode()) % 3 == 1 for i in m.doc_id], y=m.toxic)


def test_toxicity_on_held_out_labels(labelled):
    train = labelled[~labelled.held & (labelled.text.str.len() < 8000)]
    net, cuts = tx.fit(train[["text", "lang", "y"]], epochs=6)
    test = labelled[labelled.held]
    hit, y = tx._scores(net, test.text.tolist()) >= tx.CUT, test.y.to_numpy()
    assert (hit == (y == 1)).mean() > 0.97 and hit[y == 1].mean() > 0.75 and hit[y == 0].mean() < 0.01
    assert set(cuts) == {None, "en", "fr", "de", "es"}


def test_toxicity_small_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", None, 0.5), (2, "x y", "en", 0.5), (None, "z", "en", 0.5)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = tx.toxicity(docs, none).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    assert tx.toxicity(docs.limit(0), none).count() == 0
    assert [r.held_out for r in tx.toxicity(docs, none).where("doc_id is null").collect()] == [False]


@pytest.fixture(scope="module")
def model():
    return ug.Unigram(ug.Vocabulary.load(tc.MODEL))


def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(tc.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    floor = min(p.score for p in proto.pieces if p.type == 1 and p.score > ug.BLOCKED) - 1
    for p in proto.pieces:
        if p.type == 1 and p.score <= ug.BLOCKED:
            p.score = floor
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_equal_the_library(model):
    lib = library()
    counter = tc.Counter(model)
    rows = [x[:300] for t in pd.read_parquet(f"{SF}/documents.parquet").text for x in t.split("\n")]
    r = random.Random(3)
    rows += ["".join(r.choice("ab  ▁é梦 th e in") for _ in range(r.randint(0, 14))) for _ in range(1000)]
    for t in rows:
        want = lib.encode(t)
        got = [i for x in model.islands(model.prepare(t)) for i in model.solve(x)]
        assert got == want and counter.text(t) == len(want) == tc.count_by_path(model, t)
        assert model.decode(got) == t.replace("▁", " ")


#: ties, pieces over spaces, and no byte fallback
TIES = ug.Vocabulary((("<unk>", 0.0, 2), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -6.0, 1), ("ba", -5.0, 1), ("aba", -9.0, 1), ("▁", -4.0, 1), ("a▁b", -10.0, 1), ("bb▁", -9.0, 1), ("aaaa", -11.0, 1)), True, False)


def by_chunks(m, text, size):
    parts = [sc.ChunkLattice(m, c, h, p) for _, c, h, p in sc.cut_text(m, text, size)]
    entries = sc.scan_entries(sc._start(m.longest), [x.matrix() for x in parts])
    maps = [{o: (s, ids) for o, s, ids in x.traces(v, sc.Encoder(m))} for x, v in zip(parts, entries, strict=True)]
    state, out = 0, []
    for step in reversed(maps):
        state, ids = step[state]
        out.append(ids)
    return sc.unpack(b"".join(reversed(out)))


@pytest.mark.parametrize("which, letters", [("ties", "aabb "), ("file", "the in  a\n▁é梦ion")])
def test_parallel_scan_equals_the_whole_path(model, which, letters):
    m = model if which == "file" else ug.Unigram(TIES)
    r = random.Random(5)
    for _ in range(400):
        t = "".join(r.choice(letters) for _ in range(r.randint(1, 40)))
        want = m.solve(m.prepare(t))
        assert all(by_chunks(m, t, size) == want for size in (1, 2, 5, 9, 50))


@pytest.mark.parametrize("fallback", [True, False])
def test_words_of_a_batch_are_solved_together(model, monkeypatch, fallback):
    m = model if fallback else ug.Unigram(ug.Vocabulary(tuple(p for p in TIES.pieces if ug.SPACE not in p[0][1:] and p[0] != "bb▁"), True, False))
    r = random.Random(7)
    rows = ["", "▁", " ", "  a", "a  ", "a" * 65, "b" * 200 + " c", *("".join(r.choice("aabb ce▁é梦😀\n th") for _ in range(r.randint(0, 60))) for _ in range(800))]
    want = [[i for x in m.islands(m.prepare(t)) for i in m.solve(x)] for t in rows]
    alone = []
    solve = m.solve
    monkeypatch.setattr(m, "solve", lambda x: alone.append(x) or solve(x))
    encoder = sc.Encoder(m, room=50)
    got = [ids for i in range(0, len(rows), 100) for ids in encoder.texts(rows[i : i + 100])]
    assert [sc.unpack(x) for x in got] == want
    assert all(len(x) > ug.REMEMBERED for x in alone) and len(encoder.words) < 4000
    encoder.texts(["a b"])
    assert len(encoder.words) <= 50


def test_texts_of_a_batch_are_bounded_in_rows_and_bytes(monkeypatch, spark):
    monkeypatch.setattr(sc, "PART_BYTES", 10)
    monkeypatch.setattr(sc, "PART_ROWS", 3)
    assert list(sc.parts_of(pa.array(["x" * 6, "x" * 4, "é" * 9, None, "", "", "", "x"]))) == [(0, 2), (2, 3), (3, 6), (6, 8)]
    assert list(sc.parts_of(pa.array([], pa.string()))) == []
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    old = [spark.conf.get(k) for k in keys]
    try:
        sc.small_batches(spark)
        assert spark.conf.get(keys[1]) == str(sc.BATCH_BYTES)
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_max_plus_products_are_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random((4, 4)) < 0.3, sc._NONE, r.integers(-50, 0, (4, 4))) for _ in range(3))
    assert (sc.times(sc.times(a, b), c) == sc.times(a, sc.times(b, c))).all()


def test_codec_round_trip(spark, model):
    long = "one two  three\nmanière 梦 " * 40
    rows = [(1, long, "a"), (1, long, "b"), (2, "", "c"), (3, None, "d"), (None, "x y", "e"), (4, long + "!", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sc.decode(sc.encode(df, chunk_chars=100)).collect()
    assert len(got) == 6
    for r in got:
        assert r.decoded == (r.text or "")
        assert sc.unpack(r.ids) == [i for x in model.islands(model.prepare(r.text or "")) for i in model.solve(x)]
    assert sc.encode(df.limit(0)).count() == 0
    once = sc.encode(df, chunk_chars=100, decoded="decoded").collect()
    assert sorted(map(str, once)) == sorted(map(str, got))
    assert sorted(r.n_tokens for r in tc.token_counts(df).collect()) == sorted(len(sc.unpack(r.ids)) for r in got)
