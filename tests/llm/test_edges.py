"""Odd input through every operator: nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.llm import chat_format, decontaminate, license_scan, line_dedup, minhash_dedup, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, toxicity

r = random.Random(8)
LONG = "\n".join(" ".join(f"w{r.randrange(5000)}" for _ in range(40)) for _ in range(900))
COPY = " ".join(f"c{r.randrange(5000)}" for _ in range(60))
TEXTS = [(1, "A line of text that is long enough\nand one more line"), (1, "A line of text that is long enough\nand one more line"), (1, "another text of the same id"), (2, None), (3, ""), (4, " \n\t\n"), (None, "a row without an id " + COPY), (5, COPY), (6, COPY.upper()), (7, LONG), (8, LONG + " end"), (9, "x"), (10, "x" * 70_000)]
#: Names that results and helper columns of some operator have or had.
CLASH = ["_id", "_rid", "_removed", "N_Lines", "_k1", "_k2", "_items", "contaminated", "_digest", "IDS", "_score", "Score", "held_out", "n_tokens", "id", "bucket", "n", "key"]


def documents(spark):
    rows = [(i, t, None if k % 3 else "en", None, *([str(k)] * len(CLASH))) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, None, 1), (None, 0, 1), (7, 0, None), (7, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(1, " ".join(COPY.split()[:20])), (1, " ".join(COPY.split()[:20])), (2, None), (None, "x"), (3, "")], "item_id long, text string")


#: Operator, and the names that its results have (those columns of the input go); None where it gives other rows.
OPS = {
    1: (lambda s, d: minhash_dedup.near_duplicates(d), None),
    2: (lambda s, d: license_scan.license_scan(d), None),
    3: (lambda s, d: sentencepiece_codec.decode(sentencepiece_codec.encode(d, chunk_chars=4000)), {"ids", "decoded"}),
    4: (lambda s, d: toxicity.toxicity(d, labels(s)), {"held_out", "score", "predicted", "threshold", "rejected"}),
    5: (lambda s, d: token_counts.token_counts(d), {"n_tokens"}),
    6: (lambda s, d: decontaminate.decontaminate(d, bench(s)), {"contaminated", "leaked_items"}),
    7: (lambda s, d: quality_rules.quality_rules(d, labels(s)), None),
    8: (lambda s, d: suffix_dedup.repeated_spans(d), None),
    10: (lambda s, d: line_dedup.line_dedup(d), {"n_lines", "removed_lines"}),
}


@pytest.mark.parametrize("n", OPS)
def test_documents(spark, n):
    make, results = OPS[n]
    docs = documents(spark)
    out = make(spark, docs)
    rows = out.collect()
    assert make(spark, docs.limit(0)).count() == 0
    if results is None:
        assert Counter(map(str, rows)) == Counter(map(str, make(spark, docs).collect()))
        if n in (2, 7):
            assert Counter(x.doc_id for x in rows) == Counter(i for i, _ in TEXTS)
        if n == 1:
            got = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in rows}
            assert len(rows) == len(TEXTS) - 1 and got[2, 0] == (2, True) and got[6, 56] == (5, False) and got[8, max(k for i, k in got if i == 8)] == (7, False)
        if n == 8:
            assert Counter(x.doc_id for x in rows) == Counter({5: 1, 6: 1, 7: 1, 8: 1})
        return
    own = [c for c in docs.columns if c.lower() not in results]
    assert [c for c in out.columns if c.lower() not in results] == own and results <= {c.lower() for c in out.columns}
    keep = [c for c in own if c != "text"]
    at = [out.columns.index(c) for c in keep]
    assert Counter(tuple(x[k] for k in at) for x in rows) == Counter(tuple(x[c] for c in keep) for x in docs.collect())
    if n == 3:
        assert all(x.decoded == (x.text or "") for x in rows)
    if n == 6:
        assert {x.doc_id for x in rows if x.contaminated} == {5, 6, None}
    if n == 10:
        # rows that repeat an id and text lose the same lines
        twice = [x.removed_lines for x in rows if x.doc_id == 1 and (x.n_lines == 2)]
        assert len(twice) == 2 and twice[0] == twice[1]
        assert Counter(x.text for x in rows if x.doc_id in (2, 3, 4)) == Counter([None, "", " \n\t\n"])


def test_chat(spark):
    rows = [(1, 0, None, "first line of all\n" + LONG), (1, 1, "user", "> first line of all\nyes"), (1, 1, "user", "> first line of all\nyes"), (1, 2, None, None), (None, 3, "user", "> first line of all"), (2, None, "user", ""), (1, 3, "user", ">> first line of all\n> yes indeed not\nno")]
    df = spark.createDataFrame([(*x, "1", "2", "3", "4", "5") for x in rows], "conv_id long, turn long, role string, text string, _c string, _s string, _t string, _body string, n_x string")
    out = chat_format.reply_order(chat_format.quotation_links(df))
    assert out.columns == [*df.columns, "n_quotes", "reply_to", "root_turn", "depth"]
    got = out.collect()
    assert len(got) == len(rows) and all((x._c, x._s, x._t, x._body, x.n_x) == ("1", "2", "3", "4", "5") for x in got)
    assert sorted((x.turn, x.reply_to, x.depth) for x in got if x.conv_id == 1) == [(0, None, 0), (1, 0, 1), (1, 0, 1), (2, None, 0), (3, 0, 1)]


def plain_links(rows):
    """Reply of each turn by passages as text: the lowest level with an origin, of most passages, the latest."""
    bodies = {(c, t): chat_format.parse(x) for c, t, x in rows}
    first = {}
    for (c, t), (body, _) in sorted(bodies.items()):
        for p in chat_format.passages(body):
            first.setdefault((c, p), t)
    up = {}
    for (c, t), (_, quotes) in bodies.items():
        votes = Counter((k, first[c, q]) for k, q in quotes if first.get((c, q), t) < t)
        if votes:
            up[c, t] = max(((-k, n, o) for (k, o), n in votes.items()))[2]
    out = {}
    for c, t in bodies:
        root, depth = t, 0
        while (c, root) in up:
            root, depth = up[c, root], depth + 1
        out[c, t] = (up.get((c, t)), root, depth)
    return out


def test_generated_threads(spark):
    rng = random.Random(3)
    rows = []
    for c in range(30):
        said = []
        for t in range(rng.randrange(1, 14)):
            lines = [rng.choice(["we agree on this point", f"line number {rng.randrange(40)} of talk", "short"]) for _ in range(rng.randrange(1, 4))]
            quotes = []
            for level in range(rng.randrange(0, 3), 0, -1):
                if said:
                    quotes += ["> " * level + x for x in rng.choice(said)[: rng.randrange(1, 3)]]
            said.append(lines)
            rows.append((c, t, "\n".join([*quotes, *lines])))
    got = chat_format.quotation_links(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    want = plain_links(rows)
    assert {(x.conv_id, x.turn): (x.reply_to, x.root_turn, x.depth) for x in got} == want
    assert max(d for *_, d in want.values()) > 2 and all(x.text == chat_format.parse(t)[0] for x, (_, _, t) in zip(sorted(got, key=lambda x: (x.conv_id, x.turn)), sorted(rows), strict=True))


def test_no_pair_of_a_session_conf_is_left_changed(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    sentencepiece_codec.decode(sentencepiece_codec.encode(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))).where(F.col("decoded") == "a b").collect()
    assert spark.conf.get(key, None) == before
