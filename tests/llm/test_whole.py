"""Whole results where an operator once saw only a part, against plain versions of their own."""

from __future__ import annotations

import random

import pandas as pd

from foliant.llm import decontaminate as dc
from foliant.llm import line_dedup as ld
from foliant.llm import toxicity as tx
from tests.conftest import SF
from tests.llm.test_pairs import components


def all_shingles(line):
    return {line[p : p + 5] for p in range(len(line) - 4)}


def test_lines_without_spaces_and_one_more_character(spark):
    r = random.Random(4)
    base = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (80, 200, 400)]
    rows = [(2 * i + k, x[:3] + "新" * k + x[3:]) for i, x in enumerate(base) for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.removed_lines for x in ld.line_dedup(df).collect()} == {i: [0] if i % 2 else [] for i, _ in rows}


def test_similar_lines_equal_all_shingles(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    lines = [(i, k, x.strip(" ").lower()) for i, t in zip(docs.doc_id, docs.text, strict=True) for k, x in enumerate(t.split("\n"))]
    names = sorted({n for *_, n in lines if len(n) >= ld.MIN_CHARS})
    comp = components({k: all_shingles(n) for k, n in enumerate(names)})
    of, first = {n: comp[k] for k, n in enumerate(names)}, {}
    for i, k, n in sorted(lines):
        first.setdefault(of.get(n), (i, k))
    want = {(i, k) for i, k, n in lines if n in of and first[of[n]] != (i, k)}
    got = {(x.doc_id, k) for x in ld.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect() for k in x.removed_lines}
    long = {(i, k) for i, k, n in lines if n in of}
    assert got & long == want


def test_short_lines_by_equality(spark):
    rows = [(1, "Menu\n\nfirst text\n \t\n\r"), (2, " menu \n\nMenus\n\t \n\r\nHome"), (3, "home\nMENU\nfirst text")]
    got = {r.doc_id: (r.removed_lines, r.text) for r in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([], rows[0][1]), 2: ([0], "\nMenus\n\t \n\r\nHome"), 3: ([0, 1, 2], "")}


def test_verbatim_leaks_without_literal_windows_and_in_other_case(spark):
    capitals, numbers, short, long = "WHAT IS THE CAPITAL OF FRANCE AND GERMANY?", "Solve 3 + 4 * 5 - 6 = 17", "What is 12 + 7?", "Anna Schmidt has 12 apples and gives 5 km of rope to Peter before noon"
    bench = spark.createDataFrame([(1, capitals), (2, numbers), (3, short), (4, long), (5, "?!"), (6, "What Is The Capital Of Spain")], "item_id long, text string")
    texts = [f"some words {x} and more" for x in (capitals, numbers, short, long, capitals.lower(), numbers.upper(), short.lower(), long.lower(), long.upper())]
    rows = [*enumerate(texts), (20, "what is 12"), (21, "what is the capital of france"), (22, long.lower().replace("peter", "otto")), (23, "?!"), (24, short), (25, None)]
    got = {r.doc_id: r.leaked_items for r in dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == dict(enumerate([[1], [2], [3], [4], [1], [2], [3], [4], [4]])) | {20: [], 21: [], 22: [], 23: [], 24: [3], 25: []}


def test_toxicity_thresholds_count_all_labels(spark):
    """Many more clean than toxic labels beyond the fit's sample, some as like toxic ones as can be: the cut counts them all."""
    r = random.Random(6)
    word = lambda: f"w{r.randrange(300)}"
    rows = [(i, " ".join([word() for _ in range(12)] + ["vile"] * (i % 10 < 2)), "en", int(i % 10 == 0)) for i in range(3000)]
    docs = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows], "doc_id long, toxic int")
    out = tx.toxicity(docs, labels, fit_rows=60, epochs=4).toPandas().merge(pd.DataFrame([(x[0], x[3]) for x in rows], columns=["doc_id", "y"]), on="doc_id")
    fitted = tx.sample(docs, labels, 60, tx.FIT_CHARS)
    assert sorted(fitted.y.value_counts()) == [60, 60]
    trained = set(fitted[~tx._kept_out(fitted.y.to_numpy())].doc_id)
    rest = out[~out.held_out & ~out.doc_id.isin(trained)]
    wrong = lambda t: int(((rest.score >= t) != (rest.y == 1)).sum())
    assert len(rest) > 1500 and wrong(out.threshold[0]) <= min(wrong(k / 1000) for k in range(300, 901))
