"""Near-duplicates, repeated passages, lines, leaks and chats against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import regex
from pyspark.sql import functions as F

from foliant.llm import chat_format as cf
from foliant.llm import components as cp
from foliant.llm import decontaminate as dc
from foliant.llm import line_dedup as ld
from foliant.llm import minhash_dedup as mh
from foliant.llm import suffix_dedup as sd
from tests.conftest import SF

WORD = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


class Sets:
    """Union-find."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def components(sets, percent=80):
    u, inv = Sets(), defaultdict(list)
    for i in sorted(sets):
        u.find(i)
        for j, c in Counter(j for s in sets[i] for j in inv[s]).items():
            if 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
                u.join(i, j)
        for s in sets[i]:
            inv[s].append(i)
    return {i: u.find(i) for i in sets}


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(140)] + [(500, 500 + k) for k in range(1, 50)]
    u = Sets()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    got = {x.id: x.component for x in cp.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: u.find(i) for i in u.up}
    assert cp.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def family(n, size, seed, most=0.25):
    """Sets of a family: one set with more and more other elements, some shared by many copies, so that many pairs are about the bound."""
    r = random.Random(seed)
    base, common = list(range(size)), list(range(10_000, 10_006))
    out = {}
    for i in range(n):
        gone = set(r.sample(base, r.randrange(0, int(size * most))))
        out[i] = (set(base) - gone) | {r.choice(common) if r.random() < 0.2 else r.randrange(10**6, 10**7) for _ in gone}
    return out


def test_coded_links_lose_none_and_stay_few(spark):
    for n, size, seed in ((3000, 100, 1), (300, 40, 2)):
        sets = family(n, size, seed)
        own = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, set array<long>")
        want = components(sets)
        # those linked with the first set are one component, as after a star; a centre, or none
        star = {i for i in sets if 100 * len(sets[0] & sets[i]) >= 80 * len(sets[0] | sets[i])}
        known = spark.createDataFrame([(0, i) for i in star], "a long, b long").transform(cp.connected_components).cache()
        for centre in (0, None) if n < 1000 else (0,):
            members = spark.createDataFrame([(5, i, 0 if i in star else i, centre) for i in sets], "bucket long, id long, component long, centre long")
            links = cp.coded_links(members, lambda ids, own=own: own.join(ids, "id", "left_semi"), 80)
            got = {x.id: x.component for x in cp.grown(known, links).collect()}
            assert {i: got.get(i, i) for i in sets} == want
        assert len(set(want.values())) > n // 20, len(set(want.values()))


def test_coded_links_of_unrelated_sets_make_few_pairs(spark, monkeypatch):
    r, made = random.Random(5), {}

    def cut(df, old=cp.cut):
        made[tuple(df.columns)] = out = old(df)
        made[tuple(df.columns), "rows"] = out.count()
        return out

    monkeypatch.setattr(cp, "cut", cut)
    # sets of one bucket and no centre, from so few elements that each shares rare ones with many; two are linked
    sets = {i: set(r.sample(range(400), 150)) for i in range(200)}
    sets[200] = {*sorted(sets[0])[5:], 1000, 1001}
    own = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, set array<long>")
    search = lambda component, ids=sets: cp.coded_links(
        spark.createDataFrame([(5, i, component(i), None) for i in ids], "bucket long, id long, component long, centre long"), lambda x: own.join(x, "id", "left_semi"), 80
    )
    assert {tuple(sorted(x)) for x in search(lambda i: i).collect()} == {(0, 200)}
    assert made[("va", "vb"), "rows"] == 1
    # edits of one component alone are not looked up at all
    assert search(lambda i: 0).count() == 0 and made[("t", "f"), "rows"] == 0


def near_copies():
    """A family of copies of one text with more and more other words, a chain, hot equal texts and odd rows."""
    r = random.Random(9)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    rows, text = [], list(base)
    for i in range(40):
        text[r.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(text), "x", 0))
    rows += [(100 + i, "Same text Again", "x", 0) for i in range(30)]
    rows += [(200, None, "x", 0), (201, "", "x", 0), (202, " \n ", "x", 0), (203, "one", "x", 0), (204, "ONE", "x", 0), (None, "one", "x", 0), (205, "a b c d", "x", 0), (206, "a b c d e", "x", 0), (207, "tiny\x0bword", "x", 0)]
    return rows


def test_minhash_equals_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(df, shingle=2).collect()}
    sets = {i: shingle_set(t, 2) for i, t, *_ in rows if i is not None}
    want = components({i: s for i, s in sets.items() if s})
    assert got == {i: (len(s), want.get(i, i)) for i, s in sets.items()}
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.component_id for r in mh.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == components({i: shingle_set(t, 5) for i, t in zip(docs.doc_id, docs.text, strict=True)})


def test_minhash_ids_that_repeat(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "x y z"), (2, "a b c"), (3, "x y z"), (3, "x y z")], "doc_id long, text string")
    got = mh.near_duplicates(df, shingle=2).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {1} and sum(r.kept for r in got) == 2
    assert mh.near_duplicates(df.limit(0)).count() == 0


def passages(rows):
    w = {i: words(t) for i, t in rows}
    n = Counter(tuple(x[p : p + sd.PASSAGE]) for x in w.values() for p in range(len(x) - sd.PASSAGE + 1))
    out = defaultdict(list)
    for i, x in w.items():
        for p in range(len(x) - sd.PASSAGE + 1):
            if n[tuple(x[p : p + sd.PASSAGE])] > 1:
                if out[i] and p <= out[i][-1][1]:
                    out[i][-1][1] = p + sd.PASSAGE
                else:
                    out[i].append([p, p + sd.PASSAGE])
    return {i: v for i, v in out.items() if v}


def spans(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append([r.first_word, r.end_word])
    return {i: sorted(v) for i, v in out.items()}


def test_suffixes_equal_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert spans(sd.repeated_spans(spark.read.parquet(f"{SF}/documents.parquet"))) == passages(zip(docs.doc_id, docs.text, strict=True))
    r = random.Random(1)
    new = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    p49, p50, p90 = new(49), new(50), new(90)
    rows = [(1, f"{new(30)} {p50} {new(5)}"), (2, f"{p50.upper()}\n{new(20)} {p90}"), (3, f"{new(7)} {p90} {new(3)} {p49}"), (4, p49), (5, None), (6, ""), (7, p90), (8, p90), (9, "la " * 120)]
    df = spark.createDataFrame(rows + [(None, p50)], "doc_id long, text string")
    assert spans(sd.repeated_spans(df)) == passages(rows)
    assert sd.repeated_spans(df.limit(0)).count() == 0


def line_shingles(n):
    return {n[p : p + 5] for p in range(len(n) - 4)}


def removed(rows):
    """Lines to remove: similar by all shingles, or equal if they are short."""
    lines = [(i, k, x.strip(" ").lower()) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    names = sorted({n for *_, n in lines if len(n) >= ld.MIN_CHARS})
    comp = components({k: line_shingles(n) for k, n in enumerate(names)})
    of = {n: comp[k] for k, n in enumerate(names)}
    first = {}
    for i, k, n in sorted(lines):
        first.setdefault(of.get(n, n), (i, k))
    out = defaultdict(list)
    for i, k, n in lines:
        if first[of.get(n, n)] != (i, k):
            out[i].append(k)
    return dict(out)


def test_lines_equal_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in ld.line_dedup(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    want = removed(zip(docs.doc_id, docs.text, strict=True))
    assert {i: v for i, v in got.items() if v} == want


def test_lines_small_cases(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"
    rows = [(1, f"{long}\nshort\n{long.upper()}", "a"), (2, f"short\n{long}s\nanother line that is long enough", "b"), (3, None, "c"), (4, "", "d"), (5, long, "e"), (5, long, "e"), (None, long, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = defaultdict(list)
    for r in ld.line_dedup(df).collect():
        got[r.doc_id].append(r.text)
    assert got == {1: [f"{long}\nshort"], 2: ["another line that is long enough"], 3: [None], 4: [""], 5: ["", ""], None: [long]}
    assert ld.line_dedup(df.limit(0)).count() == 0
    plan = ld.line_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


ITEM = "Anna Schmidt has 12 apples and gives 5 km of rope to Peter before Anna Schmidt counts the 12 apples again"


def test_leaks_by_template(spark):
    other = ITEM.replace("Anna Schmidt", "Maria Lopez").replace("12", "340").replace("Peter", "Otto").replace("km", "miles")
    torn = ITEM.replace("Anna Schmidt", "Maria Lopez", 1)
    docs = [(1, f"intro words here {ITEM} and the end", 1), (2, f"Before. {other}. After", 1), (3, torn, 1), (4, "nothing of the kind is said in this text at all", 1), (5, None, 1), (6, "", 1), (None, ITEM.upper().lower(), 1), (7, ITEM[:40], 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, contaminated int")
    bench = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (None, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.leaked_items for r in dc.decontaminate(df, bench).collect()}
    assert got == {1: [10], 2: [10], 3: [], 4: [], 5: [], 6: [], None: [10], 7: []}
    assert dc.decontaminate(df, bench.limit(0)).where("contaminated").count() == 0
    assert dc.decontaminate(df.limit(0), bench).count() == 0
    plan = dc.decontaminate(df, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def plain_template(text):
    """(template token, word) by a scan of letters and numbers."""
    out, last = [], 0
    for m in regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+", text):
        word = m[0]
        if regex.match(r"\p{N}", word):
            out.append((dc.NUMBER, word.lower()))
        elif regex.match(r"\p{Lu}", word):
            out.append((dc.NAME, word.lower()))
        elif out and out[-1][0] == dc.NUMBER and not text[last : m.start()].strip() and regex.fullmatch(f"(?i:{dc.UNITS})", word):
            out.append((dc.UNIT, word.lower()))
        else:
            out.append((word.lower(), word.lower()))
        last = m.end()
    return out


def plain_leaks(docs, items):
    """Items of each text: enough windows along alignments whose slots are consistent, or all words in a row."""
    slots = (dc.NUMBER, dc.NAME, dc.UNIT)
    out = defaultdict(set)
    for i, t in docs:
        d = plain_template(t)
        at = defaultdict(list)
        for p in range(len(d) - 4):
            at[tuple(x for x, _ in d[p : p + 5])].append(p)
        for k, b in items:
            x = plain_template(b)
            wins = {p: tuple(y for y, _ in x[p : p + 5]) for p in range(len(x) - 4) if sum(y not in slots for y, _ in x[p : p + 5]) >= dc.LITERALS}
            by = defaultdict(set)
            for p, w in wins.items():
                for q in at.get(w, []):
                    by[q - p].add(p)
            hits = set()
            for shift, ps in by.items():
                seen = defaultdict(set)
                for q in {p + j for p in ps for j in range(5)}:
                    if x[q][0] in slots:
                        seen[x[q]].add(d[q + shift][1])
                if all(len(v) == 1 for v in seen.values()):
                    hits |= ps
            words, mine = [y for _, y in d], [y for _, y in x]
            if wins and 100 * len(hits) >= dc.PERCENT * len(wins) or mine and any(words[p : p + len(mine)] == mine for p in range(len(words) - len(mine) + 1)):
                out[i].add(k)
    return {i: sorted(v) for i, v in out.items()}


def test_leaks_with_other_values_equal_a_plain_version(spark):
    r = random.Random(12)
    names, units, verbs = ["Anna", "Otto", "Maria Lopez", "Peter", "Zoe"], ["km", "kg", "hours", "miles"], ["carries", "buys", "sends", "finds"]
    forms = ["{a} {v} {n} {u} of rope to {b} and then {a} {v} {m} more of it", "how many {u} does {a} need if {b} has {n} and {c} has {m} of them left", "what is {n} plus {m}"]
    fill = lambda f, a, b, c: f.format(a=a, b=b, c=c, n=r.randrange(90), m=r.randrange(90), u=r.choice(units), v=r.choice(verbs))
    items = [(k, fill(forms[k % 3], *r.sample(names, 3))) for k in range(12)]
    docs = []
    for i in range(120):
        t = fill(r.choice(forms), *r.choices(names, k=3)) if i % 3 else r.choice(items)[1]
        if i % 4 == 0:
            t = t.replace(r.choice(names), r.choice(names), 1)
        docs.append((i, f"Some words before this. {t}. And Some after 5 km"))
    want = plain_leaks(docs, items)
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated")
    assert {x.doc_id: x.leaked_items for x in got.collect()} == want and 40 < len(want) < 120


def test_template_tokens_stand_for_words(spark):
    rows = [("In 1,5 km Anna-Maria's 3rd abc12 ÉTÉ",), ("5 %",), ("",)]
    got = spark.createDataFrame(rows, "t string").select(dc.canonical(F.col("t")).alias("c"), dc.tokens(F.col("t")).alias("w")).collect()
    assert all(len(r.c) == len(r.w) for r in got)
    assert got[0].c[:4] == [dc.NAME, dc.NUMBER, dc.UNIT, dc.NAME] and got[0].w[:3] == ["in", "1,5", "km"]


def test_exact_leaks_of_the_tables_are_found(spark):
    docs, bench = (pd.read_parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    want = {(int(i), int(k)) for i, t in zip(docs.doc_id, docs.text, strict=True) for k, b in zip(bench.item_id, bench.text, strict=True) if b in t}
    got = dc.decontaminate(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {(r.doc_id, k) for r in got.collect() for k in r.leaked_items} == want and want


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow are you today?"), (1, 1, "assistant", "> Hello there my friend\nI am fine thanks a lot"),
        (1, 2, "user", "On Monday X wrote:\n> I am fine  thanks a LOT\n>> Hello there my friend\nGood to hear"), (1, 3, "user", "unrelated message here"),
        (1, 4, "assistant", "> How are you today?\nnew branch"), (2, 0, "user", None), (None, 0, "user", "> a quotation"), (2, 1, "assistant", "> quoted nowhere at all\nbody"), (1, 4, "assistant", "> How are you today?\nnew branch"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, depth string, text string")
    got = cf.quotation_links(df).collect()
    assert len(got) == 9
    link = {(r.conv_id, r.turn): (r.reply_to, r.root_turn, r.depth, r.text) for r in got}
    assert link[1, 1] == (0, 0, 1, "I am fine thanks a lot") and link[1, 2] == (1, 0, 2, "Good to hear")
    assert link[1, 3][:3] == (None, 3, 0) and link[1, 4] == (0, 0, 1, "new branch") and link[2, 1] == (None, 1, 0, "body") and link[2, 0][3] is None
    ordered = cf.reply_order(cf.quotation_links(df.where("conv_id = 1"))).collect()
    assert sorted(ordered, key=lambda r: (r.root_turn, r.turn)) == ordered
    assert cf.quotation_links(df.limit(0)).count() == 0


def test_parse_levels():
    assert cf.parse("> > deep words here\n> outer words here\nmine")[1] == [(2, "deep words here"), (1, "outer words here")]
    assert cf.parse("no quotation > here") == ("no quotation > here", [])
    assert cf.parse("> first half of\n> a paragraph")[1][-1] == (1, "first half of a paragraph")


def test_lines_are_shuffled_in_portions(spark, monkeypatch):
    import hashlib

    from foliant.llm import line_dedup as ld

    made, whole = [], ld.cut

    def spy(df, *more):
        if "bucket" in df.columns:
            made.append([{r.id for r in x.select("id").collect()} for x in (df, *more)])
        return whole(df, *more)

    monkeypatch.setattr(ld, "cut", spy)
    lines = [hashlib.sha256(b"%d" % k).hexdigest() for k in range(400)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(lines[::-1]))], "doc_id long, text string")
    want = {r.id for r in spark.createDataFrame([(x,) for x in lines], "norm string").selectExpr("xxhash64(norm) as id").collect()}
    got = {r.doc_id: r.removed_lines for r in ld.line_dedup(docs).collect()}
    assert len(made) == 1 and len(made[0]) == ld.PORTIONS and sum(map(len, made[0])) == 400 and max(map(len, made[0])) < 200
    assert set().union(*made[0]) == want and got == {1: [], 2: list(range(400))}
