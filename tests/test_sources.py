"""Web pages as layout items, and the paged search as a partitioned and streaming source."""

from __future__ import annotations

import json
import os

import duckdb

from foliant import catalog
from foliant.plans import pipelines as pl
from foliant.sources import html as hm
from foliant.sources import search_source as ss


class Folder:
    """Pages of hits in files; page 2 always fails, and page 3 the first time."""

    def __init__(self, path):
        self.path = path

    def pages(self):
        return len([p for p in os.listdir(self.path) if p.endswith(".json")])

    def fetch(self, page):
        if page == 2:
            raise OSError("gone")
        if page == 3 and not os.path.exists(f"{self.path}/tried"):
            open(f"{self.path}/tried", "w").close()
            raise TimeoutError("slow")
        with open(f"{self.path}/{page}.json") as f:
            return [tuple(x) for x in json.load(f)]


def put(path, page, *rows):
    (path / f"{page}.json").write_text(json.dumps(rows))


def test_search_in_parts(spark, tmp_path):
    for k in range(9):
        put(tmp_path, k, [f"a{k}", k], [f"b{k // 2}", k])
    ss.register(spark, "parts", Folder(str(tmp_path)), "id string, n int", pages_a_task=2)
    rows = spark.read.format("parts").load()
    assert rows.rdd.getNumPartitions() == 5
    assert sorted(r.id for r in ss.hits(rows, "id").collect()) == sorted([f"a{k}" for k in range(9) if k != 2] + [f"b{k}" for k in range(5)])
    assert [(r.page, r.error) for r in ss.failed(rows).collect()] == [(2, "OSError: gone")]


def test_search_stream_goes_on_where_it_was(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    ss.register(spark, "flow", Folder(str(src)), "id string, n int")

    def run():
        rows = ss.hits(spark.readStream.format("flow").load(), "id")
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(out).collect())

    for k in range(2):
        put(src, k, [f"a{k}", k], ["same", k])
    assert run() == ["a0", "a1", "same"]
    assert run() == ["a0", "a1", "same"]
    for k in range(2, 6):
        put(src, k, [f"a{k}", k], ["same", k], [f"a{k - 1}", k])
    assert run() == ["a0", "a1", "a2", "a3", "a4", "a5", "same"]


PAGE = """<!doctype html><title>no</title><body><nav>around</nav><h1>Top &amp; head</h1><p>first <b>bold<p>second<br>line
<ul><li>one<li>two <ul><li>inner</ul><li>three</ul></section>
<h2>Part<h3>Sub</h3> loose text <!-- <p>no</p> --><table><caption>Cap</caption><tr><th>a<th>b<tr><td>1<p>x<td>2 | 3<tr><td>last</table>
<div>5 < 6 and <span title="a > b">7</span></div><img src=x alt='A figure'><script>document.write("<p>no</p>")</script><footer>around</footer><p>end<!-- never closed <p>lost"""


def test_blocks_of_malformed_pages():
    assert list(hm.blocks(PAGE)) == [
        ("text", "section_header", 0, "Top & head"), ("text", "text", 0, "first bold"), ("text", "text", 0, "second\nline"), ("text", "list_item", 0, "one"), ("text", "list_item", 0, "two"),
        ("text", "list_item", 0, "inner"), ("text", "list_item", 0, "three"), ("text", "section_header", 1, "Part"), ("text", "section_header", 2, "Sub"), ("text", "text", 0, "loose text"),
        ("text", "caption", 0, "Cap"), ("table", "table", 0, "| a | b |\n|---|---|\n| 1 x | 2 / 3 |\n| last |  |"), ("text", "text", 0, "5 < 6 and 7"), ("picture", "picture", 0, "A figure"), ("text", "text", 0, "end"),
    ]
    assert list(hm.blocks("")) == [] and list(hm.blocks("<table><tr><td></table>")) == [] and list(hm.blocks("</p></p>x</div>")) == [("text", "text", 0, "x")]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert list(hm.blocks(deep)) == [("text", "text", 0, "x")]


def test_no_text_is_lost_or_twice():
    import random

    r = random.Random(2)
    tags = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "h2", "span", "section", "pre"]
    for _ in range(300):
        words, page = [], ""
        for k in range(r.randrange(1, 40)):
            page += r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f" w{k} "])
            if page.endswith(f" w{k} "):
                words.append(f"w{k}")
        got = " ".join(x[3] for x in hm.blocks(page))
        assert sorted(w for w in got.replace("|", " ").replace("-", " ").split()) == sorted(words), page


#: Titles as a cut leaves them, and whole ones.
CUT = ["token = &quot", "token = &quo", "R &amp", "R &am", "&copy", "&quot;a&quot; &copy; R &amp; D", "&amp;quot; &ampcopy;", "a &amp &quot b"]


def cut_titles(spark, folder):
    pages = [(i, "u", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p>{t}<br>x</p></article></body></html>") for i, t in enumerate(CUT)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return con


def test_html_items_keep_what_is_no_whole_entity(spark, tmp_path):
    con, q = cut_titles(spark, tmp_path), "select doc_id, seq, label, text from"
    got = catalog.QUERIES["html_items"](spark, str(tmp_path)).select("doc_id", "seq", "label", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"{q} ({catalog.ORACLE_SQL['html_items']})").fetchall())
    assert [x[3] for x in hm.blocks("<p>&lt;&#39;&#x41;&nosuch; &notit; &eacute;&eacute")] == ["<'A&nosuch; &notit; é&eacute"]


def test_pages_become_chunks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (None, PAGE), (4, "<p>" + "long " * 100)], "page_id long, html string")
    got = [(r.doc_id, r.ord, r.chunk_type, r.headings) for r in pl.web_chunks(pages).orderBy("doc_id", "ord").collect()]
    assert [x[2] for x in got if x[0] == 1] == ["text", "table", "text", "picture", "text"]
    assert {x[0] for x in got} == {1, 4} and next(x[3] for x in got if x[2] == "table") == ["Top & head", "Part", "Sub"]


def test_headings_of_chunks_keep_what_is_no_whole_entity(spark, tmp_path):
    con, q = cut_titles(spark, tmp_path), "select doc_id, ord, text, heading from"
    got = catalog.QUERIES["html_chunks"](spark, str(tmp_path)).select("doc_id", "ord", "text", "heading").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"{q} ({catalog.ORACLE_SQL['html_chunks']})").fetchall())
