"""Markdown tables, vision results and multi-page tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from foliant.functions import text as tx

#: Points within which a vision result matches a box, columns that make a chain, top of a continuation, longest cell of an invented header.
TOLERANCE, MIN_COLUMNS, TOP, LABEL = 5.0, 3, 650.0, 35


def parse_markdown(markdown: Column) -> Column:
    """Struct of a table: lines, header, separator, data, col_count and the text before it."""
    lines = F.split(F.coalesce(markdown, F.lit("")), "\n")
    bars = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x.startswith("|"))
    first = F.array_position(F.transform(lines, lambda x: F.trim(x).startswith("|")), True)
    before = F.when(first > 0, F.slice(lines, 1, (first - 1).cast("int"))).otherwise(lines)
    sep = F.array_position(F.transform(bars, tx.is_separator), True).cast("int")

    def whole(b: Column, s: Column) -> Column:
        cols = F.when(F.size(b) == 0, 0).otherwise(tx.column_count(F.get(b, F.greatest(s - 1, F.lit(0)))))
        return F.struct(
            b.alias("lines"), F.when(s > 1, F.get(b, s - 2)).alias("header"), F.when(s > 0, F.get(b, s - 1)).alias("separator"),
            F.when(s > 0, F.slice(b, s + 1, F.size(b))).otherwise(b).alias("data"), cols.alias("col_count"), F.trim(F.array_join(before, "\n")).alias("before"),
        )

    return whole(bars, sep)


def is_real_table(markdown: Column) -> Column:
    """Two table lines at least, the first of two columns at least."""
    bars = F.filter(F.transform(F.split(F.coalesce(markdown, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    return (F.size(bars) >= 2) & (tx.column_count(F.get(bars, 0)) >= 2)


def linkable(vlm: DataFrame) -> DataFrame:
    return vlm.where(F.col("success") & ~tx.falsy(F.col("markdown")))


def link_pages(tables: DataFrame) -> DataFrame:
    """`tables` (doc_id, page_no, seq, t, markdown) with the header of the table they continue.

    A page's first table continues the last of the page before if both have the same number of
    columns, three at least, and it begins near the top. The header is carried by page: from a chain's first
    page through all pages whose first table was linked.
    """
    doc_page = Window.partitionBy("doc_id", "page_no")
    order = [F.col("t").desc(), F.col("seq")]
    parsed = tables.withColumn("p", parse_markdown(F.col("markdown")))
    ranked = parsed.withColumn("_first", F.row_number().over(doc_page.orderBy(*order)) == 1)
    ends = ranked.groupBy("doc_id", "page_no").agg(
        F.max_by(F.struct("p.col_count", "p.header", "p.separator"), F.struct(-F.col("t"), "seq")).alias("last"),
        F.min_by(F.struct("p.col_count", "t"), F.struct(-F.col("t"), "seq")).alias("first"),
    )
    w = Window.partitionBy("doc_id").orderBy("page_no")
    prev = F.lag(F.struct("page_no", "last")).over(w)
    step = ends.withColumn("prev", prev)
    fits = F.coalesce(
        (F.col("prev.page_no") == F.col("page_no") - 1) & (F.col("prev.last.col_count") == F.col("first.col_count")) & (F.col("first.col_count") >= MIN_COLUMNS) & (F.col("first.t") >= TOP), F.lit(False)
    )
    # a run of fitting pages starts at a page whose previous page has a header of its own
    step = step.withColumn("fits", fits).withColumn("own", F.col("prev.last.header").isNotNull() & F.col("prev.last.separator").isNotNull())
    step = step.withColumn("run", F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(w))
    start = F.min(F.when(F.col("fits") & F.col("own"), F.struct("page_no", F.col("prev").alias("from")))).over(Window.partitionBy("doc_id", "run").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0))
    linked = step.withColumn("start", start).where("fits and start is not null")
    linked = linked.select("doc_id", "page_no", F.col("start.from.last.header").alias("header"), F.col("start.from.last.separator").alias("separator"), F.col("start.from.page_no").alias("origin_page"))
    out = ranked.join(linked, ["doc_id", "page_no"], "left")
    hit = F.col("_first") & F.col("origin_page").isNotNull()
    data = F.filter("p.lines", lambda x: ~tx.is_separator(x))
    data = F.when(tx.longest_cell(F.get(data, 0)) <= LABEL, F.slice(data, 2, F.greatest(F.size(data), F.lit(1)))).otherwise(data)
    lead = F.when(F.col("p.before") != "", F.array("p.before")).otherwise(F.array().cast("array<string>"))
    rebuilt = F.array_join(F.concat(lead, F.array("header", "separator"), data), "\n")
    return out.withColumn("markdown", F.when(hit, rebuilt).otherwise(F.col("markdown"))).withColumn("continuation_of", F.when(hit, F.col("origin_page"))).drop("p", "_first", "header", "separator", "origin_page")


def nearest_match(boxes: DataFrame, vlm: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, page_no, seq, vseq): each box of `boxes`, from the top, takes the vision result at its rounded top, else the nearest within `tolerance`.

    A result is taken once; of results with one rounded top the last counts, at the place of the first. A box and a result
    that have only each other in reach are matched by the join; only those with a
    choice go through the greedy assignment, page by page.
    """
    key = F.bround("t", 0)
    v = vlm.withColumn("k", key).groupBy("doc_id", "page_no", "k").agg(F.max("seq").alias("vseq"), F.min("seq").alias("place"))
    b = boxes.select("doc_id", "page_no", "seq", "t", key.alias("bk"))
    near = b.join(v, ["doc_id", "page_no"]).where(F.abs(F.col("bk") - F.col("k")) <= tolerance)
    of = lambda c: F.count("*").over(Window.partitionBy("doc_id", "page_no", c))
    near = near.withColumn("nv", of("seq")).withColumn("nb", of("vseq"))
    lone = near.where("nb = 1 and nv = 1").select("doc_id", "page_no", "seq", "vseq")

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        out = []
        rows = rows.assign(gap=(rows["bk"] - rows["k"]).abs()).sort_values(["t", "seq", "gap", "place"], ascending=[False, True, True, True])
        for (_, seq), group in rows.groupby([-rows["t"], "seq"], sort=True):
            free = group[~group["vseq"].isin(taken)]
            if len(free):
                best = free.iloc[0]
                taken.add(best["vseq"])
                out.append((best["doc_id"], best["page_no"], seq, best["vseq"]))
        return pd.DataFrame(out, columns=["doc_id", "page_no", "seq", "vseq"])

    schema = near.select("doc_id", "page_no", "seq", "vseq").schema
    return lone.unionByName(near.where("nb > 1 or nv > 1").groupBy("doc_id", "page_no").applyInPandas(greedy, schema))


def in_page_order(results: DataFrame) -> DataFrame:
    """`place` from 1 of a document's vision results: by page, then as they came."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "seq")))


def match_sources(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Results with the `source` of the extraction (doc_id, page_no, seq, source) at the same place, both in page order."""
    at = in_page_order(sources).select("doc_id", "place", "source")
    return in_page_order(results).join(at, ["doc_id", "place"], "left")


def successful(extras: DataFrame) -> DataFrame:
    """Results that say that they succeeded; null is no success."""
    return extras.where(F.coalesce(F.col("success"), F.lit(False)))


def match_vision(boxes: DataFrame, vlm: DataFrame) -> DataFrame:
    """Table and picture boxes with `chunk_text`; pictures that a result calls irrelevant go.

    `relevant` null with `has_relevant` counts as irrelevant; an absent key keeps the picture.
    """
    seen = vlm if "has_relevant" in vlm.columns else vlm.withColumn("has_relevant", F.col("relevant").isNotNull())
    parts = []
    for kind in ("table", "picture"):
        b, v = boxes.where(F.col("item_type") == kind), seen.where(F.col("kind") == kind)
        m = nearest_match(b, v)
        found = b.join(m, ["doc_id", "page_no", "seq"], "left").join(
            v.select("doc_id", "page_no", F.col("seq").alias("vseq"), F.lit(True).alias("found"), "success", "markdown", "has_relevant", "relevant", "description", "figure_type", "caption"), ["doc_id", "page_no", "vseq"], "left"
        )
        good = F.coalesce("success", F.lit(False))
        if kind == "table":
            text = F.when(good, F.coalesce("markdown", F.lit("[Table]"))).otherwise("[Table]")
        else:
            text = F.when(good, tx.figure_text(F.col("figure_type"), F.col("caption"), F.col("description"))).otherwise("[Figure]")
            found = found.where(~(F.coalesce("found", F.lit(False)) & F.col("has_relevant") & ~F.coalesce("relevant", F.lit(False))) | F.col("found").isNull())
        parts.append(found.withColumn("chunk_text", text))
    return parts[0].unionByName(parts[1])
