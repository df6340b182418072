"""Page layout: eligible boxes, overlaps, reading order, headings, titles, gaps and contexts.

Items have doc_id, seq (place in the source), item_type, label, level, text, page_no and l, t, r, b.
Overlap joins keep (doc_id, page_no) as equality keys, so they are hash or merge joins
with a residual condition, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from foliant.functions import geometry as g
from foliant.functions import text as tx
from foliant.operators.folds import ordered_fold

PAGE = ["doc_id", "page_no"]


def reading() -> list[Column]:
    return [F.col("t").desc(), F.col("seq")]


def eligible(items: DataFrame) -> DataFrame:
    """Text, table and picture items with a box, none of them tiny."""
    return items.where(F.col("item_type").isin("text", "table", "picture") & F.col("l").isNotNull()).where(~g.is_tiny())


def not_formula(items: DataFrame) -> DataFrame:
    return items.where(~F.coalesce(F.lower("label").contains("formula"), F.lit(False)))


BOX = [*PAGE, "seq", "l", "t", "r", "b"]


def centre_pairs(items: DataFrame, inner: str = "true", outer: str = "true") -> DataFrame:
    """Pairs (i, o) of boxes of a page of which the centre of `i` (where `inner` holds) may lie in `o` (where `outer` holds): all such pairs, and few others.

    A box is put into the cells that it touches of a grid as wide as itself (a power of two), four at most; its
    centre looks up its cell in each grid of the page that can hold a box to cover it. So pairs are those of places, not of pages. Boxes that
    are turned around share no area with any. Both sides come from one shuffle by page.
    """
    grid = F.ceil(F.log2(F.greatest(F.col("r") - F.col("l"), F.col("t") - F.col("b")))).cast("int")
    cell = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level))
    boxes = items.select(*BOX, "item_type").where("r > l and t > b").withColumn("_grid", grid).withColumn("_top", F.max("_grid").over(Window.partitionBy(*PAGE)))
    o = boxes.where(outer)
    for name, low, high in (("_x", "l", "r"), ("_y", "b", "t")):
        o = o.withColumn(name, F.explode(F.sequence(cell(F.col(low), F.col("_grid")), cell(F.col(high), F.col("_grid")))))
    i = boxes.where(inner).withColumn("_grid", F.explode(F.sequence(F.col("_grid") - 1, F.col("_top"))))
    i = i.withColumn("_x", cell((F.col("l") + F.col("r")) / 2, F.col("_grid"))).withColumn("_y", cell((F.col("b") + F.col("t")) / 2, F.col("_grid")))
    return i.alias("i").join(o.alias("o"), reduce(Column.__and__, [F.col(f"i.{k}") == F.col(f"o.{k}") for k in ("_grid", "_x", "_y")], _same_page()))


def _same_page() -> Column:
    return F.col("i.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("i.page_no").eqNullSafe(F.col("o.page_no"))


def _ends(pairs: DataFrame, side: str = "i") -> DataFrame:
    return pairs.select(*[F.col(f"{side}.{k}").alias(k) for k in BOX]).distinct()


def _without(items: DataFrame, gone: DataFrame) -> DataFrame:
    """`items` but for the boxes in `gone`, each there once. An outer join, since an anti join would be pushed into each branch of a union, and all that `gone` takes with it."""
    same = reduce(Column.__and__, [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in BOX])
    return items.alias("i").join(gone.withColumn("_gone", F.lit(True)).alias("o"), same, "left").where("o._gone is null").select("i.*")


def _covered(threshold: float) -> Column:
    return (F.col("i.seq") != F.col("o.seq")) & (g.area("o") > g.area("i")) & (g.area("i") > 0) & (g.intersection("i", "o") >= threshold * g.area("i"))


def _twin(threshold: float) -> Column:
    inter = g.intersection("i", "o")
    return (F.col("i.item_type") == "picture") & (F.col("o.item_type") == "table") & (g.area("i") > 0) & (g.area("o") > 0) & (inter >= threshold * g.area("i")) & (inter >= threshold * g.area("o"))


def drop_contained(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Without boxes of which a larger box of the page covers `threshold` or more; boxes that go still cover others.

    More than half of each side is covered where more than half of the area is, so the larger box holds the centre; for lower thresholds all pairs of a page are compared.
    """
    pairs = centre_pairs(items) if threshold > 0.5 else items.alias("i").join(items.alias("o"), _same_page())
    return _without(items, _ends(pairs.where(_covered(threshold))))


def drop_duplicate_pictures(items: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Without pictures that a table of the page covers, and that cover it, by `threshold` (over a half) or more."""
    return _without(items, _ends(centre_pairs(items, "item_type = 'picture'", "item_type = 'table'").where(_twin(threshold))))


def drop_overlaps(items: DataFrame, contained: float = 0.8, twin: float = 0.9) -> DataFrame:
    """drop_duplicate_pictures(drop_contained(items)) from one set of pairs: a picture goes for a table that is not contained in another box itself."""
    pairs = centre_pairs(items)
    covered = _ends(pairs.where(_covered(contained)))
    twins = pairs.where(_twin(twin)).select(*[F.col(f"{x}.{k}").alias(f"{x}_{k}") for x in "io" for k in BOX]).alias("p")
    kept = twins.join(covered.alias("c"), reduce(Column.__and__, [F.col(f"p.o_{k}").eqNullSafe(F.col(f"c.{k}")) for k in BOX]), "left_anti")
    return _without(items, covered.union(kept.select(*[F.col(f"i_{k}").alias(k) for k in BOX])).distinct())


def number_boxes(items: DataFrame, formulas_absorb: bool = True) -> DataFrame:
    """`box_num` from 1 on each page, in reading order, after overlaps and without formulas.

    With `formulas_absorb` formulas take part in the overlap rules before they go.
    """
    kept = eligible(items)
    kept = kept if formulas_absorb else not_formula(kept)
    kept = not_formula(drop_overlaps(kept))
    return kept.withColumn("box_num", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*reading())))


def heading_stacks(items: DataFrame, tasks: int | None = None) -> DataFrame:
    """`headings`: at a section header the stack is cut to its level and its text put on top; other items take the last stack.

    Only headers are folded in order, in one pass over those of a document. Their stacks come to the items as rows of the same shuffle,
    numbered like the headers, and a window over the number of headers so far hands them on; so items are shuffled once, by document, into `tasks` partitions if they are given.
    """
    head = F.coalesce((F.lower("label") == "section_header") & ~tx.falsy(F.col("text")), F.lit(False))
    order = Window.partitionBy("doc_id").orderBy("page_no", *reading())
    headers = items.where(head).withColumn("_n", F.row_number().over(order).cast("long"))

    def begin() -> Callable[[int | None, str], list[str]]:
        stack: list[str] = []

        def step(level: int | None, text: str) -> list[str]:
            nonlocal stack
            stack = [*stack[: max(level or 0, 0)], text]
            return stack

        return step

    stacks = ordered_fold(headers, ["doc_id"], "_n", ["level", "text"], begin, "_stack", T.ArrayType(T.StringType()))
    rows = items.withColumn("_head", head.cast("int")).unionByName(stacks, allowMissingColumns=True)
    rows = rows if tasks is None else rows.repartition(tasks, "doc_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.coalesce("_n", F.sum("_head").over(upto)))
    found = F.max("_stack").over(Window.partitionBy("doc_id", "_n"))
    return rows.withColumn("headings", F.coalesce(found, F.array().cast("array<string>"))).where("_head is not null").drop("_n", "_head", "_stack")


def missed_tables(items: DataFrame, detected: DataFrame, band: float = 50.0) -> DataFrame:
    """Table titles with no detected table within `band` points of their top, each with the union box of its block."""
    order = Window.partitionBy("doc_id").orderBy("seq")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    texts = items.where((F.col("item_type") == "text") & F.col("l").isNotNull())
    title = F.coalesce(F.trim("text").rlike(tx.TABLE_TITLE), F.lit(False))
    stop = title | ((F.lower("label") == "section_header") & F.upper(F.col("text")).rlike(tx.STOP_WORDS))
    marked = texts.withColumn("is_title", title).withColumn("next_stop", F.min(F.when(stop, F.col("seq"))).over(after))
    titles = marked.where("is_title").alias("i").join(
        detected.alias("o"), (F.col("i.doc_id") == F.col("o.doc_id")) & (F.col("i.page_no") == F.col("o.page_no")) & (F.abs(F.col("i.t") - F.col("o.t")) < band), "left_anti"
    ).select("doc_id", "page_no", F.col("seq").alias("title_seq"), F.trim("text").alias("title"), "next_stop")
    block = texts.join(titles, PAGE).where((F.col("seq") >= F.col("title_seq")) & (F.col("next_stop").isNull() | (F.col("seq") < F.col("next_stop"))))
    return block.groupBy("doc_id", "page_no", "title_seq", "title").agg(*union_box())


def union_box() -> list[Column]:
    return [F.min("l").alias("l"), F.max("t").alias("t"), F.max("r").alias("r"), F.min("b").alias("b")]


def gap_pages(detected: DataFrame) -> DataFrame:
    """Pages between detected pages that have none themselves; a document needs two detected pages."""
    pages = detected.select("doc_id", "page_no").distinct()
    nxt = pages.withColumn("next", F.lead("page_no").over(Window.partitionBy("doc_id").orderBy("page_no"))).where("next > page_no + 1")
    return nxt.select("doc_id", F.explode(F.sequence(F.col("page_no") + 1, F.col("next") - 1)).alias("page_no"))


def continued_pages(items: DataFrame, detected: DataFrame) -> DataFrame:
    """Pages with a header that says 'continued' and no detected table."""
    said = items.where((F.lower("label") == "section_header") & F.lower("text").contains("continued")).select("doc_id", "page_no").distinct()
    return said.join(detected.select("doc_id", "page_no").distinct(), PAGE, "left_anti")


def continuation_boxes(items: DataFrame, detected: DataFrame) -> DataFrame:
    """Union boxes of the texts of gap and continued pages."""
    pages = gap_pages(detected).union(continued_pages(items, detected)).distinct()
    return items.where("item_type = 'text'").join(pages, PAGE, "left_semi").groupBy(*PAGE).agg(*union_box())


def figure_context(items: DataFrame, size: int = 300, nearest: bool = False) -> DataFrame:
    """Text above and below each picture of a page.

    `above` joins the texts above from the nearest up and keeps the last `size` characters, so the
    farthest; `nearest` keeps the first ones instead.
    """
    fig = items.where("item_type = 'picture'").select(*PAGE, F.col("seq").alias("fig"), F.col("t").alias("ft"), F.col("b").alias("fb"))
    txt = items.where((F.col("item_type") == "text") & ~tx.falsy(F.col("text"))).select(*PAGE, "seq", "text", "t", "b")
    both = fig.join(txt, PAGE, "left")
    joined = lambda keep, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(key.alias("k"), "seq", "text")))), lambda x: x["text"]), " ")
    got = both.groupBy(*PAGE, "fig").agg(joined(F.col("b") > F.col("ft"), F.col("b")).alias("up"), joined(F.col("t") < F.col("fb"), -F.col("t")).alias("down"))
    up = F.left("up", F.lit(size)) if nearest else F.right("up", F.lit(size))
    return got.select(*PAGE, F.col("fig").alias("seq"), F.trim(up).alias("above"), F.trim(F.left("down", F.lit(size))).alias("below"))


def formula_pages(items: DataFrame) -> DataFrame:
    return items.where(F.lower("label").contains("formula")).select(*PAGE).distinct()


def table_candidates(items: DataFrame, detected: DataFrame) -> DataFrame:
    """Detected, missed, continuation and large-picture tables with ids in order of discovery, and their place in reading order."""
    cols = ["doc_id", "page_no", "seq", "l", "t", "r", "b"]
    parts = [
        detected.select(*cols, F.lit("detected").alias("source")),
        missed_tables(items, detected).withColumnRenamed("title_seq", "seq").select(*cols, F.lit("missed").alias("source")),
        continuation_boxes(items, detected).withColumn("seq", F.lit(0)).select(*cols, F.lit("continuation").alias("source")),
        items.where("item_type = 'picture'").where(g.is_table_picture()).select(*cols, F.lit("picture_table").alias("source")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    rank = F.when(F.col("source") == "detected", 0).when(F.col("source") == "missed", 1).when(F.col("source") == "continuation", 2).otherwise(3)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "page_no", "seq"))
    return in_reading_order(every.withColumn("n", n)).withColumn("table_id", F.concat(F.lit("table_"), "n")).drop("n")


def extract(items: DataFrame, detected: DataFrame, tables: bool = True, figures: bool = True, formula_pages_too: bool = True) -> DataFrame:
    """What goes to a vision model, (doc_id, page_no, kind, id, l, t, r, b): tables of every source, figures that are no table candidates, and whole pages with formulas; each kind can be left out."""
    cols = ["doc_id", "page_no", "kind", "id", "l", "t", "r", "b"]
    parts = []
    if tables:
        parts.append(table_candidates(items, detected).select("*", F.lit("table").alias("kind"), F.col("table_id").alias("id")).select(*cols))
    if figures:
        pictures = items.where("item_type = 'picture' and l is not null").where(~g.is_table_picture())
        n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", *reading()))
        parts.append(pictures.select("*", F.lit("figure").alias("kind"), F.concat(F.lit("figure_"), n).alias("id")).select(*cols))
    if formula_pages_too:
        none = [F.lit(None).cast("double").alias(k) for k in "ltrb"]
        parts.append(formula_pages(items).select("*", F.lit("formula_page").alias("kind"), F.concat(F.lit("page_"), "page_no").alias("id"), *none).select(*cols))
    return reduce(DataFrame.unionByName, parts) if parts else items.select(*PAGE, F.lit("").alias("kind"), F.lit("").alias("id"), "l", "t", "r", "b").limit(0)


def in_reading_order(tables: DataFrame) -> DataFrame:
    """`place` from 1 in a document: by page, from the top down."""
    w = Window.partitionBy("doc_id").orderBy("page_no", F.desc("t"), *[c for c in ("n", "seq") if c in tables.columns])
    return tables.withColumn("place", F.row_number().over(w))


def source_counts(tables: DataFrame) -> DataFrame:
    """Tables of each document by where they come from."""
    kinds = ("detected", "missed", "continuation", "picture_table")
    return tables.groupBy("doc_id").agg(F.count("*").alias("n_tables"), *[F.count_if(F.col("source") == k).alias(f"n_{k}") for k in kinds])


def content_blocks(items: DataFrame, cap: int = 100) -> DataFrame:
    """One text a page that lists its numbered blocks; blank and placeholder blocks only take a number."""
    boxes = number_boxes(items, formulas_absorb=False)
    said = F.when(tx.falsy(F.trim("text")) | (F.col("item_type") != "text"), F.lit(None)).otherwise(F.concat(F.lit("["), "box_num", F.lit("] "), F.left("text", F.lit(cap))))
    return boxes.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("box_num", said.alias("x"))))), lambda s: s["x"]), "\n").alias("blocks"))
