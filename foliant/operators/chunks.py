"""Chunk building and merging.

Chunks have doc_id, ord, chunk_type, text, page_no, headings and meta (map of strings).
Merges whose start depends only on the neighbouring row are windows; those that depend on the
running length are ordered folds, in one pass over the lengths of a document alone, never over the texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from foliant.functions import text as tx
from foliant.operators.folds import ordered_fold
from foliant.session import stored

MIN_SIZE, MAX_SIZE, TARGET = 150, 2000, 512
#: Boxes of a task in which build_chunks() sorts whole texts: five sorts of so many stay in a task's memory, where partitions of a fixed number would grow and spill.
TASK_BOXES = 50_000


def in_order(value: Column, order: Column, sep: str) -> Column:
    """Aggregate: values joined by `sep` in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), sep)


def merge_small(chunks: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """A text chunk under `min_size` joins the text chunk before it; page, order and headings of the first stay."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    joins = (F.col("chunk_type") == "text") & (F.length("text") < min_size) & F.coalesce(F.lag("chunk_type").over(w) == "text", F.lit(False))
    grouped = chunks.withColumn("_g", F.sum(F.when(joins, 0).otherwise(1)).over(w))
    return (
        grouped.groupBy("doc_id", "_g")
        .agg(F.min("ord").alias("ord"), F.min_by("chunk_type", "ord").alias("chunk_type"), in_order(F.col("text"), F.col("ord"), "\n").alias("text"), F.min_by("page_no", "ord").alias("page_no"), F.min_by("headings", "ord").alias("headings"), (F.count("*") > 1).alias("merged_small"))
        .drop("_g")
    )


def _fold_groups(chunks: DataFrame, by: list[str], opens: Callable[[int, bool, int, bool], bool], gap: int) -> DataFrame:
    """`_g` of each row from one pass over the sizes of a group in order.

    `opens` tells from the running size and type of the open chunk and those of the next one whether a new one begins; `gap` characters join two.
    """

    def begin() -> Callable[[str, int | None], int]:
        gid, size, text = 0, 0, False

        def step(kind: str, length: int | None) -> int:
            nonlocal gid, size, text
            is_text, n = kind == "text", length or 0
            if not gid or opens(size, text, n, is_text):
                gid, size = gid + 1, n
            else:
                size += n + gap
            text = is_text
            return gid

        return step

    sizes = chunks.select(*by, "ord", "chunk_type", F.length("text").alias("size"))
    return chunks.join(ordered_fold(sizes, by, "ord", ["chunk_type", "size"], begin, "_g", T.LongType()), [*by, "ord"])


def merge_to_max(chunks: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """Consecutive text chunks joined while their lengths add up to no more than `max_size`; other types stand alone."""
    grouped = _fold_groups(chunks, ["doc_id"], lambda size, text, n, is_text: not text or not is_text or size + n > max_size, 0)
    return grouped.groupBy("doc_id", "_g").agg(
        F.min("ord").alias("ord"), F.min_by("chunk_type", "ord").alias("chunk_type"), in_order(F.col("text"), F.col("ord"), "\n\n").alias("text"), F.min_by("page_no", "ord").alias("page_no"), F.min_by("headings", "ord").alias("headings"), (F.count("*") > 1).alias("merged")
    ).drop("_g")


def heading_groups(chunks: DataFrame) -> DataFrame:
    """`grp` of text chunks: a new one after another type, a gap in `ord`, or other headings."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    last = F.lag(F.struct("chunk_type", "ord", "headings")).over(w)
    marked = chunks.withColumn("_last", last)
    same = (F.col("_last.chunk_type") == "text") & (F.col("_last.ord") == F.col("ord") - 1) & F.col("_last.headings").eqNullSafe(F.col("headings"))
    return marked.withColumn("grp", F.sum(F.when(F.coalesce(same & (F.col("chunk_type") == "text"), F.lit(False)), 0).otherwise(1)).over(w)).drop("_last").where("chunk_type = 'text'")


def merge_to_target(chunks: DataFrame, target: int = TARGET, max_size: int = MAX_SIZE) -> DataFrame:
    """Within heading groups, chunks joined until `target` characters are reached, never beyond `max_size`."""
    groups = heading_groups(chunks)

    grouped = _fold_groups(groups, ["doc_id", "grp"], lambda size, text, n, is_text: size >= target or size + n + 2 > max_size, 2)
    return grouped.groupBy("doc_id", "grp", "_g").agg(
        F.min("ord").alias("ord"), in_order(F.col("text"), F.col("ord"), "\n\n").alias("text"), F.min_by("page_no", "ord").alias("page_no"), F.min_by("headings", "ord").alias("headings"),
        F.sort_array(F.collect_list("ord")).alias("original_orders"), (F.count("*") > 1).alias("merged"),
    ).drop("grp", "_g")


def renumber(chunks: DataFrame) -> DataFrame:
    """`ord` from 0 by page and from the top; chunks without a top first on their page."""
    top = F.coalesce(F.col("t"), F.lit(float("inf")))
    w = Window.partitionBy("doc_id").orderBy("page_no", top.desc(), "seq")
    return chunks.withColumn("ord", F.row_number().over(w) - 1)


def place_formulas(boxes: DataFrame, formulas: DataFrame) -> DataFrame:
    """Formulas with the box that each is anchored to, or unplaced (only with latex); the first of an id counts.

    The estimated box reaches from the anchor's bottom to the next box's top, or 100 points down.
    """
    page = ["doc_id", "page_no"]
    once = Window.partitionBy(*page, "formula_id").orderBy("seq")
    nxt = F.lead("t").over(Window.partitionBy(*page).orderBy("box_num"))
    anchors = boxes.select(*page, F.col("box_num").alias("after_box"), "l", "r", F.col("b").alias("t"), F.coalesce(nxt, F.col("b") - 100).alias("b"))
    joined = formulas.join(anchors, [*page, "after_box"], "left").withColumn("placed", F.col("l").isNotNull())
    first = joined.withColumn("_n", F.row_number().over(once.orderBy(F.col("placed").desc(), F.col("after_box"), "seq"))).where("_n = 1").drop("_n")
    text = tx.formula_text(F.col("latex"), F.col("equation_number"), F.col("description"))
    return first.where(F.col("placed") | ~tx.falsy(F.col("latex"))).withColumn("text", text)


def lone_formulas(formulas: DataFrame) -> DataFrame:
    """`place` from 1 of formulas that stand alone on a page: after their box, those without one first."""
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.coalesce("after_box", F.lit(0)), "seq")
    return formulas.withColumn("place", F.row_number().over(w))


def merge_stats(before: DataFrame, after: DataFrame, key: str = "point_id") -> DataFrame:
    """One row a document of a merge run: text chunks before and after, chunks deleted and created, and those of other types."""
    count = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    parts = [
        count(before.where("chunk_type = 'text'"), "text_before"), count(before.where("chunk_type <> 'text'"), "non_text"),
        count(before.join(after.select(key), key, "left_anti"), "deleted"), count(after.join(before.select(key), key, "left_anti"), "created"),
    ]
    out = before.select("doc_id").union(after.select("doc_id")).distinct()
    names = ["text_before", "non_text", "deleted", "created"]
    for part in parts:
        out = out.join(part, "doc_id", "left")
    out = out.na.fill(0, names)
    return out.withColumn("text_after", F.col("text_before") - F.col("deleted") + F.col("created"))


def covering(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, box_num, region) of the boxes that an inline region covers: the last region wins.

    A null first box counts as 0 and so matches no box.
    """
    page = ["doc_id", "page_no"]
    r = regions.select(*page, F.col("seq").alias("rseq"), F.coalesce("start_box", F.lit(0)).alias("lo"), F.coalesce("last_box", "start_box", F.lit(0)).alias("hi"), "formatted_text")
    return boxes.select(*page, "box_num").join(r, page).where("box_num between lo and hi").groupBy(*page, "box_num").agg(F.max_by(F.struct("lo", "hi", "formatted_text"), "rseq").alias("region"))


def region_text(region: str = "region", box: str = "box_num") -> Column:
    """The text of a box under a region (perhaps none): the region's stands at its first box and the others vanish."""
    return F.when(F.col(region).isNull(), F.col("text")).when(F.col(box) == F.col(f"{region}.lo"), F.coalesce(f"{region}.formatted_text", "text"))


def cover_regions(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Text boxes with the inline region that covers each, if any, and the text that stands there."""
    out = boxes.join(covering(boxes, regions), ["doc_id", "page_no", "box_num"], "left")
    return out.withColumn("text", region_text()).where(F.col("text").isNotNull())


def id_changes(before: DataFrame, after: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, change) of the ids that went and those that came."""
    gone = before.select(key).distinct().join(after, key, "left_anti").withColumn("change", F.lit("deleted"))
    new = after.select(key).distinct().join(before, key, "left_anti").withColumn("change", F.lit("created"))
    return gone.unionByName(new)


def flatten_meta(chunks: DataFrame) -> DataFrame:
    """`meta` keys with their storage prefix."""
    return chunks.withColumn("meta", F.transform_keys("meta", lambda k, v: F.concat(F.lit("meta_"), k)))


def unflatten_meta(chunks: DataFrame) -> DataFrame:
    """Prefixed keys alone, with every occurrence of the prefix taken out."""
    kept = F.map_filter("meta", lambda k, v: k.startswith("meta_"))
    return chunks.withColumn("meta", F.transform_keys(kept, lambda k, v: F.replace(k, F.lit("meta_"), F.lit(""))))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    kinds = ["text", "table", "picture", "formula"]
    return chunks.groupBy("doc_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in kinds])


def build_chunks(items: DataFrame, vlm: DataFrame, formulas: DataFrame, regions: DataFrame) -> DataFrame:
    """Chunks of whole documents: overlaps, numbering, headings, table and picture texts, regions and formulas, in reading order.

    What becomes of each box is found without its text and headings. It then comes to the items as a row, a mark, of the one shuffle
    by document in which they get their headings and numbers. The partitions of that shuffle grow in number with the boxes, and so not in size.
    """
    from foliant.operators import layout, tables

    at = ["doc_id", "page_no", "seq"]
    # every kind of chunk asks for the numbered boxes
    narrow = items.select(*at, "item_type", "label", "l", "t", "r", "b", (~tx.falsy(F.trim("text"))).alias("said"))
    boxes = stored(layout.number_boxes(narrow).drop("label"), "boxes")
    texts = boxes.where("item_type = 'text' and said")
    texts = texts.join(covering(texts, regions), ["doc_id", "page_no", "box_num"], "left").where("region is null or box_num = region.lo")
    texts = texts.select(*at, F.lit("text").alias("kind"), "box_num", "region", F.lit(None).cast("string").alias("chunk_text"))
    seen = tables.match_vision(boxes, vlm).select(*at, F.col("item_type").alias("kind"), "box_num", F.lit(None).cast(texts.schema["region"].dataType).alias("region"), "chunk_text")
    marks = texts.unionByName(seen).select(*at, F.struct("kind", "box_num", "region", "chunk_text").alias("mark"))
    placed = place_formulas(boxes, formulas)
    f = placed.select("doc_id", "page_no", F.col("seq").cast("int").alias("seq"), "t", "text", F.lit("formula").alias("chunk_type"))
    own = layout.eligible(items).select(*at, "t", "text", "label", "level", F.lit("box").alias("chunk_type"))
    fewest = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(fewest, -(-boxes.count() // TASK_BOXES))
    rows = layout.heading_stacks(own.unionByName(f, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True), tasks)
    rows = rows.withColumn("mark", F.max("mark").over(Window.partitionBy(*at))).where("chunk_type = 'formula' or (chunk_type = 'box' and mark is not null)")
    formula = F.col("chunk_type") == "formula"
    text = F.when(formula, F.col("text")).when(F.col("mark.kind") == "text", region_text("mark.region", "mark.box_num")).otherwise(F.col("mark.chunk_text"))
    chunks = rows.select("doc_id", "seq", "page_no", "t", F.when(formula, "formula").otherwise(F.col("mark.kind")).alias("chunk_type"), text.alias("text"), F.when(formula, F.array().cast("array<string>")).otherwise(F.col("headings")).alias("headings"))
    return renumber(chunks).drop("seq")
