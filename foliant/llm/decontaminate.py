"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, names (capitalised words) and units after numbers become typed placeholders; what
is left are lower-cased words. Windows of WINDOW tokens of the benchmark's templates are joined
by hash with those of the texts. A text and an item that share windows are aligned by the
difference of their places; along an alignment each value of a slot in the item must
always meet one value in the text, so a question with other names and numbers counts as the same, while
chance template matches do not. A text is contaminated by an item when its
consistent windows are PERCENT of the item's, or when it holds all words and numbers of
the item in a row, in whatever case they and the marks between them are.

Defined cases: a null or empty text or item has no windows; template windows with fewer than
LITERALS words that are no placeholders are not searched, so an item that has no others, as an item of
fewer than WINDOW tokens, is found by its words and numbers in a row alone; an item without any matches nothing; equal texts share one verdict, with or without an id; equal items are
all reported; rows of the benchmark without an id are left out; an empty table gives an empty result, and an empty benchmark no
matches; other columns are kept, but for those named like the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.components import bounded, cut, fresh, others, quoted

WINDOW, LITERALS, PERCENT = 5, 2, 80
NUMBER, NAME, UNIT = "", "", ""
#: Units that count as such right after a number.
UNITS = "km|cm|mm|m|mi|ft|kg|mg|g|lb|lbs|oz|l|ml|s|ms|min|h|hz|kb|mb|gb|usd|eur|dollars?|euros?|cents?|percent|degrees?|seconds?|minutes?|hours?|days?|weeks?|months?|years?|met(?:er|re)s?|miles?|feet|inch(?:es)?|grams?|kilograms?|pounds?|lit(?:er|re)s?"
_LETTER = r"[\p{L}\p{M}]"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"


def canonical(text: Column) -> Column:
    """Template tokens of a text, one for each of tokens()."""
    out = F.translate(text, NUMBER + NAME + UNIT, "   ")
    out = F.regexp_replace(out, rf"\p{{Lu}}(?<!{_LETTER}\p{{Lu}}){_LETTER}*", f" {NAME} ")
    out = F.when(out.rlike(r"\p{N}"), F.regexp_replace(F.regexp_replace(out, _NUMBER, f" {NUMBER} "), f"{NUMBER} \\s*(?i:{UNITS})(?!{_LETTER})", f"{NUMBER} {UNIT} ")).otherwise(out)
    return F.regexp_extract_all(F.lower(out), F.lit(rf"[\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """The words and numbers that the template tokens stand for, lower-cased."""
    plain = F.lower(F.translate(text, NUMBER + NAME + UNIT, "   "))
    return F.regexp_extract_all(plain, F.lit(rf"{_NUMBER}|{_LETTER}+"), F.lit(0))


def _hash(words: Column, at: Column, width: int) -> Column:
    """Hash of `width` words from a place on; it is that of their slice, without making one."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(width)])


def windows(template: Column) -> Column:
    """Hashes of the windows, by place from 0; `template` is evaluated once, outside the lambda that uses it."""

    def of(t: Column) -> Column:
        n = F.size(t) - WINDOW
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: _hash(t, i, WINDOW))).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(template), of)[0]


def _literal(window: Column) -> Column:
    return F.size(F.filter(window, lambda x: ~x.isin(NUMBER, NAME, UNIT))) >= LITERALS


def _item_windows(items: DataFrame) -> DataFrame:
    """(item_id, item_text, ipos, h) of the windows that are searched."""
    out = items.select("item_id", "k1", F.posexplode(windows(F.col("template"))).alias("ipos", "h"), "template")
    return out.where(_literal(F.slice("template", F.col("ipos") + 1, F.lit(WINDOW)))).drop("template")


def _placed(words: Column, width: int) -> Column:
    """Place, width and hash of the windows of one width."""
    of = lambda i: F.struct(i.alias("dpos"), F.lit(width).alias("width"), _hash(words, i, width).alias("h"))
    n = F.size(words) - width
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), of)).otherwise(F.array().cast("array<struct<dpos:int,width:int,h:bigint>>"))


def verbatim(items: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(k1, k2, item_id): the texts that hold all words and numbers of an item in a row; None if no item has any.

    Texts meet an item in the one of its windows that fewest items have, WINDOW words or all of a shorter item, and are then compared whole.
    """
    full = items.where(F.size("words") > 0).select("item_id", F.col("k1").alias("ik"), "words", F.least(F.size("words"), F.lit(WINDOW)).alias("width"))
    widths = sorted(r.width for r in full.select("width").distinct().collect())
    if not widths:
        return None
    of = lambda words: F.transform(F.array(words), lambda w: F.concat(*[_placed(w, k) for k in widths]))[0]
    own = full.select("item_id", "ik", F.col("width").alias("own"), F.inline(of(F.col("words")))).where("width = own")
    places = cut(own.select("item_id", "ik", "width", "h", F.col("dpos").alias("ipos")))
    rare = places.join(places.groupBy("h").agg(F.count("*").alias("c")), "h").groupBy("item_id", "ik", "width").agg(F.min(F.struct("c", "h", "ipos")).alias("x"))
    anchors = bounded(rare.select("item_id", "ik", "width", F.col("x.h").alias("h"), F.col("x.ipos").alias("ipos")))
    met = texts.select("k1", "k2", F.inline(of(tokens(F.col("text"))))).join(anchors, ["h", "width"]).select("k1", "k2", "item_id", "ik", (F.col("dpos") - F.col("ipos")).alias("start"))
    met = cut(met.where("start >= 0").distinct())
    keys = bounded(met.select("k1", "k2").distinct())
    values = texts.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text")).select("k1", "k2", tokens(F.col("text")).alias("dwords"))
    both = met.join(cut(values), ["k1", "k2"]).join(full, ["item_id", "ik"])
    return both.where(F.slice("dwords", F.col("start") + 1, F.size("words")) == F.col("words")).select("k1", "k2", "item_id").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k1, k2, item_id): the texts, by two hashes, that hold an item."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = cut(items.select("item_id", F.xxhash64("text").alias("k1"), canonical(F.col("text")).alias("template"), tokens(F.col("text")).alias("words")))
    searched = cut(_item_windows(items))
    size = searched.groupBy("item_id", "k1").agg(F.count("*").alias("size"))
    hashes = bounded(searched.select("h").distinct())
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"), "text")
    found = texts.select("k1", "k2", F.posexplode(windows(canonical(F.col("text")))).alias("dpos", "h")).join(hashes, "h", "left_semi").distinct()
    met = found.join(bounded(searched.select("item_id", F.col("k1").alias("ik"), "ipos", "h")), "h").select("k1", "k2", "item_id", "ik", "ipos", (F.col("dpos") - F.col("ipos")).alias("shift"))
    met = cut(met)
    by = ["k1", "k2", "item_id", "ik"]
    sized = bounded(size.withColumnRenamed("k1", "ik"))
    enough = lambda x: x.groupBy(*by).agg(F.count_distinct("ipos").alias("hits")).join(sized, ["item_id", "ik"]).where(f"100 * hits >= {PERCENT} * size").select(*by)
    likely = cut(enough(met))
    keys = bounded(likely.select("k1", "k2").distinct())
    values = cut(texts.join(keys, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text")).select("k1", "k2", tokens(F.col("text")).alias("dwords")))
    # slots that the matched windows of an alignment cover, with the value on either side
    aligned = met.join(likely, by, "left_semi")
    covered = aligned.select(*by, "shift", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + WINDOW - 1)).alias("place")).distinct()
    slots = items.select("item_id", F.col("k1").alias("ik"), F.posexplode(F.arrays_zip("template", "words")).alias("place", "x")).where(F.col("x.template").isin(NUMBER, NAME, UNIT))
    slots = slots.select("item_id", "ik", "place", F.col("x.template").alias("kind"), F.col("x.words").alias("mine"))
    pairs = covered.join(slots, ["item_id", "ik", "place"]).join(values, ["k1", "k2"]).select(*by, "shift", "kind", "mine", F.get("dwords", F.col("place") + F.col("shift")).alias("theirs"))
    wrong = pairs.groupBy(*by, "shift", "kind", "mine").agg(F.min("theirs").alias("lo"), F.max("theirs").alias("hi")).where("lo <> hi").select(*by, "shift").distinct()
    found = enough(aligned.join(wrong, [*by, "shift"], "left_anti")).select("k1", "k2", "item_id")
    same = verbatim(items, texts)
    return (found if same is None else found.unionAll(same)).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` with `contaminated` and the sorted ids of the items found, `leaked_items`."""
    own = others(docs, "contaminated", "leaked_items")
    k1, k2, items = fresh(docs.columns, "_k1", "_k2", "_items")
    found = cut(leaks(docs, benchmark))
    per = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.sort_array(F.collect_set("item_id")).alias(items))
    few = found.limit(100_001).count() <= 100_000
    side = F.broadcast(per) if few else per
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*map(quoted, own)).join(side, (F.xxhash64(text) == F.col(k1)) & (F.xxhash64(F.lit(1), text) == F.col(k2)), "left")
    return out.select(*map(quoted, own), F.col(items).isNotNull().alias("contaminated"), F.coalesce(items, F.array().cast("array<bigint>")).alias("leaked_items"))
