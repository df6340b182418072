"""Chat formatting by quotation linking.

Lines that begin with '>' are quotations, one level for each mark; a line that only says who wrote
what follows is dropped with them. Quoted lines and paragraphs, normalised (lower case,
single spaces), are joined by hash with the lines and paragraphs of the conversation's
messages; the first message that has one is its origin. The origin of most passages of the
lowest level that has any is what a message replies to (ties: the latest). Roots and depths
come from pointer jumping, and messages are put in reply order: by the first message of
their thread, then by turn.

Defined cases: a null text counts as empty; a passage whose origin is not earlier than the message is
not linked, so replies never form a cycle; rows that repeat a conversation and turn each stay and
share links; rows without a conversation or turn stay unlinked; very long and hot conversations are
never gathered in one task; an empty table gives an empty result; other columns are kept, but for those
named like the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from foliant.llm import textbytes as tb
from foliant.llm.components import cut, drop, fresh, others, quoted

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_WROTE = re.compile(r"^\s*(?:(?:on|le|am|el)\b.*|[^\n>]{1,80}\s)(?:wrote|writes|said|a écrit|schrieb|escribió)(?: [^\n:]{0,40})?\s*:\s*$", re.I)
#: Shortest normalised passage that links, in characters.
MIN_PASSAGE = 8


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotations, and the normalised quoted passages (level, passage): each line, and each paragraph of several lines."""
    body: list[str] = []
    quoted: list[tuple[int, str]] = []
    lines = (text or "").split("\n")
    run: list[str] = []
    level = 0

    def close() -> None:
        if len(run) > 1:
            quoted.append((level, " ".join(run)))
        run.clear()

    for i, line in enumerate(lines):
        got = _MARKS.match(line)
        now = got[1].count(">") if got else 0
        if now != level:
            close()
            level = now
        if now:
            said = normalise(line[got.end() :])
            if said and not _WROTE.match(said):
                run.append(said)
                quoted.append((now, said))
            else:
                close()
        elif not (_WROTE.match(line) and i + 1 < len(lines) and any(_MARKS.match(x) for x in lines[i + 1 : i + 3])):
            body.append(line)
    close()
    out = "\n".join(body).strip("\n") if quoted else (text or "")
    return out, [(k, q) for k, q in quoted if len(q) >= MIN_PASSAGE]


def passages(body: str) -> set[str]:
    """Normalised lines and paragraphs of a message."""
    lines = {normalise(x) for x in body.split("\n")} | {normalise(x) for x in re.split(r"\n\s*\n", body)} | {normalise(body)}
    return {x for x in lines if len(x) >= MIN_PASSAGE}


def _hash(passage: str) -> int:
    raw = np.frombuffer(passage.encode(), np.uint8)
    return int(tb.span_hash(tb.prefix(raw), np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def quotation_links(messages: DataFrame) -> DataFrame:
    """`messages` (conv_id, turn, text) without quotations, with n_quotes, reply_to, root_turn and depth."""
    own = others(messages, "n_quotes", "reply_to", "root_turn", "depth")
    kept = messages.select(*map(quoted, own))
    c, t, made, count = fresh(messages.columns, "_c", "_t", "_made", "_count")

    @tb.tidied
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse(t) for t in b["text"]]
            quotes = [[{"level": k, "h": _hash(q)} for k, q in qs] for _, qs in parsed]
            yield pd.DataFrame({"conv_id": b["conv_id"], "turn": b["turn"], "quotes": quotes, "lines": [[_hash(x) for x in passages(t)] for t, _ in parsed]})

    def strip(texts: pd.Series) -> pd.DataFrame:
        parsed = [parse(t) for t in texts]
        return pd.DataFrame({"body": [t for t, _ in parsed], "n": [len(q) for _, q in parsed]})

    key = ["conv_id", "turn"]
    told = kept.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    # only conversations with a quotation need links
    quoting = told.where(F.col("text").rlike(r"(?m)^[ \t]*>")).select("conv_id").distinct()
    read_rows = cut(told.join(quoting, "conv_id", "left_semi").mapInPandas(read, "conv_id long, turn long, quotes array<struct<level:int,h:long>>, lines array<long>"))
    origin = read_rows.select("conv_id", "turn", F.explode("lines").alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    quote = read_rows.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.level", "q.h")
    votes = quote.join(origin, ["conv_id", "h"]).where("origin < turn").groupBy("conv_id", "turn", "level", "origin").agg(F.count("*").alias("n"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin")).alias("b")).select("conv_id", "turn", F.col("b.origin").alias("reply_to"))
    best = cut(best)
    # pointer jumping: up is an ancestor `depth` replies away
    jump = best.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth"))
    old = None
    while True:
        above = jump.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"), F.col("depth").alias("more"))
        step = jump.join(above, ["conv_id", "up"], "left")
        step = cut(step.select("conv_id", "turn", F.coalesce("top", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")))
        drop(old)
        old, jump = step, step.drop("moved")
        if step.where("moved").isEmpty():
            break
    drop(read_rows)
    links = best.join(jump.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth"), key).select(F.col("conv_id").alias(c), F.col("turn").alias(t), "reply_to", "root_turn", "depth")
    stripped = F.pandas_udf(strip, "body string, n int")
    has = F.coalesce(F.col("text").rlike(r"(?m)^[ \t]*>"), F.lit(False))
    # texts without a quotation do not pass through Python
    plain = kept.where(~has).withColumn(count, F.lit(0))
    cleaned = kept.where(has).withColumn(made, stripped("text")).withColumn("text", F.col(f"{made}.body")).withColumn(count, F.col(f"{made}.n")).drop(made)
    both = plain.unionByName(cleaned)
    out = both.join(links, (F.col("conv_id").cast("long") == F.col(c)) & (F.col("turn").cast("long") == F.col(t)), "left")
    first = F.coalesce("root_turn", F.col("turn").cast("long")).alias("root_turn")
    return out.select(*map(quoted, own), F.col(count).alias("n_quotes"), "reply_to", first, F.coalesce("depth", F.lit(0).cast("long")).alias("depth"))


def reply_order(linked: DataFrame) -> DataFrame:
    """Conversations in reply order, spread by ranges so that a hot conversation takes several tasks."""
    order = ["conv_id", "root_turn", "turn"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order)
