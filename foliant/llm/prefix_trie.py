"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. It is told by 128 bits: the exclusive-or of a hash of each turn and
its place, so that prefixes are running values, the same sequence has the same bits everywhere, and the whole of a
conversation is a plain aggregate. Equal conversations are one weighted sequence from there on.

Nodes are ranked in preorder. Sequences are sorted by the path of their choices, the children of branching nodes that
they pass, then by length: whatever runs between two choices has no branch, so this is an order of the trie in
which each sequence comes before those that it begins, and all members of a node stand together.
A node first met with the sequence of rank `first` and last with `last` stands in preorder by (first, depth), and its
subtree ends at the last node that the sequence of rank `last` brings in, which is that sequence's own end. Positions,
leaves and savings are running sums over that order, so those of a subtree are differences of two of them.

Running values are taken over range partitions: each is scanned once and gets what the partitions before it
hold of its first group, a table of at most two rows a partition. So a conversation of any length is spread over tasks. A path
has at most about the square root of twice the number of turns as choices (each needs another conversation as deep),
and all paths together at most one for each turn. SHA-256 has no parts: the ids that end in a hot node go through one task in
order, already joined by blocks of ids, in constant memory.

Defined cases: turns go by turn (null first), then role and text; null role or text is empty; rows without a conv_id are left
out; rows that repeat are turns like others; a conversation without turns is a member of the root; an empty table has
no nodes, not even a root; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from foliant.llm import textbytes as tb
from foliant.llm.components import bounded, cut, drop

#: Ids that are joined at a time: those of one block of so many consecutive numbers.
BLOCK = 4096


def running(rows: DataFrame, group: str | None, order: list[str], keep: list[str], sums: Iterable[str] = (), xors: Iterable[str] = ()) -> DataFrame:
    """The columns `keep` of `rows`, those named in `sums` and `xors` (all long) as running values in `order` within each `group` (a long), or over all rows.

    The result is a cut table. Rows are range-partitioned by group and order, so a hot group is spread.
    """
    sums, xors = list(sums), list(xors)
    values = sums + xors
    by = [*([group] if group else []), *order]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*keep)
    schema = StructType([*[StructField(f.name, f.dataType) for f in ordered.schema], StructField("pid", IntegerType()), StructField("edge", BooleanType())])

    @tb.tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        key, held, runs = None, dict.fromkeys(values, np.int64(0)), 0

        def edge(like: pa.RecordBatch) -> pa.RecordBatch:
            """The totals of a run that ends, in a row of their own."""
            cells = {group: key} | held
            columns = [pa.array([cells[f.name].item()], f.type) if f.name in cells else pa.nulls(1, f.type) for f in like.schema]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pid], pa.int32()), pa.array([True])], [*like.schema.names, "pid", "edge"])

        b = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(group).to_numpy() if group else np.zeros(n, np.int64)
            starts = np.flatnonzero(np.concatenate(([key is None or g[0] != key], g[1:] != g[:-1])))
            run = np.searchsorted(starts, np.arange(n), "right")
            columns, made = dict(zip(b.schema.names, b.columns, strict=True)), {}
            for c in values:
                v = columns[c].to_numpy()
                if c in sums:
                    total = np.cumsum(v)
                    made[c] = total - np.concatenate(([-held[c]], total[starts] - v[starts]))[run]
                else:
                    total = np.bitwise_xor.accumulate(v)
                    made[c] = total ^ np.concatenate(([held[c]], total[starts] ^ v[starts]))[run]
            for s in starts[: max(0, 2 - runs)].tolist():
                if runs == 1:
                    # the partition's first run ends before this place
                    if s:
                        key, held = g[s - 1], {c: made[c][s - 1] for c in values}
                    yield edge(b)
                runs += 1
            columns |= {c: pa.array(v) for c, v in made.items()}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(np.full(n, pid, np.int32)), pa.array(np.zeros(n, bool))], [*columns, "pid", "edge"])
            key, held = g[-1], {c: made[c][-1] for c in values}
        if key is not None:
            yield edge(b)

    found = cut(ordered.mapInArrow(scan, schema))
    on = ["pid", *([group] if group else [])]
    before = Window.partitionBy(*on[1:]).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(c).over(before).alias(f"{c}_before") for c in sums] + [F.bit_xor(c).over(before).alias(f"{c}_before") for c in xors]
    carry = bounded(found.where("edge").select(*on, *carried))
    joined = found.where("not edge").join(carry, on, "left")
    whole = {c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in sums} | {c: F.col(c).bitwiseXOR(F.coalesce(f"{c}_before", F.lit(0))) for c in xors}
    out = cut(joined.select(*[whole[c].alias(c) if c in whole else F.col(c) for c in keep]))
    drop(found, carry)
    return out


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, n_bytes) of every turn: its place from 1, 128 bits of role and text, and the UTF-8 length of its text; a cut table."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # rows that are equal in all may stand in any order; the last key lets them be spread
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).withColumn("place", F.lit(1).cast("long")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "role", "text"))
    return running(rows, "conv_id", ["turn", "role", "text", "tie"], ["conv_id", "place", "h1", "h2", "n_bytes"], sums=["place"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, whose blocks follow one another."""
    key, state = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["p1", "p2", "ends_sha256"])
    for b in batches:
        for x, y, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (x, y) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                yield row()
            key, state = (x, y), hashlib.sha256(ids.encode())
    if key is not None:
        yield row()


def _ends(sequences: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of each node at which conversations end."""
    blocks = cut(sequences.groupBy("p1", "p2", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")))
    count = cut(blocks.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("ids").alias("ids")))
    several = bounded(count.where("n > 1").select("p1", "p2"))
    parts = blocks.join(several, ["p1", "p2"], "left_semi").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "block").select("p1", "p2", "ids")
    return count.where("n = 1").select("p1", "p2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256")).unionByName(parts.mapInArrow(_digest, "p1 long, p2 long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of `turns` (conv_id, depth from 1, h1, h2, n_bytes) of all `conversations` (conv_id).

    conv_id is the smallest member of a node, so its last turn is turn `depth` of that conversation; position and
    end_position are its subtree's interval in preorder, both included.
    """
    bits = lambda k: F.xxhash64(F.lit(k), "h1", "h2", "depth").alias(f"x{k}")
    placed = cut(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), bits(1), bits(2), "n_bytes"))
    whole = placed.groupBy("conv_id").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"), F.count("*").alias("length"))
    none = F.lit(0).cast("long")
    sequences = cut(conversations.select("conv_id").where("conv_id is not null").distinct().join(whole, "conv_id", "left").na.fill(0, ["p1", "p2", "length"]))
    kept = cut(sequences.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.min("length").alias("length")))
    rows = placed.join(kept.select("conv_id", "weight"), "conv_id").select("*", F.col("x1").alias("p1"), F.col("x2").alias("p2"))
    at = running(rows, "conv_id", ["depth"], ["conv_id", "depth", "x1", "x2", "n_bytes", "weight", "p1", "p2"], xors=["p1", "p2"])
    drop(placed)
    at = at.select("conv_id", "depth", "n_bytes", "weight", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"))
    children = cut(at.select("p1", "p2", "q1", "q2").distinct().groupBy("q1", "q2").agg(F.count("*").alias("n_children")))

    branching = bounded(children.where("n_children > 1").select("q1", "q2"))
    deeper = at.where("depth > 1").join(branching, ["q1", "q2"], "left_semi").select("conv_id", "depth", "p1", "p2")
    choices = at.where("depth = 1").select("conv_id", "depth", "p1", "p2").unionByName(deeper)
    paths = choices.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "p1", "p2"))), lambda x: F.struct(x["p1"], x["p2"])).alias("path"))
    to_sort = cut(kept.join(paths, "conv_id", "left").withColumn("rank", F.lit(1).cast("long")))
    # without turns there is no path, and null comes first
    ranks = running(to_sort, None, ["path", "length"], ["conv_id", "p1", "p2", "weight", "rank"], sums=["rank"])
    drop(branching, to_sort)

    met = [F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last")]
    nodes = at.join(ranks.select("conv_id", "rank"), "conv_id").groupBy("p1", "p2").agg(*met, F.min("depth").alias("depth"), F.min("n_bytes").alias("n_bytes"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    root = ranks.agg(*met).where("conv_id is not null").select(none.alias("p1"), none.alias("p2"), "*", none.alias("depth"), none.alias("n_bytes"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = nodes.unionByName(root).join(children.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "n_children"), ["p1", "p2"], "left").na.fill(0, ["n_children"])
    nodes = cut(nodes.withColumn("own_leaf", (F.col("n_children") == 0).cast("long")).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("n_bytes")))
    summed = nodes.select("*", F.lit(1).cast("long").alias("position"), F.col("own_leaf").alias("n_leaves"), F.col("own_saved").alias("saved_tokens"))
    keep = ["p1", "p2", "q1", "q2", "conv_id", "depth", "n_convs", "n_children", "last", "own_leaf", "own_saved", "position", "n_leaves", "saved_tokens"]
    order = running(summed, None, ["first", "depth"], keep, sums=["position", "n_leaves", "saved_tokens"])
    drop(nodes, children)

    end = order.join(ranks.select("p1", "p2", "rank"), ["p1", "p2"]).select(F.col("rank").alias("last"), F.col("position").alias("end_position"), F.col("n_leaves").alias("l"), F.col("saved_tokens").alias("s"))
    below = order.join(end, "last").withColumn("n_leaves", F.col("l") - F.col("n_leaves") + F.col("own_leaf")).withColumn("saved_tokens", F.col("s") - F.col("saved_tokens") + F.col("own_saved"))
    parent = order.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    out = below.join(parent, ["q1", "q2"], "left").join(_ends(sequences), ["p1", "p2"], "left")
    ends = F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends, "position", "end_position")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = number_turns(conversations)
    return prefix_trie(turns.withColumnRenamed("place", "depth"), turns.select("conv_id"))
