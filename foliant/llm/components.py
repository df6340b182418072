"""Shared steps of the operators on pairs: cuts of lineage, links within buckets, connected components.

All of it is DataFrame joins, pre-aggregated minima and windows over narrow rows: a hot key is combined before
it is shuffled or is a key of a join that adaptive execution splits, but for a bucket's rows, which one task sorts and spills.
"""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

#: Rows of two or three longs that may be broadcast (some 30 MB as a hash table); more are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Members of a zone of a bucket up to which those that the star left apart are paired with one another, at most 28 pairs a zone.
FEW = 8
#: Words of 64 bits by which two sets without a centre are told apart before they are a pair.
WORDS = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder under spark.checkpoint.dir; only a local session without it (a test) gets a folder of its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set; on a cluster it must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, *more: DataFrame) -> DataFrame:
    """`df` computed once and kept as Parquet in the shared folder, with no lineage before it.

    A table, unlike a checkpoint, does not carry what the optimizer inferred about the plan behind it, which in a loop
    of self-joins would double with every round. The rows of `more`, of the same columns, go into the same table, each when the shuffle files of those before are gone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for part in more:
        release(spark)
        part.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes cut tables that nothing will read again."""
    for t in tables:
        path = getattr(t, "_foliant_path", None)
        if path is not None:
            sc = t.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more, before the next large ones are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """`names` for helper columns, changed where they would clash with columns of the input."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        low.add(name.lower())
        out.append(name)
    return out


def others(df: DataFrame, *results: str) -> list[str]:
    """Names of the columns of `df` that are not named, in any case, like the results."""
    return [c for c in df.columns if c.lower() not in results]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A cut table of few narrow columns, marked for broadcast if its counted rows are within the bound."""
    made = cut(df)
    out = F.broadcast(made) if made.limit(rows + 1).count() <= rows else made
    out._foliant_path = made._foliant_path
    return out


def connected_components(edges: DataFrame, rounds: int = 80) -> DataFrame:
    """(id, component) of every end of `edges` (a, b); the component is the least id reachable.

    Each round every node points to the least node around it, pointers jump to their pointers' pointers, and
    edges are contracted to what their ends point to, until none is left. The first round goes by id, which resolves stars
    whose centre is their least node at once; later ones go by a hash, so that
    the nodes of long chains shrink by a constant share each round, in whatever order their ids are. Nothing but
    one row reaches the driver.
    """
    both = cut(edges.select("a", "b").where("a <> b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    root = None
    for turn in range(rounds):
        weigh = (lambda c: F.xxhash64(c, F.lit(turn))) if turn else (lambda c: F.lit(0).cast("long"))
        order = lambda c: F.struct(weigh(c).alias("w"), F.col(c).alias("v"))
        near = cut(both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["v"].alias("p")))
        points = cut(near.join(near.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p")))
        old = [both, near]
        if root is None:
            root = points.select(F.col("a").alias("id"), F.col("p").alias("root"))
            root._foliant_path = points._foliant_path
        else:
            old += [root]
            root = cut(root.join(points.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("p", "root").alias("root")))
        ends = both.join(points.withColumnRenamed("p", "pa"), "a").join(points.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        both = cut(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        drop(*old, *([points] if turn else []))
        if both.isEmpty():
            least = root.groupBy("root").agg(F.min("id").alias("component"))
            out = cut(root.join(least, "root").select("id", "component"))
            drop(root, both)
            return out
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grown(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) of the components `label` joined by more links (a, b)."""
    if label is None:
        return connected_components(links)
    of = lambda end: label.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = connected_components(ends)
    up = over.select(F.col("id").alias("component"), F.col("component").alias("top"))
    old = label.join(up, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    new = over.join(label, "id", "left_anti")
    out = cut(old.unionByName(new))
    drop(over)
    return out


def bucket_links(
    members: DataFrame, confirm: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame], percent: int, near: str = "true", portions: int = 1
) -> DataFrame | None:
    """(id, component) of the members (bucket, id, n) that have a link to another of their bucket; None if there are no links.

    First the least member of each bucket is paired with the others (where `near` holds of n and na), which `confirm`
    judges: (a, b, linked, lo, hi, na, nb) of each pair, with bounds of its Jaccard distance and the sizes of its sets. So copies are one star. Buckets whose members are then all in one component are done.

    Members are shuffled by bucket in so many `portions`, one after the other, so that this shuffle, the largest of all, takes that part of its disk at a time.

    Others fall into zones of distance from their least member, each twice as wide as a link is long and half over the next, and of size, so that
    (by the triangle inequality) the ends of a link share a zone, while what a bucket holds by chance is far from its families. Members of small zones are paired with one another,
    and large ones go to coded_links(), which loses no link of theirs and makes no pairs that their sets rule out.
    """
    spark = members.sparkSession
    # one shuffle of narrow rows by bucket gives its size and centre; a task holds no bucket, but passes over its sorted rows
    at = Window.partitionBy("bucket")
    sized = lambda rows: rows.select("bucket", "id", "n", F.count("*").over(at).alias("size"), F.min(F.struct("id", "n")).over(at).alias("c")).where("size > 1")
    shares = [members.where(F.pmod("bucket", F.lit(portions)) == k) if portions > 1 else members for k in range(portions)]
    left = cut(*[sized(x).select("bucket", "id", "n", F.col("c.id").alias("a"), F.col("c.n").alias("na")) for x in shares])
    drop(members)
    release(spark)
    pairs = cut(left.where("id <> a").where(near).select("a", F.col("id").alias("b")).distinct())
    if pairs.isEmpty():
        drop(left, pairs)
        return None
    judged = cut(confirm(pairs))
    drop(pairs)
    links = judged.where("linked").select("a", "b")
    label = None if links.isEmpty() else connected_components(links)
    now = left.select("bucket", "id", "n", "a")
    now = now.withColumn("component", F.col("id")) if label is None else now.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = [F.min("component").over(at).alias("x"), F.max("component").over(at).alias("y"), F.count("*").over(at).alias("size")]
    now = now.select("*", *several).where("x < y and size > 2").drop("x", "y", "size")
    sizes = judged.select(F.col("a").alias("id"), F.col("na").alias("size")).union(judged.select("b", "nb")).groupBy("id").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    now = now.join(sizes, "id", "left").withColumn("least", F.coalesce("least", "n")).withColumn("most", F.coalesce("most", "n"))
    seen = now.join(judged.select("a", F.col("b").alias("id"), "lo", "hi"), ["a", "id"], "left")
    itself, slack = F.col("id") == F.col("a"), 1e-9
    zones = lambda low, high, step: F.sequence((F.floor((low - slack) / step) - 1).cast("int"), F.floor((high + slack) / step).cast("int"))
    far = zones(F.when(itself, 0.0).otherwise(F.coalesce("lo", F.lit(0.0))), F.when(itself, 0.0).otherwise(F.coalesce("hi", F.lit(1.0))), (100 - percent) / 100)
    wide = zones(F.log(F.greatest("least", F.lit(1))), F.log(F.greatest("most", F.lit(1))), math.log(100 / percent))
    zoned = seen.select("bucket", "id", "n", "component", "a", F.explode(far).alias("far"), wide.alias("wide")).select("bucket", "id", "n", "component", "a", "far", F.explode("wide").alias("wide"))
    zoned = zoned.select(F.xxhash64("bucket", "far", "wide").alias("bucket"), "id", "n", "component", F.when(F.col("far") <= 1, F.col("a")).alias("centre"))
    now = cut(zoned.select("*", *several).where("x < y").drop("x", "y"))
    drop(left)
    release(spark)
    few, many = now.where(F.col("size") <= FEW), now.where(F.col("size") > FEW)
    others = few.select("bucket", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    second = few.join(others, "bucket").where("a < id and ca <> component").where(near).select("a", F.col("id").alias("b")).distinct()
    # a pair that failed in one bucket is not tried again in another
    second = cut(second.join(judged.select("a", "b"), ["a", "b"], "left_anti"))
    drop(judged)
    more = None if second.isEmpty() else cut(confirm(second).where("linked").select("a", "b"))
    if not many.isEmpty():
        release(spark)
        coded = coded_links(many.select("bucket", "id", "component", "centre"), sets, percent)
        more = coded if more is None else cut(more.unionByName(coded))
    drop(second, now)
    if more is not None and not more.isEmpty():
        label, old = grown(label, more), label
        drop(old)
    return label


def coded_links(members: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b), with 100 * intersection >= percent * union, between members (bucket, id, component, centre) of one bucket and different components.

    Each set is coded by its edits of its centre's set C: the l shingles of C that it lacks and the k others that it has. With s
    edits in common, two sets A and B share |C| - lA - lB + s shingles of |C| + kA + kB - s, so they are linked if
    (100 + percent) * s >= w(A) + w(B) - (100 - percent) * |C|, where w = 100 * l + percent * k.
    A set with w <= (100 - percent) * |C| is linked with C itself, as the caller knows; of any other link one end A has more, so that
    its ends must share edits: at least (w(A) - (100 - percent) * |C|) / 100 as B has them all, and more than w(B) / (100 + percent).
    Hence each set is looked up by so many of its rarest edits that it must share one of them, and pairs that meet
    are compared by all edits. Edits that one set or one component alone has, as most words that copies add, make no pairs.
    Members without a centre, far from any, are coded by the empty set: then edits are all their shingles. They are of many buckets
    and have much in common, so that parities of all their shared edits must leave room for a link before two of them are a pair; no link fails that.
    """
    rest, both = 100 - percent, 100 + percent
    nodes = cut(members.select(F.coalesce("centre", F.lit(-1 << 63)).alias("g"), "id", "component").distinct())
    ids = nodes.select("id").union(nodes.select("g").where(F.col("g") != F.lit(-1 << 63)))
    # one id may stand for several sets, which u tells apart
    own = cut(sets(ids.distinct()).withColumn("u", F.xxhash64("set")).dropDuplicates(["id", "u"]))
    known = nodes.join(own, "id")
    none = F.array().cast("array<bigint>")
    core = nodes.select("g").distinct().join(own.select(F.col("id").alias("g"), F.col("set").alias("core")), "g").dropDuplicates(["g"])
    # those without a centre have nothing to join, and would all be one key of it
    known = known.where(F.col("g") != F.lit(-1 << 63)).join(core, "g", "left").withColumn("core", F.coalesce("core", none)).unionByName(known.where(F.col("g") == F.lit(-1 << 63)).withColumn("core", none))
    coded = known.select("id", "u", "g", "component", F.size("core").alias("size"), F.array_except("core", "set").alias("lost"), F.array_except("set", "core").alias("more"))
    coded = coded.select("id", "u", "g", "component", "size", F.size("lost").alias("l"), F.size("more").alias("k"), F.concat("lost", "more").alias("edits"))
    coded = coded.withColumn("w", 100 * F.col("l").cast("long") + percent * F.col("k")).withColumn("out", F.col("w") > rest * F.col("size"))
    coded = cut(coded.withColumn("v", F.xxhash64("g", "id", "u")).drop("u"))
    drop(nodes, own)
    release(members.sparkSession)
    need = F.when(F.col("out"), F.ceil((F.col("w") - rest * F.col("size")) / 100)).otherwise(F.floor(F.col("w") / both) + 1)
    # rows of edits are many, so each set and each edit of a group goes by one hash, and what is the set's own joins again where few rows are left
    flat = coded.select("v", "component", "out", "g", "l", F.posexplode("edits").alias("p", "t")).select("v", "component", "out", F.xxhash64("g", "t").alias("t"), (F.col("p") < F.col("l")).cast("int").alias("lost"))
    # an edit that one component alone has can make no pair of two
    shared = flat.groupBy("t").agg(F.count("*").cast("int").alias("f"), F.max("out").alias("any"), F.min("component").alias("x"), F.max("component").alias("y"))
    common = bounded(shared.where("f > 1 and any and x < y").select("t", "f"))
    release(members.sparkSession)
    # of an order in which rare edits come first, and those that no one shares before all: how many shared ones are left from each on
    whole = Window.partitionBy("v")
    rest_of = whole.orderBy(F.desc("f"), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    word = lambda i: F.coalesce(F.bit_xor(F.when(F.pmod(F.shiftright("t", 6), F.lit(WORDS)) == i, F.expr("shiftleft(1L, cast(t & 63 as int))"))).over(whole), F.lit(0).cast("long")).alias(f"b{i}")
    met = flat.select("v", "t", "lost").join(common, "t").select("v", "t", F.count("*").over(rest_of).cast("int").alias("after"), F.sum("lost").over(rest_of).cast("int").alias("lost_after"), F.count("*").over(whole).cast("int").alias("n"), *map(word, range(WORDS)))
    alone = F.when(F.col("g") == F.lit(-1 << 63), True).alias("alone")
    met = met.join(coded.select("v", "component", "size", "w", "out", need.cast("int").alias("need"), alone), "v").where("after >= need")
    bits = F.when(F.col("alone"), F.array(*[f"b{i}" for i in range(WORDS)])).alias("bits")
    keys = cut(met.select("v", "component", "size", "w", "out", "t", "lost_after", (F.col("after") - F.col("lost_after")).alias("more_after"), "n", bits))
    drop(common)
    release(members.sparkSession)
    x, y = keys.where("out").alias("x"), keys.alias("y")
    least = F.col("x.w") + F.col("y.w") - rest * F.col("x.size")
    # two sets meet at the first edit that they share, where what is left must be enough
    enough: Column = both * (F.least("x.lost_after", "y.lost_after") + F.least("x.more_after", "y.more_after")) >= least
    # each bit is the parity of the edits that fall on it, so that bits that differ are at most the edits that one of the two has alone
    apart = sum((F.bit_count(F.col("x.bits")[i].bitwiseXOR(F.col("y.bits")[i])) for i in range(1, WORDS)), F.bit_count(F.col("x.bits")[0].bitwiseXOR(F.col("y.bits")[0])))
    near = F.coalesce(both * (F.col("x.n") + F.col("y.n") - apart) >= 2 * least, F.lit(True))
    meet = (F.col("x.t") == F.col("y.t")) & (F.col("x.component") != F.col("y.component")) & (~F.col("y.out") | F.expr("x.v < y.v")) & enough & near
    pairs = x.join(y, meet).select(F.col("x.v").alias("va"), F.col("y.v").alias("vb")).distinct()
    # sets meet within a centre's group, and only those of one bucket are compared
    at = coded.select("v", "id").join(members.groupBy("id").agg(F.collect_set("bucket").alias("at")), "id")
    pairs = cut(pairs.join(at.select(F.col("v").alias("va"), F.col("at").alias("x")), "va").join(at.select(F.col("v").alias("vb"), F.col("at").alias("y")), "vb").where(F.arrays_overlap("x", "y")).select("va", "vb"))
    drop(keys)
    release(members.sparkSession)
    # edits of pairs alone move
    met = coded.join(bounded(pairs.select(F.explode(F.array("va", "vb")).alias("v")).distinct()), "v", "left_semi")
    side = lambda k: met.select(F.col("v").alias(f"v{k}"), F.col("id").alias(k), F.col("edits").alias(f"e{k}"), F.col("w").alias(f"w{k}"), F.col("size").alias(f"s{k}"))
    held = pairs.join(side("a"), "va").join(side("b"), "vb").where(both * F.size(F.array_intersect("ea", "eb")) >= F.col("wa") + F.col("wb") - rest * F.col("sa"))
    out = cut(held.select("a", "b").distinct())
    drop(coded, pairs)
    return out
