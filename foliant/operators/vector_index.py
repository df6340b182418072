"""Approximate dense search by an inverted file: points lie in the cell of their nearest centroid, and a query looks into a few cells.

Centroids are fitted on the driver on a sample of at most SAMPLE points, those whose ids have the least hashes; every point is
then put into a cell, however far it is. Cells of points and of queries are both cut into blocks of bounded size, and a pair of blocks of one
cell is one group: a matrix product that keeps its best rows. So no group grows with a hot cell, and both sides may have any number of rows.
The scores of what is found are exact; only points of cells that are not probed are missed. With as many probes as there are cells the search is exact.

Defined cases: points and queries without a vector are left out; rows that repeat an id are points of their own; an index without points, or fewer
points than cells, has fewer cells; ties go to the lesser point id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.operators.retrieval import _ranked, dense_topk
from foliant.sources import writers

#: Most points that centroids are fitted on.
SAMPLE = 50_000
#: Most rows of one block of points and of one block of queries.
POINT_BLOCK, QUERY_BLOCK = 20_000, 512
ROUNDS = 12
#: Queries that the number of probes is chosen on, and the share of their exact results that must be found.
SAMPLE_QUERIES, TARGET = 200, 0.93


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m**2).sum(1, keepdims=True)), 1e-300)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def fit_centroids(points: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """(cell, centroid): spherical k-means over the sample, the same for the same points; an empty cell takes the point farthest from its own."""
    order = F.xxhash64("point_id")
    got = points.where(F.size("dense") > 0).select("point_id", "dense").orderBy(order, "point_id").limit(sample).select("dense").toPandas()
    spark = points.sparkSession
    schema = "cell int, centroid array<double>"
    if not len(got):
        return spark.createDataFrame([], schema)
    m = _unit(_matrix(got["dense"]))
    # the sample is in hash order, so its first rows are a draw
    centres = m[: min(cells, len(m))].copy()
    for _ in range(rounds):
        scores = m @ centres.T
        own = scores.argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, m)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        total[empty] = m[np.argsort(scores.max(1), kind="stable")[: len(empty)]]
        centres = _unit(total)
    return spark.createDataFrame(pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centroid": pa.array(centres.tolist(), pa.list_(pa.float64()))}))


def _nearest(rows: DataFrame, vector: str, centroids: DataFrame, probes: int, name: str) -> DataFrame:
    """`rows` with an array of their `probes` nearest cells. The centroids, whose number the fit bounds, are broadcast."""
    table = centroids.orderBy("cell").toPandas()
    kept = rows.sparkSession.sparkContext.broadcast((table["cell"].to_numpy(np.int32), _matrix(table["centroid"]) if len(table) else np.zeros((0, 1))))

    @F.pandas_udf("array<int>")
    def cells(v: pd.Series) -> pd.Series:
        ids, centres = kept.value
        m = _matrix(v)
        if not len(ids):
            return pd.Series([[] for _ in range(len(m))])
        n = min(probes, len(ids))
        order = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :n]
        return pd.Series(list(ids[order]))

    return rows.where(F.size(vector) > 0).withColumn(name, cells(vector))


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """`points` with the cell that each lies in."""
    return _nearest(points, "dense", centroids, 1, "cell").withColumn("cell", F.get("cell", 0))


def write_index(points: DataFrame, path: str, cells: int, sample: int = SAMPLE) -> None:
    """A stored index of points (point_id, doc_id, dense): centroids, and the points in folders by cell and bucket of their document."""
    centroids = fit_centroids(points, cells, sample)
    centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    _placed(points, points.sparkSession.read.parquet(f"{path}/centroids")).write.mode("overwrite").partitionBy("cell", "bucket").parquet(f"{path}/points")


def _placed(points: DataFrame, centroids: DataFrame) -> DataFrame:
    return assign(points, centroids).select("point_id", "doc_id", "dense", "cell", writers.bucket_of(F.col("doc_id"), 8).alias("bucket")).hint("rebalance", "cell", "bucket")


def add_points(spark: SparkSession, points: DataFrame, path: str) -> None:
    """More points for the cells that there are; add each only once."""
    _placed(points, spark.read.parquet(f"{path}/centroids")).write.mode("append").partitionBy("cell", "bucket").parquet(f"{path}/points")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points with their cell, centroids); a search reads the folders of probed cells alone."""
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/centroids")


def search(placed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, point_id, score, rank): the k most similar points among those of each query's `probes` nearest cells."""
    kinds = {**dict(placed.dtypes), **dict(queries.dtypes)}
    asked = _nearest(queries.select("query_id", "qvec", "document_ids"), "qvec", centroids, probes, "cells")
    asked = asked.select("query_id", F.col("qvec").cast("array<double>").alias("qvec"), "document_ids", F.explode("cells").alias("cell"))
    wanted = [r[0] for r in asked.select("cell").distinct().collect()]  # at most the number of cells
    points = placed.where(F.col("cell").isin(wanted) & (F.size("dense") > 0)).select("cell", "point_id", "doc_id", "dense")
    of_points = points.groupBy("cell").agg(F.ceil(F.count("*") / POINT_BLOCK).cast("int").alias("p"))
    of_queries = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("q"))
    blocks = F.broadcast(of_points.join(of_queries, "cell"))  # a row a cell
    spread = lambda rows, own, other, key: rows.join(blocks, "cell").withColumn(own, F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left, right = spread(points, "p", "q", "point_id"), spread(asked, "q", "p", "query_id")

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": b["query_id"][:0], "point_id": a["point_id"][:0], "score": np.zeros(0)})
        s = np.round(_unit(_matrix(b["qvec"])) @ _unit(_matrix(a["dense"])).T, 6) + 0.0
        scopes = [None if x is None or not len(x) else set(x) for x in b["document_ids"]]
        if any(scopes):
            docs = a["doc_id"].to_numpy()
            for i, scope in enumerate(scopes):
                if scope is not None:
                    s[i, ~np.isin(docs, list(scope))] = -np.inf
        if len(a) > k:  # ties with the k-th value stay until the exact order decides
            take = s >= np.partition(s, len(a) - k, axis=1)[:, len(a) - k][:, None]
        else:
            take = np.ones_like(s, bool)
        i, at = np.nonzero(take & (s > -np.inf))
        return pd.DataFrame({"query_id": b["query_id"].to_numpy()[i], "point_id": a["point_id"].to_numpy()[at], "score": s[i, at]})

    keys = ["cell", "p", "q"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, score double")
    return _ranked(found, k)


def probes_for(placed: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, target: float = TARGET, sample: int = SAMPLE_QUERIES) -> int:
    """The least number of probes whose cells hold `target` of the exact results of at most `sample` queries, those of the least hashes.

    Vectors in groups need a few; vectors without any structure need about half of the cells, and then an index is of little use.
    """
    some = queries.where(F.size("qvec") > 0).orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    cells = centroids.count()
    order = _nearest(some, "qvec", centroids, max(1, cells), "cells").select("query_id", "cells")
    hits = dense_topk(placed, some, k).select("query_id", "point_id").join(placed.select("point_id", "cell"), "point_id")
    at = hits.join(order, "query_id").groupBy(F.array_position("cells", F.col("cell")).alias("at")).agg(F.count("*").alias("n"))
    counts = {r["at"]: r["n"] for r in at.collect()}  # at most a row a cell
    reached, whole = 0, sum(counts.values())
    for probes in sorted(counts):
        reached += counts[probes]
        if reached >= target * whole:
            return int(probes)
    return max(1, cells)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, wanted, hit): how many of the exact results were found, a result of the same score as the last exact one counting too."""
    last = exact.groupBy("query_id").agg(F.min("score").alias("last"), F.count("*").alias("wanted"))
    good = found.join(last, "query_id").where(F.col("score") >= F.col("last")).groupBy("query_id").agg(F.count("*").alias("hit"))
    return last.join(good, "query_id", "left").select("query_id", "wanted", F.least("wanted", F.coalesce("hit", F.lit(0))).alias("hit"))
