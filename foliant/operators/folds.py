"""Ordered folds: a state that each row of a group changes in order, where windows cannot say what it becomes.

Rows are shuffled by group and sorted within partitions, and one pass over a partition's batches carries the state from row to row. So a task holds
one batch and one state, whatever the size of a group, and groups cost nothing but their rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type


def ordered_fold(rows: DataFrame, by: list[str], order: str, values: list[str], begin: Callable[[], Callable[..., Any]], result: str, kind: T.DataType) -> DataFrame:
    """(by, order, result) of every row: what the function that `begin` makes for each group returns for the row's `values`, in order."""
    taken = rows.select(*by, order, *values).repartition(*by).sortWithinPartitions(*by, order)
    keys = [*by, order]
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, step = None, None
        for b in batches:
            owners = zip(*(b.column(c).to_pylist() for c in by), strict=True)
            given = zip(*(b.column(c).to_pylist() for c in values), strict=True)
            out = []
            for owner, row in zip(owners, given, strict=True):
                if step is None or owner != group:
                    group, step = owner, begin()
                out.append(step(*row))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(out, arrow)], [*keys, result])

    fields = [T.StructField(f.name, f.dataType) for f in taken.select(*keys).schema]
    return taken.mapInArrow(run, T.StructType([*fields, T.StructField(result, kind)]))
