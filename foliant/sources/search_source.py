"""A remote paged search as a Spark data source: ranges of pages are partitions, and as a stream the pages read so far are its offset.

A service is an object with `pages()`, how many pages it has now, and `fetch(page)`, the hits of one as tuples, from page 0. Pages are cut into tasks of a few pages
each. A page that fails after `attempts` calls is a row of its own with its error and no hit, so a result is never incomplete in silence: `hits` takes the rows of hits,
each id once, and `failed` the pages to ask for again. A stream that starts again goes on at the page that its checkpoint holds, and a page
that grows after it was read is not read again, as a service that appends whole pages gives them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: What a row has beside the hit's own columns.
OWN = "_page int, _error string"


class Service(Protocol):
    def pages(self) -> int: ...
    def fetch(self, page: int) -> list[tuple]: ...


@dataclass
class Range(InputPartition):
    first: int
    end: int


def ranges(first: int, end: int, size: int) -> list[Range]:
    return [Range(at, min(end, at + size)) for at in range(first, end, size)]


def _rows(service: Service, part: Range, width: int, attempts: int) -> Iterator[tuple]:
    for page in range(part.first, part.end):
        for attempt in range(attempts):
            try:
                hits = service.fetch(page)
            except Exception as e:  # whatever a client raises becomes a row
                if attempt == attempts - 1:
                    yield (*[None] * width, page, f"{type(e).__name__}: {e}")
            else:
                yield from ((*hit, page, None) for hit in hits)
                break


def register(spark: SparkSession, name: str, service: Service, schema: str, pages_a_task: int = 4, attempts: int = 2) -> None:
    """Makes the service readable as spark.read.format(name) and spark.readStream.format(name); it is sent to the tasks."""
    width = len(StructType.fromDDL(schema))

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return ranges(0, service.pages(), pages_a_task)

        def read(self, partition: Range) -> Iterator[tuple]:
            return _rows(service, partition, width, attempts)

    class StreamReader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"page": 0}

        def latestOffset(self) -> dict:
            return {"page": service.pages()}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return ranges(start["page"], end["page"], pages_a_task)

        def read(self, partition: Range) -> Iterator[tuple]:
            return _rows(service, partition, width, attempts)

    class Search(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, {OWN}"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader()

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return StreamReader()

    spark.dataSource.register(Search)


def hits(rows: DataFrame, key: str) -> DataFrame:
    """The hits, each `key` once; of a stream too, which then remembers the keys."""
    return rows.where(F.col("_error").isNull()).drop("_page", "_error").dropDuplicates([key])


def failed(rows: DataFrame) -> DataFrame:
    """(page, error) of the pages that gave none."""
    return rows.where(F.col("_error").isNotNull()).select(F.col("_page").alias("page"), F.col("_error").alias("error"))
