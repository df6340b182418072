"""Growing log files as a stream: the byte that each file was read to is the stream's offset, so a file is never read again from its start.

    foliant.streaming.log_source.register(spark)
    spark.readStream.format("foliant_log").option("path", "/logs/*.log").load()

Rows are (path, at, value): the file, the byte at which the line begins, and the line without its end. A last line without an end waits. A file that
is shorter than what was read of it, or another file of the same name, was rotated and is read from its start. New bytes are cut into
tasks of some megabytes at line ends. The pattern is of folders that the driver and all executors can open, such as a mounted share.

Defined cases: bytes that are not UTF-8 become replacement characters; files that vanish are left out, and forgotten once they are; an empty line is a row.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of one task, and of one step of the search for the last line end.
TASK_BYTES, STEP = 8 << 20, 1 << 16


@dataclass
class Piece(InputPartition):
    path: str
    first: int
    end: int


def last_line_end(path: str, size: int, first: int = 0) -> int:
    """The byte after the last line end in [first, size), or `first`."""
    with open(path, "rb") as f:
        at = size
        while at > first:
            begin = max(first, at - STEP)
            f.seek(begin)
            k = f.read(at - begin).rfind(b"\n")
            if k >= 0:
                return begin + k + 1
            at = begin
    return first


def next_line_end(path: str, first: int, end: int) -> int:
    """The byte after the first line end in [first, end), or `end`."""
    with open(path, "rb") as f:
        f.seek(first)
        at = first
        while at < end and (raw := f.read(STEP)):
            k = raw.find(b"\n")
            if k >= 0:
                return min(end, at + k + 1)
            at += len(raw)
    return end


def files(pattern: str, known: dict[str, list[int]]) -> dict[str, list[int]]:
    """Each file's [inode, byte to read to], given those known so far."""
    out = {}
    for path in sorted(glob.glob(pattern)):
        try:
            stat = os.stat(path)
            inode, at = known.get(path, [stat.st_ino, 0])
            same = inode == stat.st_ino and at <= stat.st_size
            out[path] = [stat.st_ino, last_line_end(path, stat.st_size, at if same else 0)]
        except FileNotFoundError:
            continue
    return out


def pieces(start: dict[str, list[int]], end: dict[str, list[int]]) -> Iterator[Piece]:
    for path, (inode, to) in end.items():
        old, at = start.get(path, [inode, 0])
        if old != inode or at > to:
            at = 0
        while at < to:
            stop = to
            if to - at > TASK_BYTES:
                # a line longer than a task is a task of its own
                stop = last_line_end(path, at + TASK_BYTES, at)
                stop = stop if stop > at else next_line_end(path, at + TASK_BYTES, to)
            yield Piece(path, at, stop)
            at = stop


class LogReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.known: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        self.known = files(self.pattern, self.known)
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return list(pieces(start["files"], end["files"]))

    def read(self, partition: Piece) -> Iterator[tuple]:
        try:
            f = open(partition.path, "rb")
        except FileNotFoundError:
            return
        with f:
            f.seek(partition.first)
            at = partition.first
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "foliant_log"

    def schema(self) -> str:
        return "path string, at long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LogReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
