"""Streams with state: batch completion and growing logs, each over several runs with a checkpoint."""

from __future__ import annotations

import datetime as dt

import pytest

from foliant.streaming import completion as cp
from foliant.streaming import log_source as ls

EVENT = "batch_id string, doc_id string, state string, ts timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def test_batches_complete_once(spark, tmp_path, rocks):
    path, out, mark = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "mark")
    rounds = [
        [("a", "1", "pending", at(0)), ("a", "2", "pending", at(0)), ("a", "1", "processing", at(5)), ("b", "1", "pending", at(1)), ("c", None, "pending", at(1)), ("c", "1", "odd", at(1))],
        # the same again, a change that comes late, and the end of both documents
        [("a", "1", "processing", at(5)), ("a", "1", "complete", at(20)), ("a", "1", "complete", at(20)), ("a", "2", "failed", at(21)), ("a", "2", "processing", at(6))],
        [("z", "1", "pending", at(40))],  # the watermark moves on, but less than the quiet time
        [("a", "3", "pending", at(41))],  # one more document in time
        [("a", "3", "complete", at(45))],
        [("z", "1", "pending", at(200))],
        [("z", "1", "pending", at(201))],
        [("b", "1", "complete", at(202)), ("z", "1", "complete", at(203))],
        [("y", "1", "pending", at(9000))],
        [("y", "1", "pending", at(9001))],
    ]

    def run():
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
        q = cp.batch_completion(events, quiet_s=30, keep_s=5000, late="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        q.trigger(availableNow=True).start().awaitTermination(240)
        return sorted((r.batch_id, r.outcome, r.total, r.complete, r.failed) for r in spark.read.schema(cp.RESULT).parquet(out).collect())

    for n, rows in enumerate(rounds):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)
        if n in (2, 6, 9):  # stop and start again in between
            got = run()
            if n == 2:
                assert got == []
            if n == 6:
                assert got == [("a", "completed", 3, 2, 1)]
    assert got == [("a", "completed", 3, 2, 1), ("b", "completed", 1, 1, 0), ("z", "completed", 1, 1, 0)]


def test_logs_are_followed(spark, tmp_path, monkeypatch):
    logs, out, mark = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "mark")
    logs.mkdir()
    ls.register(spark)

    def run():
        rows = spark.readStream.format("foliant_log").option("path", str(logs / "*.log")).load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
        got = spark.read.schema("path string, at long, value string").parquet(out).collect()
        return sorted((r.path.rsplit("/", 1)[1], r.at, r.value) for r in got)

    (logs / "a.log").write_bytes("one\r\nzwei ü\n\nhal".encode())
    (logs / "b.log").write_bytes(b"x\n")
    (logs / "c.txt").write_bytes(b"no\n")
    first = [("a.log", 0, "one"), ("a.log", 5, "zwei ü"), ("a.log", 13, ""), ("b.log", 0, "x")]
    assert run() == first and run() == first
    with open(logs / "a.log", "ab") as f:
        f.write(b"f\nlast \xff\n")
    (logs / "d.log").write_bytes(b"new\n")
    second = sorted([*first, ("a.log", 14, "half"), ("a.log", 19, "last �"), ("d.log", 0, "new")])
    assert run() == second
    # rotation: another, shorter file of the name
    (logs / "a.log").unlink()
    (logs / "a.log").write_bytes(b"r\n")
    (logs / "b.log").unlink()
    assert run() == sorted([*second, ("a.log", 0, "r")])


def test_pieces_end_at_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(ls, "TASK_BYTES", 50)
    monkeypatch.setattr(ls, "STEP", 7)
    lines = [b"x" * (k * 13 % 90) + b"\n" for k in range(40)]
    path = tmp_path / "f.log"
    path.write_bytes(b"".join(lines) + b"rest")
    end = ls.files(str(path), {})
    assert end[str(path)][1] == sum(map(len, lines))
    got = list(ls.pieces({}, end))
    reader = ls.LogReader(str(path))
    assert [v.encode() + b"\n" for p in got for _, _, v in reader.read(p)] == lines and len(got) > 10
    assert list(ls.pieces(end, end)) == [] and all(a.end == b.first for a, b in zip(got, got[1:]))
