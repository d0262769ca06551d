"""Followers of logs: whole transactions only, files that follow on, and a query that is started again."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import followers


def scanned(kind, path, offset=None):
    return [(row[1], row[3], whole) for row, _, whole in followers.KINDS[kind](str(path), offset or {})]


def test_events_follow_on_and_wait_for_their_end(tmp_path):
    followers.write_binlog(str(tmp_path), "log.1", [(15, 1), (30, 2), (16, 3)])
    followers.write_binlog(str(tmp_path), "log.2", [(30, 4), (30, 5)])
    reader = followers.LogFollower("binlog", str(tmp_path))
    first = reader.latestOffset()
    assert first == {"log": "log.1", "position": 4 + 3 * 19}
    followers.write_binlog(str(tmp_path), "log.2", [(30, 4), (30, 5), (16, 6), (30, 7)])
    second = reader.latestOffset()
    assert second == {"log": "log.2", "position": 4 + 3 * 19}
    rows = list(reader.read(reader.partitions(first, second)[0]))
    assert [(r[0], r[3], r[4]) for r in rows] == [("log.2", "30", 4), ("log.2", "30", 5), ("log.2", "16", 6)]
    assert reader.partitions(second, second) == []
    with open(tmp_path / "log.2", "ab") as f:
        f.write(b"\x00" * 10)  # an event that is being written
    assert reader.latestOffset() == second


def test_transactions_a_batch(tmp_path):
    followers.write_binlog(str(tmp_path), "log.1", [(30, n) if n % 3 else (16, n) for n in range(1, 31)])
    reader = followers.LogFollower("binlog", str(tmp_path), most=4)
    ends = [reader.latestOffset()["position"] for _ in range(4)]
    assert ends == [4 + 19 * n for n in (12, 24, 30, 30)]


def test_a_log_that_is_gone_or_damaged_is_an_error(tmp_path):
    followers.write_binlog(str(tmp_path), "log.2", [(30, 1)])
    with pytest.raises(ValueError, match="gone"):
        scanned("binlog", tmp_path, {"log": "log.1", "position": 4})
    (tmp_path / "log.2").write_bytes(followers.BINLOG_MAGIC + followers.binlog_event(30, 1, 4)[:9] + b"\x05\0\0\0" + b"\0" * 6)
    with pytest.raises(ValueError, match="5 bytes"):
        scanned("binlog", tmp_path)


def test_lines_of_transactions(tmp_path):
    entries = [{"op": "i", "ts": 1}, {"op": "u", "ts": 2, "txn": 7}, {"op": "d", "ts": 3, "txn": 7, "commit": True}, {"op": "i", "ts": 4, "txn": 8}]
    (tmp_path / "a").write_text("".join(json.dumps(e) + "\n" for e in entries) + '{"op"')
    assert [(k, w) for _, k, w in scanned("lines", tmp_path)] == [("i", True), ("u", False), ("d", True), ("i", False)]


def test_frames_of_a_page_log(tmp_path):
    path = tmp_path / "x.db"
    assert scanned("pages", f"{path}-wal") == []
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA wal_autocheckpoint = 0")
    db.execute("CREATE TABLE t (a)")
    for n in range(3):
        db.execute("INSERT INTO t VALUES (?)", ("x" * 5000 * n,))
    frames = scanned("pages", f"{path}-wal")
    assert sum(w for *_, w in frames) == 4 and frames[-1][2] and len(frames) > 6
    reader = followers.LogFollower("pages", f"{path}-wal")
    before = reader.latestOffset()
    assert before["position"] == len(frames)
    raw = bytearray((tmp_path / "x.db-wal").read_bytes())
    raw[-1] ^= 1  # the last frame no longer holds
    (tmp_path / "bad").write_bytes(bytes(raw))
    assert len(scanned("pages", tmp_path / "bad")) == len(frames) - 1
    db.execute("PRAGMA wal_checkpoint(RESTART)")
    db.execute("INSERT INTO t VALUES (1)")
    after = reader.latestOffset()
    assert after["log"] != before["log"] and after["position"] == len(scanned("pages", f"{path}-wal"))
    db.close()


def test_a_query_goes_on_after_it_was_stopped(spark, tmp_path):
    spark.dataSource.register(followers.LogDataSource)
    logs, out, kept = (tmp_path / n for n in ("logs", "out", "kept"))
    logs.mkdir()

    def run():
        stream = spark.readStream.format("followed_log").option("kind", "lines").option("path", str(logs)).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(kept)).trigger(availableNow=True).start(str(out)).awaitTermination()
        return [r[0] for r in spark.read.parquet(str(out)).select("detail").orderBy("detail").collect()]

    (logs / "a").write_text("".join(json.dumps({"op": "i", "ts": n}) + "\n" for n in range(3)) + json.dumps({"op": "i", "ts": 3, "txn": 1}) + "\n")
    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    with open(logs / "a", "a") as f:
        f.write(json.dumps({"op": "i", "ts": 4, "txn": 1, "commit": True}) + "\n")
    (logs / "b").write_text(json.dumps({"op": "i", "ts": 5}) + "\n")
    assert run() == [0, 1, 2, 3, 4, 5]
    assert spark.read.parquet(str(out)).agg(F.count_distinct("log")).first()[0] == 2
