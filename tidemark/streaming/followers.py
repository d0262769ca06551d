"""Followers of logs as stream sources: positions that survive a restart, whole transactions only, files that follow on.

`format("followed_log")` with `kind` and `path`. A follower hands out entries up to the end of the last whole transaction;
what comes behind it waits until its end is there. The engine keeps the offsets in the query's checkpoint, so a query
that was killed goes on where its last finished batch ended, and reads that batch again from the same offsets if needed.

kinds: `binlog`, a folder of binary event logs that follow on from each other by name; `lines`, a folder of logs with one
JSON entry a line; `pages`, the page log beside a database file, whose generations begin anew at its start.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources.binary import page_checksum

#: The first bytes of a binary log, and the types of events that end a transaction or a file.
BINLOG_MAGIC = b"\xfebin"
XID, ROTATE, FORMAT, PREVIOUS = 16, 4, 15, 35
#: The first words of a page log, for checksums over little- and big-endian words.
PAGES_MAGIC = (0x377F0682, 0x377F0683)

SCHEMA = "log string, position bigint, next_position bigint, kind string, detail bigint, payload string"
Entry = tuple[tuple, dict, bool]  # row, offset behind it, whether it ends a transaction


def _files(folder: str, since: str | None) -> list[str]:
    names = sorted(n for n in os.listdir(folder) if not n.startswith((".", "_")))
    if since is not None and since not in names:
        raise ValueError(f"the log {since} is gone before it was followed to its end")
    return names[names.index(since) :] if since is not None else names


def binlog_entries(folder: str, offset: dict) -> Iterator[Entry]:
    """Events by their headers; bodies are passed over unread."""
    for name in _files(folder, offset.get("log")):
        at = offset["position"] if name == offset.get("log") else 4
        with open(os.path.join(folder, name), "rb") as f:
            if f.read(4) != BINLOG_MAGIC:
                return  # not there yet
            f.seek(0, os.SEEK_END)
            end = f.tell()
            while at + 19 <= end:
                f.seek(at)
                when, kind, _, size, following, _ = struct.unpack("<IBIIIH", f.read(19))
                if size < 19:
                    raise ValueError(f"{name}: an event of {size} bytes at {at}")
                if at + size > end:
                    return  # not whole yet
                row = (name, at, at + size, str(kind), when, None)
                at += size
                yield row, {"log": name, "position": at}, kind in (XID, ROTATE, FORMAT, PREVIOUS)


def line_entries(folder: str, offset: dict) -> Iterator[Entry]:
    """Lines of JSON; an entry with `txn` belongs to a transaction that ends with the one that has `commit`, others stand
    alone. Entries of several transactions do not interleave."""
    for name in _files(folder, offset.get("log")):
        at = offset["position"] if name == offset.get("log") else 0
        with open(os.path.join(folder, name), "rb") as f:
            f.seek(at)
            for line in f:
                if not line.endswith(b"\n"):
                    return  # not whole yet
                entry = json.loads(line)
                row = (name, at, at + len(line), str(entry.get("op")), entry.get("ts"), line.decode("utf-8").rstrip("\n"))
                at += len(line)
                yield row, {"log": name, "position": at}, entry.get("txn") is None or bool(entry.get("commit"))


def page_entries(path: str, offset: dict) -> Iterator[Entry]:
    """Frames of the page log of a database, with the page's number; a frame that commits tells the pages of the database.

    A frame counts if its salts are those of the log and the checksums hold from the first frame on; what follows is the
    rest of an earlier generation. A log that began anew is another generation and is followed from its first frame.
    """
    try:
        f = open(path, "rb")
    except FileNotFoundError:
        return
    with f:
        head = f.read(32)
        if len(head) < 32:
            return
        magic, _, size = struct.unpack(">III", head[:12])
        if magic not in PAGES_MAGIC:
            raise ValueError("not a page log")
        big = magic == PAGES_MAGIC[1]
        salts = head[16:24]
        state = page_checksum(head[:24], big)
        if state != struct.unpack(">II", head[24:32]):
            return
        log = salts.hex()
        done = offset["position"] if offset.get("log") == log else 0
        number = 0
        while len(frame := f.read(24 + size)) == 24 + size and frame[8:16] == salts:
            state = page_checksum(frame[24:], big, *page_checksum(frame[:8], big, *state))
            if state != struct.unpack(">II", frame[16:24]):
                return
            page, pages = struct.unpack(">II", frame[:8])
            number += 1
            if number > done:
                yield (log, number - 1, number, "commit" if pages else "page", page, str(pages) if pages else None), {"log": log, "position": number}, pages > 0


KINDS = {"binlog": binlog_entries, "lines": line_entries, "pages": page_entries}


class LogDataSource(DataSource):
    """`format("followed_log")`: see the module."""

    @classmethod
    def name(cls) -> str:
        return "followed_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogFollower(self.options["kind"], self.options["path"], int(self.options.get("most", "0")))


class _Stretch(InputPartition):
    def __init__(self, start: dict, end: dict):
        self.start, self.end = start, end


class LogFollower(DataSourceStreamReader):
    """most: transactions a batch, all there are by default."""

    def __init__(self, kind: str, path: str, most: int = 0):
        self.kind, self.path, self.most = kind, path, most
        self.at: dict = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        ended = 0
        for _, after, whole in KINDS[self.kind](self.path, self.at):
            if whole:
                self.at = after
                ended += 1
                if ended == self.most:
                    break
        return dict(self.at)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        # a query that goes on asks for the offsets of its last batch first
        if not self.at or (end.get("log"), end.get("position")) > (self.at.get("log"), self.at.get("position")):
            self.at = dict(end)
        return [_Stretch(start, end)] if start != end else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.end:
            return
        for row, after, _ in KINDS[self.kind](self.path, partition.start):
            yield row
            if after == partition.end:
                return
        raise ValueError("the log ends before the offset that it had reached")


def binlog_event(kind: int, when: int, position: int, body: bytes = b"", server: int = 1) -> bytes:
    """An event as a binary log holds it at a position."""
    size = 19 + len(body)
    return struct.pack("<IBIIIH", when, kind, server, size, position + size, 0) + body


def write_binlog(folder: str, name: str, events: Sequence[tuple[int, int]]) -> None:
    """A log of (type, time) events."""
    parts, at = [BINLOG_MAGIC], 4
    for kind, when in events:
        parts.append(binlog_event(kind, when, at))
        at += len(parts[-1])
    with open(os.path.join(folder, name), "wb") as f:
        f.write(b"".join(parts))
