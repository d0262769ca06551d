"""Readers of database dumps: which format a file has, and how many rows it holds per table.

A dump is a stream that must be read in order, so one file is one task; many files are read side by side. A file is read
a line or statement at a time, whatever its size, and unpacked on the way.
"""

from __future__ import annotations

import gzip
import io
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COPY = re.compile(r"^COPY ((?:\"(?:[^\"]|\"\")*\"|[^\s.(\"])+)(?:\.((?:\"(?:[^\"]|\"\")*\"|[^\s.(\"])+))? ?(?:\([^)]*\) )?FROM stdin;$", re.IGNORECASE)
_INSERT = re.compile(r"^INSERT INTO (?:ONLY )?((?:\"(?:[^\"]|\"\")*\"|[^\s.(\"])+)(?:\.((?:\"(?:[^\"]|\"\")*\"|[^\s.(\"])+))? ", re.IGNORECASE)
_MYSQL_TABLE = re.compile(rb"INSERT (?:IGNORE )?INTO (?:`((?:[^`]|``)*)`\.)?`((?:[^`]|``)*)`[^'\"]*?VALUES\s*", re.IGNORECASE)
_USE = re.compile(rb"USE `((?:[^`]|``)*)`;")
_VERSION = re.compile(r"-- Dumped from database version (\S+)")
_CONNECT = re.compile(r"\\connect (?:-reuse-previous=on )?\"?([^\" ]+)\"?")
_EXTENSION = re.compile(r'CREATE EXTENSION (?:IF NOT EXISTS )?("?[\w-]+"?)')
_FACTS = (("database", re.compile(rb"Database: (\S+)")), ("server", re.compile(rb"(?:Server version\s+|Distrib )([0-9][^\s,]*)")))


def sniff(data: bytes) -> str:
    """custom, mongo, mysql, plain or unknown, by the first bytes of a dump."""
    if data[:5] == b"PGDMP":
        return "custom"
    if data[:4] == b"\x6d\xe2\x99\x81":
        return "mongo"
    head = data[:4096]
    if b"MySQL dump" in head or b"MariaDB dump" in head:
        return "mysql"
    if b"PostgreSQL database" in head or b"COPY " in head or b"INSERT INTO" in head:
        return "plain"
    return "unknown"


def _name(part: str) -> str:
    return part[1:-1].replace('""', '"') if part[:1] == '"' else part


@dataclass
class Dump:
    """What a dump holds: rows by (schema, table), in a cluster's dump with `database:` before the schema, and its facts."""

    kind: str
    rows: Counter = field(default_factory=Counter)
    database: str | None = None
    server: str | None = None
    extensions: set[str] = field(default_factory=set)
    creates_database: bool = False
    cron_jobs: int = 0
    whole: bool = True


def _table(m: re.Match, database: str | None) -> tuple[str, str]:
    schema, table = (_name(m[1]), _name(m[2])) if m[2] else ("public", _name(m[1]))
    return (f"{database}:{schema}" if database else schema), table


def scan_plain(lines: Iterable[bytes]) -> Dump:
    """COPY blocks and INSERT lines, one line at a time; a block that is not closed is an error, as is text that is no
    dump. Rows of the scheduler's jobs are told apart, and those of their runs are left out."""
    found = Dump("plain")
    inside = database = None
    headed = False
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if inside is not None:
            if line == "\\.":
                inside = None
            else:
                found.rows[inside] += 1
        elif line.startswith("--"):
            if line.startswith("-- PostgreSQL database cluster dump"):
                found.kind, headed = "cluster", True
            elif line.startswith("-- PostgreSQL database"):
                headed = True
            elif found.server is None and (m := _VERSION.match(line)):
                found.server = m[1]
        elif m := _COPY.match(line):
            inside = _table(m, database)
            found.rows[inside] += 0
        elif m := _INSERT.match(line):
            found.rows[_table(m, database)] += 1
        elif m := _CONNECT.match(line):
            database = m[1]
        elif m := _EXTENSION.match(line):
            found.extensions.add(m[1].strip('"'))
        elif line.startswith("CREATE DATABASE "):
            found.creates_database = True
    if inside is not None:
        raise ValueError(f"the dump ends within the rows of {'.'.join(inside)}")
    if not found.rows and not headed:
        raise ValueError("no header and no rows: not a dump")
    for schema, table in list(found.rows):
        if schema.rsplit(":", 1)[-1] == "cron" and table in ("job", "job_run_details"):
            n = found.rows.pop((schema, table))
            found.cron_jobs += n if table == "job" else 0
    return found


#: What matters outside of quotes: brackets and the end of a statement; texts are passed over as a whole.
_PIECE = re.compile(rb"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|[()]|;|['"`]""", re.DOTALL)


def _tuples(statement: bytes, at: int) -> int | None:
    """Tuples from a position to the end of the statement; None if it does not end here."""
    depth = count = 0
    for m in _PIECE.finditer(statement, at):
        c = m[0]
        if c == b"(":
            count += depth == 0
            depth += 1
        elif c == b")":
            depth -= 1
        elif c == b";":
            if depth == 0:
                return count
        elif len(c) == 1:
            return None  # a text that goes on
    return None


def scan_mysql(lines: Iterable[bytes]) -> Dump:
    """INSERT statements, one statement at a time, those in bodies of routines left out; without its last line a dump is cut."""
    found = Dump("mysql", whole=False)
    schema, routine = "", False
    held: list[bytes] = []
    for line in lines:
        if held:
            held.append(line)
        elif routine:
            routine = not line.startswith(b"DELIMITER ;") or line.startswith(b"DELIMITER ;;")
            continue
        elif line.startswith(b"--"):
            for name, pattern in _FACTS:
                if getattr(found, name) is None and (m := pattern.search(line)):
                    setattr(found, name, m[1].decode("utf-8", "replace"))
            found.whole |= line.startswith(b"-- Dump completed")
            continue
        elif line.startswith(b"DELIMITER ;;"):
            routine = True
            continue
        elif m := _USE.match(line):
            schema = _ticks(m[1])
            continue
        elif line.startswith(b"CREATE DATABASE "):
            found.creates_database = True
            continue
        elif line[:6].upper() == b"INSERT":
            held = [line]
        else:
            continue
        if not line.rstrip().endswith(b";"):
            continue
        statement = b"".join(held)
        m = _MYSQL_TABLE.match(statement)
        rows = _tuples(statement, m.end()) if m else 0
        if rows is None:
            continue
        held = []
        if m:
            found.rows[(_ticks(m[1]) if m[1] else schema, _ticks(m[2]))] += rows
    if held:
        raise ValueError("the dump ends within an INSERT statement")
    if not found.whole:
        raise ValueError("the dump lacks its last line")
    return found


def _ticks(name: bytes) -> str:
    return name.replace(b"``", b"`").decode("utf-8", "replace")


def scan(stream: BinaryIO) -> Dump:
    """Any dump, plain or packed, read as it streams past. Formats that hold no text are an error that names them."""
    buffered = io.BufferedReader(stream, 1 << 16) if not hasattr(stream, "peek") else stream
    if buffered.peek(2)[:2] == b"\x1f\x8b":
        buffered = io.BufferedReader(gzip.GzipFile(fileobj=buffered), 1 << 16)
    kind = sniff(buffered.peek(4096)[:4096])
    if kind == "mongo":
        from tidemark.sources.archives import read_archive

        found = Dump("mongo")
        for namespace, view, documents, _, ended, sound in read_archive(buffered.read):
            if not ended:
                raise ValueError(f"the dump ends within {namespace}")
            if sound is False:
                raise ValueError(f"the documents of {namespace} do not match their checksum")
            if not view:
                found.rows[tuple(namespace.split(".", 1))] += documents
        return found
    if kind not in ("plain", "mysql"):
        raise ValueError(f"{kind} dumps are not counted")
    return scan_mysql(buffered) if kind == "mysql" else scan_plain(buffered)


def plain_counts(text: str) -> Counter:
    """(schema, table) to rows of a plain dump."""
    return scan_plain(io.BytesIO(text.encode("utf-8", "surrogatepass"))).rows


def mysql_counts(data: bytes) -> Counter:
    """(database, table) to rows of INSERT statements."""
    return scan_mysql(io.BytesIO(data)).rows


def mysql_facts(data: bytes) -> dict[str, str | None]:
    """Database, server version and whether the dump is whole, off its comments."""
    find = lambda p: (m[1].decode() if (m := p.search(data)) else None)
    return {**{name: find(p) for name, p in _FACTS}, "whole": "yes" if re.search(rb"^-- Dump completed", data, re.MULTILINE) else None}


def counted(path: str, stream: BinaryIO) -> Iterator[tuple]:
    """(path, kind, schema_name, table_name, rows, problem) of a dump."""
    head = io.BufferedReader(stream, 1 << 16) if not hasattr(stream, "peek") else stream
    try:
        found = scan(head)
        yield from ((path, found.kind, s, t, n, None) for (s, t), n in sorted(found.rows.items()))
    except (ValueError, OSError, EOFError) as e:
        yield path, None, None, None, None, str(e)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows += counted(path.as_py(), io.BytesIO(content.as_py() or b""))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(),) * 4 + (pa.int64(), pa.string()), strict=True)], names=["path", "kind", "schema_name", "table_name", "rows", "problem"])


def table_counts(files: DataFrame) -> DataFrame:
    """path, kind, schema_name, table_name, rows, problem of dumps given as (path, content).

    A table without rows counts 0. A file that is cut, damaged, empty, null or no dump gives one row with its problem.
    Dumps that do not fit one value are read as files, by `format("dump")`.
    """
    return files.select("path", "content").mapInArrow(_count, "path string, kind string, schema_name string, table_name string, rows bigint, problem string")


def dump_facts(files: DataFrame) -> DataFrame:
    """path, kind, database, server, extensions, creates_database, cron_jobs, tables, rows, problem of dumps as (path, content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(),) * 4 + (pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        names = ["path", "kind", "database", "server", "extensions", "creates_database", "cron_jobs", "tables", "rows", "problem"]
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                try:
                    d = scan(io.BytesIO(content.as_py() or b""))
                    rows.append((path.as_py(), d.kind, d.database, d.server, sorted(d.extensions), d.creates_database, d.cron_jobs, len(d.rows), sum(d.rows.values()), None))
                except (ValueError, OSError, EOFError) as e:
                    rows.append((path.as_py(), *[None] * 8, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(read, "path string, kind string, database string, server string, extensions array<string>, creates_database boolean, cron_jobs bigint, tables bigint, rows bigint, problem string")


def finished_name(name):
    """Whether a file's name is that of a finished dump: not hidden, no part and not temporary."""
    return ~name.rlike(r"(\.part|\.tmp|\.hidden)$|^\.")


def read_dumps(spark: SparkSession, location: str) -> DataFrame:
    """path and content of the dumps at a location; names of unfinished and hidden files are passed over."""
    files = spark.read.format("binaryFile").load(location)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(finished_name(name)).select("path", "content")


def newest_object(spark: SparkSession, location: str, pattern: str = "*") -> DataFrame:
    """The newest file at a location, of equal times the one with the greatest name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(location).select("path", "modificationTime", "length")
    return found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def schema_facts(ddl: DataFrame, text: str = "ddl") -> DataFrame:
    """kind, name of the tables and extensions that a schema's text creates, and of the roles that a role script does."""
    found = lambda kind, pattern: ddl.select(F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name"))
    table = found("table", r"(?im)^CREATE (?:UNLOGGED )?TABLE (?:IF NOT EXISTS )?(\S+) \(")
    extension = found("extension", r'(?im)^CREATE EXTENSION (?:IF NOT EXISTS )?"?([\w-]+)"?')
    role = found("role", r'(?im)^CREATE ROLE "?([\w-]+)"?')
    return table.unionByName(extension).unionByName(role).distinct()
