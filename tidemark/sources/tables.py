"""Tables of databases read in parallel: JDBC by ranges of a key, SQLite files by ranges of the row id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def key_ranges(low: int | None, high: int | None, parts: int) -> list[tuple[int, int]]:
    """Ranges [a, b] that cover low to high in at most `parts` parts of about the same width; none of an empty table."""
    if low is None or high is None:
        return []
    parts = max(1, min(parts, high - low + 1))
    edges = [low + (high - low + 1) * i // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def range_predicates(column: str, low: int | None, high: int | None, parts: int, dialect: str = "postgresql") -> list[str]:
    """One condition a range; rows with a null key come with the first, or alone if there are no others."""
    quote = "`" if dialect == "mysql" else '"'
    name = quote + column.replace(quote, quote * 2) + quote
    found = [f"{name} BETWEEN {a} AND {b}" for a, b in key_ranges(low, high, parts)]
    return [f"({found[0]} OR {name} IS NULL)", *found[1:]] if found else [f"{name} IS NULL"]


def read_table(spark: SparkSession, url: str, table: str, key: str, parts: int, **properties: str) -> DataFrame:
    """A table over JDBC, its key ranges side by side, in one transaction's view a connection where the database gives it.

    The bounds are read first. Tables without a whole-number key are to be read by `spark.read.jdbc` in one part.
    """
    dialect = "mysql" if url.startswith(("jdbc:mysql", "jdbc:mariadb")) else "postgresql"
    quote = "`" if dialect == "mysql" else '"'
    name = quote + key.replace(quote, quote * 2) + quote
    bounds = spark.read.jdbc(url, f"(SELECT min({name}) AS low, max({name}) AS high FROM {table}) AS bounds", properties=properties).first()
    low, high = (None if b is None else int(b) for b in bounds)
    return spark.read.jdbc(url, table, predicates=range_predicates(key, low, high, parts, dialect), properties={"isolationLevel": "REPEATABLE_READ", **properties})


_KINDS = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "bigint"))


def column_kind(declared: str) -> str:
    """The kind of a column by its declared type; without one, and for numeric ones, values come as text."""
    return next((k for word, k in _KINDS if word in declared.upper()), "string")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def copied_file(source: str, target: str) -> None:
    """A consistent copy of a database that may be in use, with what is not yet written back from its log."""
    import sqlite3

    with sqlite3.connect(f"file:{source}?mode=ro", uri=True) as a, sqlite3.connect(target) as b:
        a.backup(b)
    a.close()
    b.close()


class SqliteDataSource(DataSource):
    """`format("sqlite")`: the table `table` of the database file `path`, which all workers see, in `parts` parts."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        columns = _columns(self.options["path"], self.options["table"])
        return ", ".join(f"`{n.replace('`', '``')}` {k}" for n, k in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options["table"], int(self.options.get("parts", "4")))


def _connected(path: str):
    import sqlite3

    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    with _connected(path) as db:
        found = [(r[1], column_kind(r[2] or "")) for r in db.execute(f"PRAGMA table_info({quoted(table)})")]
    db.close()
    if not found:
        raise ValueError(f"no table {table}")
    return found


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int):
        self.path, self.table, self.parts = path, table, parts

    def partitions(self) -> Sequence[InputPartition]:
        import sqlite3

        with _connected(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:
                low = high = None
        db.close()
        # a view, or a table without row ids or rows, is read in one part
        return [InputPartition(r) for r in key_ranges(low, high, self.parts)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        columns = _columns(self.path, self.table)
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
        convert = {"bigint": lambda v: int(v) if isinstance(v, (int, float)) else None, "double": lambda v: float(v) if isinstance(v, (int, float)) else None, "binary": lambda v: v.encode() if isinstance(v, str) else v, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}
        where = f" WHERE rowid BETWEEN {partition.value[0]} AND {partition.value[1]}" if partition.value else ""
        with _connected(self.path) as db:
            rows = db.execute(f"SELECT {', '.join(quoted(n) for n, _ in columns)} FROM {quoted(self.table)}{where}")
            while block := rows.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array([None if v is None else convert[k](v) for v in c], kinds[k]) for c, (_, k) in zip(zip(*block, strict=True), columns, strict=True)], names=[n for n, _ in columns])
        db.close()


def sqlite_tables(path: str) -> list[str]:
    """Tables of a database file, without its own."""
    with _connected(path) as db:
        found = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
    db.close()
    return found


def sqlite_counts(spark: SparkSession, path: str) -> DataFrame:
    """table_name, rows of every table of a database file, a table a task."""
    names = sqlite_tables(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with _connected(path) as db:
                rows = [db.execute(f"SELECT count(*) FROM {quoted(n)}").fetchone()[0] for n in batch.column(0).to_pylist()]
            db.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64())], names=["table_name", "rows"])

    listed = spark.createDataFrame([(n,) for n in names], "table_name string").repartition(max(1, len(names)))
    return listed.mapInArrow(count, "table_name string, rows bigint")


def local_path(location: str) -> str:
    """The path of a `file:` location, made if it is missing."""
    path = location.removeprefix("file://").removeprefix("file:")
    if "://" in path:
        raise ValueError(f"{location} is no folder of a file system that this machine sees")
    Path(path).mkdir(parents=True, exist_ok=True)
    return path
