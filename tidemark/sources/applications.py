"""What applications keep beside their tables: settings, migrations, attachments, roles."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}")
_ESCAPED = {"n": "\n", "t": "\t", '"': '"', "\\": "\\", "$": "$"}


def _quoted(text: str, at: int) -> tuple[str, int]:
    """A value in double quotes from behind the first, which may run over lines, and where it ends."""
    out = []
    while at < len(text):
        c = text[at]
        if c == '"':
            return "".join(out), at + 1
        if c == "\\" and at + 1 < len(text):
            at += 1
            out.append(_ESCAPED.get(text[at], "\\" + text[at]))
        else:
            out.append(c)
        at += 1
    raise ValueError("a double quote is not closed")


def settings(text: str) -> tuple[dict[str, str], dict[str, str]]:
    """Values of KEY=value lines, and the names that values refer to in vain by key.

    Comments and `export` are passed over, single quotes are literal, double quotes have escapes and run over lines, and
    ${KEY} stands for a key set above. A line that is none of these, or a quote that stays open, is an error.
    """
    values: dict[str, str] = {}
    lost: dict[str, str] = {}
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if not line or line.startswith("#"):
            at = end + 1
            continue
        key, there, _ = line.removeprefix("export ").partition("=")
        key = key.strip()
        if not there or not _KEY.fullmatch(key):
            raise ValueError(f"line {text.count(chr(10), 0, at) + 1} is not KEY=value")
        start = text.index("=", at) + 1
        while start < len(text) and text[start] in " \t":
            start += 1
        literal = False
        if text[start : start + 1] == '"':
            value, after = _quoted(text, start + 1)
            end = text.find("\n", after)
            end = len(text) if end < 0 else end
        elif text[start : start + 1] == "'":
            close = text.find("'", start + 1, end)
            if close < 0:
                raise ValueError(f"{key}: a single quote is not closed")
            value, literal = text[start + 1 : close], True
        else:
            value = text[start:end].split(" #")[0].strip()
        lost.pop(key, None)
        if not literal:
            for name in _REFERENCE.findall(value):
                if name not in values:
                    lost[key] = name
            value = _REFERENCE.sub(lambda m: values.get(m[1], ""), value)
        values[key] = value
        at = end + 1
    return values, lost


def _settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True):
            try:
                values, lost = settings(text or "")
                rows += [(path, k, v, lost.get(k), None) for k, v in values.items()]
            except ValueError as e:
                rows.append((path, None, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "key", "value", "unresolved", "problem"])


def read_settings(files: DataFrame) -> DataFrame:
    """path, key, value, unresolved, problem of settings given as (path, text); a file that does not read is one row."""
    return files.select("path", "text").mapInArrow(_settings, "path string, key string, value string, unresolved string, problem string")


def pending_migrations(paths: DataFrame, ran: DataFrame, path: str = "path", folder: str = "database/migrations", name: str = "migration") -> DataFrame:
    """migration of the files right below a folder that were not run; folders below it are not read."""
    shape = f"^{re.escape(folder.strip('/'))}/([^/]+)\\.php$"
    found = paths.filter(F.col(path).rlike(shape)).select(F.regexp_extract(path, shape, 1).alias("migration")).distinct()
    return found.join(ran.select(F.col(name).alias("migration")), "migration", "left_anti")


_ROLE = r'("(?:[^"]|"")+"|[\w$]+)'


def _unquoted(c: Column) -> Column:
    return F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)


def role_script(scripts: DataFrame, text: str = "script") -> tuple[DataFrame, DataFrame]:
    """Roles (role, statements in order) and memberships (role, member) of scripts with one statement a line.

    Settings of a role in one database are left out. A role without CREATE ROLE is none.
    """
    lines = scripts.select(F.posexplode(F.split(text, "\n")).alias("place", "line")).select("place", F.trim("line").alias("line"))
    of = lambda pattern, k=1: _unquoted(F.regexp_extract("line", pattern, k))
    create, alter = f"^CREATE ROLE {_ROLE};$", f"^ALTER ROLE {_ROLE} (WITH|SET|RESET) "
    comment, member = f"^COMMENT ON ROLE {_ROLE} IS ", f"^GRANT {_ROLE} TO {_ROLE}(?: |;)"
    made = F.col("line").rlike(create)
    name = F.when(made, of(create)).when(F.col("line").rlike(alter), of(alter)).when(F.col("line").rlike(comment), of(comment))
    roles = lines.select(name.alias("role"), made.alias("made"), F.struct("place", "line").alias("s")).filter("role IS NOT NULL")
    roles = roles.groupBy("role").agg(F.max("made").alias("made"), F.array_sort(F.collect_list("s")).alias("s")).filter("made")
    return roles.select("role", F.transform("s", lambda x: x["line"]).alias("statements")), lines.filter(F.col("line").rlike(member)).select(of(member).alias("role"), of(member, 2).alias("member"))


def chosen_roles(roles: DataFrame, members: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the roles those in `names`, the memberships between them, and the names that the script lacks."""
    wanted = names.select("role").distinct()
    kept = roles.join(wanted, "role", "left_semi")
    both = members.join(wanted, "role", "left_semi").join(wanted.withColumnRenamed("role", "member"), "member", "left_semi")
    return kept, both.select("role", "member"), wanted.join(roles, "role", "left_anti")


_CREATE = re.compile(r"CREATE TABLE (?:IF NOT EXISTS )?`((?:[^`]|``)*)`")
_COLUMN = re.compile(r"\s*`((?:[^`]|``)*)` ")
_INSERT = re.compile(r"INSERT INTO `((?:[^`]|``)*)` VALUES ")
#: A value of a tuple: a text in quotes, or anything up to the next comma or bracket.
_VALUE = re.compile(r"(?:_binary )?'((?:[^'\\]|\\.|'')*)'|([^',()]+)", re.DOTALL)
_BACKSLASH = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "Z": "\x1a"}


def _plain(text: str) -> str:
    return re.sub(r"\\(.)|''", lambda m: _BACKSLASH.get(m[1], m[1]) if m[1] else "'", text, flags=re.DOTALL)


def marked_values(lines: Iterator[str], marker: str) -> Iterator[tuple[str, str]]:
    """(table, value) of the rows of a dump whose meta_key is the marker, of every table with meta_key and meta_value.

    A dump is read a line at a time, and a line a value at a time. Columns come from the table's definition; rows that
    have other than as many values are an error.
    """
    columns: dict[str, list[str]] = {}
    creating = None
    for line in lines:
        if m := _CREATE.match(line):
            creating = m[1]
            columns[creating] = []
        elif creating is not None and (m := _COLUMN.match(line)):
            columns[creating].append(m[1])
        elif creating is not None and line.startswith(")"):
            creating = None
        elif m := _INSERT.match(line):
            names = columns.get(m[1], [])
            if "meta_key" not in names or "meta_value" not in names:
                continue
            key, value = names.index("meta_key"), names.index("meta_value")
            row: list[str | None] = []
            at = m.end()
            while at < len(line):
                c = line[at]
                if c in "(, ":
                    at += 1
                elif c == ")":
                    if len(row) != len(names):
                        raise ValueError(f"{m[1]}: a row of {len(row)} values")
                    if row[key] == marker and row[value] is not None:
                        yield m[1], row[value]
                    row = []
                    at += 1
                elif c == ";":
                    break
                elif v := _VALUE.match(line, at):
                    row.append(_plain(v[1]) if v[1] is not None else None if v[2] == "NULL" else v[2])
                    at = v.end()
                else:
                    raise ValueError(f"{m[1]}: a value does not read")


def attached_files(dumps: DataFrame, marker: str = "_wp_attached_file") -> DataFrame:
    """path, table_name, file, problem: files that a dump's rows name as attachments; dumps as (path, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                try:
                    rows += [(path.as_py(), table, value, None) for table, value in marked_values(iter((text.as_py() or "").split("\n")), marker)]
                except ValueError as e:
                    rows.append((path.as_py(), None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["path", "table_name", "file", "problem"])

    return dumps.select("path", "text").mapInArrow(read, "path string, table_name string, file string, problem string")


def absent_attachments(named: DataFrame, stored: DataFrame, folder: Sequence[str] = ("wp-content", "uploads")) -> DataFrame:
    """file of the attachments that are named and not stored below the folder; named: file, stored: path."""
    place = F.concat(F.lit("/".join(folder) + "/"), F.col("file"))
    return named.filter("file IS NOT NULL").select("file").distinct().join(stored.select("path").distinct(), place == F.col("path"), "left_anti")
