"""Profiles of a snapshot: row counts, freshness, digests, shapes and sizes of its tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.digest import rendered, stamp

FRESHNESS_COLUMNS = ("updated_at", "modified_at", "created_at")
SMALL = 10_000


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, row_count of each table; empty tables count 0. Parquet answers from its footers."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()])


def estimated_counts(tables: Mapping[str, DataFrame], small: int = SMALL) -> DataFrame:
    """table_name, row_count, exact: the planner's estimate where it is known and not small, else the count."""
    parts = []
    for name, df in tables.items():
        known = df._jdf.queryExecution().optimizedPlan().stats().rowCount()
        if known.isDefined() and known.get().longValue() >= small:
            one = df.sparkSession.range(1).select(F.lit(known.get().longValue()).cast("long").alias("row_count"))
            parts.append(one.select(F.lit(name).alias("table_name"), "row_count", F.lit(False).alias("exact")))
        else:
            parts.append(row_counts({name: df}).withColumn("exact", F.lit(True)))
    return _union(parts)


def freshness_column(schema: T.StructType, candidates: Sequence[str] = FRESHNESS_COLUMNS) -> str | None:
    """The first candidate that the table has as a timestamp."""
    kinds = {f.name: f.dataType for f in schema}
    return next((c for c in candidates if isinstance(kinds.get(c), (T.TimestampType, T.TimestampNTZType))), None)


def freshness(tables: Mapping[str, DataFrame], candidates: Sequence[str] = FRESHNESS_COLUMNS) -> DataFrame:
    """table_name, freshness_column, freshness_max of each table with such a column; `no rows` where it has no value."""
    found = [(n, df, c) for n, df in tables.items() if (c := freshness_column(df.schema, candidates))]
    return _union([df.agg(F.coalesce(stamp(F.max(c)), F.lit("no rows")).alias("freshness_max")).select(F.lit(n).alias("table_name"), F.lit(c).alias("freshness_column"), "freshness_max") for n, df, c in found])


def sample_digest(df: DataFrame, key: Sequence[str], columns: Sequence[str], rows: int = 100) -> Column | DataFrame:
    """sample_hash: SHA-256 of the first rows by key, tab-separated lines; the limit is the feature."""
    first = df.orderBy(*key).limit(rows).select(*key, F.concat(F.concat_ws("\t", *[rendered(F.col(c), df.schema[c].dataType) for c in columns]), F.lit("\n")).alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*key, "line"))), lambda x: x["line"])
    return first.agg(F.sha2(F.concat_ws("", lines), 256).alias("sample_hash"))


def column_rows(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None) -> list[tuple]:
    """(table, place, column, type, not_null, primary_key) of every column."""
    keys = keys or {}
    return [(n, i, f.name, f.dataType.simpleString(), not f.nullable, f.name in keys.get(n, ())) for n, df in tables.items() for i, f in enumerate(df.schema)]


def columns_digest(columns: DataFrame) -> DataFrame:
    """table_name, columns_hash of (table_name, place, name, type, not_null, primary_key); no columns give the empty text."""
    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    line = F.concat("name", F.lit("\0"), "type", F.lit("\0"), flag("not_null"), F.lit("\0"), flag("primary_key"), F.lit("\n"))
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]))
    return columns.groupBy("table_name").agg(F.when(F.count("name") == 0, "").otherwise(F.sha2(body, 256)).alias("columns_hash"))


def definition_digest(columns: DataFrame) -> DataFrame:
    """table_name, definition_hash: MD5 over the ordered definitions of the columns."""
    line = F.concat_ws(" ", "name", "type", F.when(F.col("not_null"), "not null"))
    return columns.groupBy("table_name").agg(F.md5(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("d")))), lambda x: x["d"]))).alias("definition_hash"))


def extension(path: Column) -> Column:
    """Lower-case suffix from the last dot of the path's last element, or `(no extension)`."""
    found = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(found == "", "(no extension)").otherwise(found)


def extension_histogram(files: DataFrame, path: str = "path", size: str = "size", top: int = 10) -> DataFrame:
    """extension, files, bytes of the `top` extensions by bytes, ties by name; unknown sizes count 0."""
    named = files.filter(F.col(path).isNotNull()).groupBy(extension(F.col(path)).alias("extension"))
    return named.agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("bytes")).orderBy(F.desc("bytes"), "extension").limit(top)


def json_shape(rows: DataFrame, column: str, order: str, cap: int = 500) -> DataFrame:
    """field, place, count, type (or `mixed`), not_null of the top-level fields of JSON objects.

    Fields come in first-seen order, by `order`; not_null means that every object has the field. Unreadable and null
    texts are no objects. At most `cap` fields, the first seen.
    """
    value = F.from_json(F.col(column), "map<string,variant>")
    each = rows.select(F.col(order).alias("at"), F.explode(value).alias("field", "v")).withColumn("kind", F.schema_of_variant("v"))
    docs = rows.select(F.count(value).alias("docs"))
    found = each.groupBy("field").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"), F.min("kind").alias("a"), F.max("kind").alias("b"))
    shaped = found.orderBy("first", "field").limit(cap).crossJoin(F.broadcast(docs))  # one row of totals
    return shaped.select("field", "count", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("type"), (F.col("count") == F.col("docs")).alias("not_null"))


def conflicts(rows: DataFrame, name: str, digest: str) -> DataFrame:
    """Names stored with more than one content: name, versions, rows."""
    grouped = rows.filter(F.col(name).isNotNull() & F.col(digest).isNotNull()).groupBy(name, digest).agg(F.count(F.lit(1)).alias("n"))
    return grouped.groupBy(name).agg(F.count(F.lit(1)).alias("versions"), F.sum("n").alias("rows")).filter("versions > 1")
