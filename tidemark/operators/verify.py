"""Verification: recorded manifests against restored data, expectations against values, digests of the outcome."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$|^(?i:nan)$"
OPERATORS = (">=", "<=", "!=", ">", "<", "=")


def parse_expectation(text: str) -> tuple[str, str]:
    """(operator, value) of an expected text such as `>= 10`; refuses an operator without a value and an order on text."""
    text = text.strip()
    op = next((o for o in OPERATORS if text.startswith(o)), "")
    value = text[len(op) :].strip()
    if not value:
        raise ValueError(f"no value in the expectation {text!r}")
    if op in (">", "<", ">=", "<=") and not re.match(NUMBER, value):
        raise ValueError(f"an order needs a number: {text!r}")
    return op or "=", value


def holds(expect: Column, actual: Column) -> Column:
    """Whether a value meets its expectation, both as text.

    Numbers compare as numbers if both sides are, and what is not a number equals nothing; otherwise `=` and `!=` compare text, t and f standing for true and
    false, and an order does not hold. A null value is the text NULL.
    """
    op = F.regexp_extract(F.trim(expect), r"^(>=|<=|!=|>|<|=)?", 1)
    wanted = F.trim(F.regexp_replace(F.trim(expect), r"^(>=|<=|!=|>|<|=)", ""))
    value = F.trim(F.coalesce(actual, F.lit("NULL")))
    number = lambda c: F.when(c.rlike(NUMBER), c.try_cast("double"))
    a, b = number(value), number(wanted)
    numeric = F.when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b).when(op == "!=", a != b).otherwise(a == b)
    numeric = F.when(F.isnan(a) | F.isnan(b), op == "!=").otherwise(numeric)
    word = lambda c: F.when(c == "t", "true").when(c == "f", "false").otherwise(c)
    text = F.when(op == "!=", word(value) != word(wanted)).when(op.isin("", "="), word(value) == word(wanted)).otherwise(False)
    return F.when(a.isNotNull() & b.isNotNull(), numeric).otherwise(text)


def result(passed: Column, not_run: Column) -> Column:
    """passed, failed or not_run; a check that did not run does not count against the whole."""
    return F.when(F.coalesce(not_run, F.lit(False)), "not_run").when(passed, "passed").otherwise("failed")


def manifest_assertions(manifest: DataFrame, restored: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, name, passed, expected, actual: row counts of recorded tables against restored ones.

    A recorded table that was not restored fails as `table existence`; a null count is the text NULL.
    """
    there = restored.select(*on, F.col("row_count").alias("found"), F.lit(True).alias("there"))
    joined = manifest.select(*on, "row_count").join(there, list(on), "left")
    missing = F.col("there").isNull()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    return joined.select(
        *on,
        F.when(missing, "table existence").otherwise("row count").alias("name"),
        F.coalesce(~missing & F.col("row_count").eqNullSafe(F.col("found")), F.lit(False)).alias("passed"),
        F.when(missing, "present").otherwise(text("row_count")).alias("expected"),
        F.when(missing, "missing").otherwise(text("found")).alias("actual"),
    )


def table_union(archive: DataFrame, manifest: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, in_archive, in_manifest over the union of both sets of tables."""
    a = archive.select(*on).distinct().withColumn("in_archive", F.lit(True))
    b = manifest.select(*on).distinct().withColumn("in_manifest", F.lit(True))
    both = a.join(b, list(on), "full")
    return both.select(*on, F.coalesce("in_archive", F.lit(False)).alias("in_archive"), F.coalesce("in_manifest", F.lit(False)).alias("in_manifest"))


def freshness_assertions(recorded: DataFrame, restored: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, passed, expected, actual of tables with a recorded newest row; others give no assertion."""
    joined = recorded.filter(F.col("freshness_max").isNotNull() & (F.col("freshness_max") != "")).join(restored.select(*on, F.col("freshness_max").alias("found")), list(on))
    actual = F.when(F.coalesce(F.col("found"), F.lit("")) == "", "no rows").otherwise(F.col("found"))
    return joined.select(*on, (F.col("freshness_max") == actual).alias("passed"), F.col("freshness_max").alias("expected"), actual.alias("actual"))


def listed_files(listed: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, problem: files of a manifest that are missing, differ by size or hash (hex without case), or are unlisted.

    Both sides hold key, size and sha256; a key that a side holds twice with different contents is `duplicate`.
    """
    one = lambda df, side: df.groupBy(*key).agg(F.max("size").alias(f"{side}_size"), F.max(F.lower("sha256")).alias(f"{side}_sha"), F.count_distinct("size", F.coalesce(F.lower("sha256"), F.lit(""))).alias(f"{side}_n"), F.lit(True).alias(side))
    joined = one(listed, "l").join(one(seen, "s"), list(key), "full")
    problem = F.when(F.col("l").isNull(), "unlisted").when(F.col("s").isNull(), "missing").when((F.col("l_n") > 1) | (F.col("s_n") > 1), "duplicate").when(~F.col("l_size").eqNullSafe(F.col("s_size")), "size").when(~F.col("l_sha").eqNullSafe(F.col("s_sha")), "sha256")
    return joined.select(*key, problem.alias("problem")).filter("problem IS NOT NULL")


def checks_digest(checks: DataFrame, group: Sequence[str], order: str, kind: str | None = None, with_not_run: bool = False) -> DataFrame:
    """group, checks, digest: SHA-256 of `name|passed|expected|actual` lines in order; no checks give the empty text."""
    from tidemark.functions.digest import listed_digest

    flag = lambda c: F.when(F.col(c), "true").otherwise("false")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = [text("name"), flag("passed"), *([flag("not_run")] if with_not_run else []), text("expected"), text("actual")]
    rows = checks.filter(F.col("kind") == kind) if kind else checks
    line = F.concat(F.concat_ws("|", *parts), F.lit("\n"))
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("checks"), listed_digest(line, F.col(order), F.col("name")).alias("digest"))


def certificate_chain(records: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Records with `linked`: whether prev_hash is the certificate_hash of the record before; the first must have none."""
    from pyspark.sql import Window

    before = F.lag("certificate_hash").over(Window.partitionBy(*group).orderBy(*order))
    return records.withColumn("linked", F.coalesce(F.col("prev_hash"), F.lit("")) == F.coalesce(before, F.lit("")))


def first_names(names: Column, most: int = 5) -> Column:
    """The first names in order, and how many more there are."""
    ordered = F.array_sort(names)
    head = F.concat_ws(", ", F.slice(ordered, 1, most))
    return F.when(F.size(names) > most, F.concat(head, F.lit(" and "), (F.size(names) - most).cast("string"), F.lit(" more"))).otherwise(head)


def read_every_row(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, rows, cells: every column of every row of each table is read, which is the nearest to an engine's own
    check of its pages; a file that does not read fails the query. cells counts the values that are there."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows"), sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0)).cast("long").alias("cells")).select(F.lit(name).alias("table_name"), "rows", "cells") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
