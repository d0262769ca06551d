"""Pass-through of a user's SQL: Spark's own semantics over the views of a snapshot, read-only."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_WORDS = re.compile(r"(?is)^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with|values|table)\b")


def run(spark: SparkSession, query: str, views: Mapping[str, DataFrame]) -> DataFrame:
    """The result of one SELECT, WITH, VALUES or TABLE statement over the named views; anything else is refused."""
    if not _WORDS.match(query):
        raise ValueError("only queries that read are run")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query)


def matching(df: DataFrame, predicate: str) -> DataFrame:
    """Rows that a user's predicate chooses; choosing none is an error, found by one short job."""
    found = df.filter(predicate)
    if found.isEmpty():
        raise ValueError("no row matches the predicate")
    return found


def first_value(spark: SparkSession, query: str, views: Mapping[str, DataFrame]) -> str | None:
    """The first column of the first row, as text; no row is an error."""
    row = run(spark, query, views).limit(1).collect()
    if not row:
        raise ValueError("the query gave no row")
    return None if row[0][0] is None else str(row[0][0])


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, nulls as empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').csv(folder)
