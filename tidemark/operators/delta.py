"""Deltas between two states, keyed upserts, and consistency of references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def added(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return new.join(old.select(*key), list(key), "left_anti")


def deleted(old: DataFrame, new: DataFrame, key: Sequence[str], zeroed: Sequence[str] = ()) -> DataFrame:
    """Rows of the old state without a key in the new one; `zeroed` columns come out as 0."""
    gone = old.join(new.select(*key), list(key), "left_anti")
    return gone.withColumns({c: F.lit(0).cast(gone.schema[c].dataType) for c in zeroed})


def changed(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """New rows whose key is in both states and in which one of `fields` differs, null-safely; other columns do not count."""
    before = old.select(*key, *[F.col(f).alias(f"_old_{f}") for f in fields])
    both = new.join(before, list(key))
    differs = [~F.col(f).eqNullSafe(F.col(f"_old_{f}")) for f in fields]
    return both.filter(F.array_contains(F.array(*differs), True)).drop(*[f"_old_{f}" for f in fields])


def states_differ(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str], exempt: Column | None = None) -> DataFrame:
    """key, problem: only_left, only_right or the first field that differs; `exempt` rows skip the comparison of fields."""
    a = left.select(*key, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("l"))
    b = right.select(*key, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("r"))
    both = a.join(b, list(key), "full")
    spared = exempt if exempt is not None else F.lit(False)
    problem = F.when(F.col("r").isNull(), "only_left").when(F.col("l").isNull(), "only_right")
    for f in fields:
        problem = problem.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")) & ~spared, f)
    return both.select(*key, problem.alias("problem")).filter("problem IS NOT NULL")


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], overwrite: bool) -> DataFrame:
    """The target with the source's rows: new keys inserted, existing ones kept unless `overwrite`. Both sides have one
    row a key and the same columns; keys must not be null."""
    if not key:
        raise ValueError("rows can be restored by key only")
    rest = [c for c in target.columns if c not in key]
    t = target.select(*key, F.struct(*rest).alias("t"))
    s = source.select(*key, F.struct(*rest).alias("s"))
    first, second = ("s", "t") if overwrite else ("t", "s")
    row = F.coalesce(first, second)
    return t.join(s, list(key), "full").select(*key, *[row[c].alias(c) for c in rest])


def upsert_outcome(target: DataFrame, source: DataFrame, key: Sequence[str], overwrite: bool) -> DataFrame:
    """matched, inserted, updated, kept: what upsert would do."""
    there = source.select(*key).join(target.select(*key, F.lit(True).alias("there")), list(key), "left")
    matched = F.count("there")
    return there.agg(matched.alias("matched"), (F.count(F.lit(1)) - matched).alias("inserted"), (matched if overwrite else F.lit(0).cast("long")).alias("updated"), (F.lit(0).cast("long") if overwrite else matched).alias("kept"))


def renamed(old: DataFrame, new: DataFrame, path: str, digest: str) -> DataFrame:
    """path, digest, from_path: new paths whose content an old path that is gone already held; the least such path."""
    fresh = added(old, new, [path]).filter(F.col(digest).isNotNull())
    gone = deleted(old, new, [path]).groupBy(digest).agg(F.min(path).alias("from_path"))
    return fresh.join(gone, digest).select(path, digest, "from_path")


def exact_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that either side has more often than the other, with `side`."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
