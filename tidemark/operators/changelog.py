"""What a change log says must be read again, and erasures that must be replayed after a restore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKEW_HOURS = 1


def parse_snapshot(text: Column) -> Column:
    """`xmin:xmax:xip` as struct(xmin, xmax, xip)."""
    parts = F.split(text, ":")
    ids = F.transform(F.filter(F.split(F.get(parts, F.lit(2)), ","), lambda x: x != ""), lambda x: x.cast("long"))
    return F.when(text.rlike(r"^\d+:\d+:[\d,]*$"), F.struct(F.get(parts, F.lit(0)).cast("long").alias("xmin"), F.get(parts, F.lit(1)).cast("long").alias("xmax"), ids.alias("xip")))


def visible_after(xid: Column, snapshot: Column) -> Column:
    """Whether a transaction was not yet seen by a snapshot."""
    return (xid >= snapshot["xmax"]) | ((xid >= snapshot["xmin"]) & F.array_contains(snapshot["xip"], xid))


def replays(xid: Column, at: Column, snapshot: Column, started: Column) -> Column:
    """Whether an erasure must be replayed on a backup: it is surely later, or the backup's snapshot did not see it.

    Without a snapshot, from an hour before the backup's start on.
    """
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hour = F.lit(SKEW_HOURS * 3_600_000_000).cast("long")
    later = micros(at) > micros(started) + hour
    return F.when(snapshot.isNull(), micros(at) >= micros(started) - hour).otherwise(later | F.coalesce(visible_after(xid, snapshot), F.lit(False)))


def replay_erasures(table: DataFrame, erasures: DataFrame, rel: str, key: Sequence[str]) -> DataFrame:
    """The table without the rows that erasures of `rel` name; erasures hold rel and a map from key column to text."""
    named = erasures.filter((F.col("rel") == rel) & (F.size(F.map_keys("key")) == len(key))).select(*[F.col("key")[k].alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    on = [table[k].cast("string") == named[f"_k{i}"] for i, k in enumerate(key)]
    return table.join(named, on, "left_anti")


def erasure_counts(erasures: DataFrame, tables: Sequence[str]) -> DataFrame:
    """rel, erasures, present: how many erasures name each relation and whether it was restored."""
    return erasures.groupBy("rel").agg(F.count(F.lit(1)).alias("erasures")).withColumn("present", F.col("rel").isin(list(tables)))


def descendants(edges: DataFrame, roots: DataFrame, depth: int = 4096) -> DataFrame:
    """name, of roots and all that inherit from them, each once; edges: parent, child.

    Each step follows the edges from what was new in the step before, so a cycle ends by itself and a chain may be as long
    as `depth`, beyond which it is an error. Every step is one job, checkpointed.
    """
    from tidemark.session import checkpointed

    new = seen = checkpointed(roots.select("name").filter("name IS NOT NULL").distinct())
    for _ in range(depth + 1):
        below = edges.join(new, F.col("parent") == F.col("name")).select(F.col("child").alias("name")).filter("name IS NOT NULL").distinct()
        new = checkpointed(below.join(seen, "name", "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(new))
    raise ValueError(f"a chain of more than {depth}")


def carried(tables: DataFrame, refusals: dict[str, Column]) -> DataFrame:
    """Tables with `carry` and `reason`: a table is carried forward unread if none of the refusals holds."""
    from tidemark.operators.retention import first_reason

    reason = first_reason(refusals, "")
    return tables.withColumns({"reason": reason, "carry": reason == ""})


def collectable(changes: DataFrame, consumers: DataFrame, xid: str = "xid", seen: str = "snapshot") -> DataFrame:
    """Changes that every consumer's snapshot has seen; without consumers, all.

    A change must be older than every snapshot's end, of which the least is one row, and must not have been under way
    in any, which an anti-join asks of their ids however many consumers there are. A snapshot that does not read has seen nothing.
    """
    snaps = consumers.select(parse_snapshot(F.col(seen)).alias("s"))
    unread = F.coalesce(F.max(F.col("s").isNull()), F.lit(False))
    least = snaps.agg(F.when(unread, -1).otherwise(F.min("s.xmax")).alias("_least"))
    under_way = snaps.select(F.col("s.xmin").alias("_xmin"), F.explode("s.xip").alias("_xip")).filter("_xip >= _xmin").select("_xip").distinct()
    older = changes.crossJoin(F.broadcast(least)).filter(F.col("_least").isNull() | (F.col(xid) < F.col("_least"))).drop("_least")  # one row
    return older.join(under_way, F.col(xid) == F.col("_xip"), "left_anti")


def key_json(key: Sequence[str]) -> Column:
    """A row's key as a JSON object of texts."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in key]))
