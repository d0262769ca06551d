"""References to records that do not exist, are deleted, or came later than the reference.

Parents and references are partitioned together by ranges of their keys' hash, whose bounds are known without a look at
the data. In a range the parents come first, as one sorted array; the references then stream past in batches, each probed
by one vectorised binary search, and only misses leave the range. A key that many rows refer to is salted: its references
spread over several ranges and its parent, one row by then, is repeated in each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import hex_id, packed_hex, unpacked_hex
from tidemark.session import parallelism, scan_tasks

LONGEST = 128
#: Keys with fewer references than this are never salted.
HOT_ROWS = 50_000
REASONS = ("missing", "deleted", "late")


def _range_key(c: Column) -> Column:
    """At most LONGEST bytes and never ending in a zero byte, which fixed-width arrays would drop."""
    packed = packed_hex(c)
    short = F.when(F.length(packed) < LONGEST, packed).otherwise(F.concat(F.lit(b"\x02"), F.unhex(F.sha2(c, 256))))
    return F.concat(short, F.lit(b"\x01"))


def _fixed(column: pa.Array) -> np.ndarray:
    """Binary values as an array of fixed width, read from the column's buffers."""
    column = column.cast(pa.large_binary())
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    lengths = np.diff(edges)
    width = max(1, int(lengths.max(initial=1)))
    table = np.zeros((n, width), np.uint8)
    if n:
        data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        row = np.repeat(np.arange(n), lengths)
        table[row, np.arange(len(data)) - np.repeat(edges[:-1] - edges[0], lengths)] = data
    return table.view(f"S{width}").reshape(n)


def _probe(out_columns: Sequence[str]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        since: list[np.ndarray] = []
        gone: list[np.ndarray] = []
        parents: np.ndarray | None = None
        first = late = None
        for batch in batches:
            is_parent = pc.equal(batch.column("kind"), 0)
            own = batch.filter(is_parent)
            if own.num_rows:
                keys.append(_fixed(own.column("key")))
                since.append(np.asarray(own.column("at").fill_null(np.iinfo(np.int64).min)))
                gone.append(np.asarray(own.column("gone").fill_null(False)))
            refs = batch.filter(pc.invert(is_parent))
            if not refs.num_rows:
                continue
            if parents is None:
                parents = np.concatenate(keys) if keys else np.empty(0, "S1")
                first = np.concatenate(since) if since else np.empty(0, np.int64)
                late = np.concatenate(gone) if gone else np.empty(0, bool)
            wanted = _fixed(refs.column("key"))
            reason = np.zeros(len(wanted), np.int8)
            if len(parents):
                at = np.minimum(np.searchsorted(parents, wanted), len(parents) - 1)
                there = parents[at] == wanted
                when = np.asarray(refs.column("at").fill_null(np.iinfo(np.int64).max))
                reason = np.where(there, np.where(late[at], 1, np.where(first[at] > when, 2, -1)), 0).astype(np.int8)
            miss = np.flatnonzero(reason >= 0)
            if len(miss):
                found = refs.take(pa.array(miss))
                yield pa.RecordBatch.from_arrays([*[found.column(c) for c in out_columns], pa.array(np.array(REASONS, dtype=object)[reason[miss]], pa.string())], names=[*out_columns, "reason"])

    return probe


def orphan_references(refs: DataFrame, ref_id: str, ref_at: str, keep: Sequence[str], parents: DataFrame, parent_id: str, parent_at: str, deleted_at: str | None = None) -> DataFrame:
    """keep, missing_id, reason (missing, deleted, late) of every reference without a parent in good standing.

    Ids match without case and surrounding blanks; null and empty ids refer to nothing and are no parents. A parent is
    deleted if each of its rows has deleted_at, else late if its earliest time is after the reference's; an unknown
    time is never late. Without parents every reference is missing. Repeated rows come out once. One job over the ids of
    the references finds the hot ones while the plan is made.
    """
    spark = refs.sparkSession
    ids = hex_id(F.col(ref_id))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    names = [f"r{i}" for i in range(len(keep))]
    child = refs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], ids.alias("id"), micros(ref_at).alias("at")).filter("id IS NOT NULL")
    child = child.select(*names, _range_key(F.col("id")).alias("key"), F.when(F.length(packed_hex(F.col("id"))) >= LONGEST, F.col("id")).alias("long_id"), "at")
    gone = F.col(deleted_at).isNotNull() if deleted_at else F.lit(False)
    known = parents.select(hex_id(F.col(parent_id)).alias("id"), micros(parent_at).alias("at"), gone.alias("gone")).filter("id IS NOT NULL")
    known = known.groupBy(_range_key(F.col("id")).alias("key")).agg(F.min("at").alias("at"), F.bool_and("gone").alias("gone"))

    ways = min(parallelism(spark), scan_tasks(child))
    salts = _hot_keys(child, ways)
    if salts:
        # at most 4 rows a range, see _hot_keys
        many = F.broadcast(spark.createDataFrame(list(salts.items()), "hot string, many int"))
        salted = lambda d: d.join(many, F.hex("key") == F.col("hot"), "left").drop("hot")
        child = salted(child).withColumn("salt", F.pmod(F.xxhash64(*names, "at"), F.coalesce("many", F.lit(1))).cast("int")).drop("many")
        known = salted(known).withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("many", F.lit(1)) - 1))).drop("many")
    else:
        child, known = child.withColumn("salt", F.lit(0)), known.withColumn("salt", F.lit(0))
    both = known.withColumn("kind", F.lit(0)).unionByName(child.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # the upper 31 bits of the hash, cut into `ways` ranges of the same width; salts go to the ranges that follow
    part = F.shiftright(F.shiftrightunsigned(F.xxhash64("key"), 33) * ways, 31)
    ranged = both.repartitionById(ways, F.pmod(part + F.col("salt"), ways).cast("int")).sortWithinPartitions("kind", F.when(F.col("kind") == 0, F.col("key")))
    columns = [*names, "key", "long_id"]
    schema = T.StructType([ranged.schema[c] for c in columns] + [T.StructField("reason", T.StringType())])
    found = ranged.select("kind", "at", "gone", *columns).mapInArrow(_probe(columns), schema)
    text = F.coalesce("long_id", unpacked_hex(F.expr("substring(key, 1, length(key) - 1)")))
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], text.alias("missing_id"), "reason").distinct()


def _hot_keys(child: DataFrame, ways: int) -> dict[str, int]:
    """Salts of the keys that hold more than a quarter of an even share of the references, of which there are fewer than
    4 `ways`: mergeable sketches of frequent keys, combined in two steps, name them all."""
    items = 4 * ways
    tracked = min(16 * items, 1_000_000)
    first = child.groupBy(F.pmod(F.spark_partition_id(), F.lit(64))).agg(F.expr(f"approx_top_k_accumulate(hex(key), {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n"))
    combined = first.groupBy(F.col("n") < 0).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {items})").alias("top"), F.sum("n").alias("n"))
    top = combined.first()
    if top is None:
        return {}
    share = top["n"] / ways
    return {r["item"]: min(ways, 1 + math.ceil(r["count"] / share * 2)) for r in top["top"] if r["count"] > max(share / 4, HOT_ROWS)}


def repository_orphans(packs: DataFrame, blobs: DataFrame, files: DataFrame, month: bool = False) -> DataFrame:
    """(referrer, epoch_id, row_key, missing_id, reason): blobs that name a pack and files that name blobs without any.

    With `month` the first day of the month of the referring row is added.
    """
    at = (lambda c: [F.trunc(F.col(c), "month").alias("month")]) if month else (lambda c: [])
    extra = ["month"] if month else []
    stored = blobs.select(F.lit("blobs").alias("referrer"), "epoch_id", hex_id(F.col("id")).alias("row_key"), "pack_id", "indexed_at", *at("indexed_at"))
    named = files.select(F.lit("files").alias("referrer"), "epoch_id", F.col("path").alias("row_key"), F.explode("blobs").alias("blob_id"), "seen_at", *at("seen_at"))
    keep = ["referrer", "epoch_id", "row_key", *extra]
    to_packs = orphan_references(stored, "pack_id", "indexed_at", keep, packs, "id", "uploaded_at", "deleted_at")
    to_blobs = orphan_references(named, "blob_id", "seen_at", keep, blobs, "id", "indexed_at")
    return to_packs.unionByName(to_blobs)


def orphans_by_month(packs: DataFrame, blobs: DataFrame, files: DataFrame) -> DataFrame:
    """(referrer, month, reason, misses): orphan references per table and month of the referring row."""
    found = repository_orphans(packs, blobs, files, month=True)
    return found.groupBy("referrer", F.date_format("month", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("misses"))
