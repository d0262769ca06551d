"""Change logs: continuity, recovery windows, as-of bases, transactions and point-in-time state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], take: Column, bucket: Column | None = None) -> DataFrame:
    """Rows with `_before`: `take` of the row before in the order of `by`, null of the first.

    bucket: an expression that rises with the order. Keys with very many rows are then cut into buckets, each a sort of
    its own; what a bucket begins with is the last row of the buckets before it, one row a bucket.
    """
    if bucket is None:
        return rows.withColumn("_before", F.lag(take).over(Window.partitionBy(*by).orderBy(*order)))
    cut = rows.withColumn("_bucket", bucket)
    edges = cut.groupBy(*by, "_bucket").agg(F.max_by(take, F.struct(*order)).alias("_last"))
    edges = edges.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket"))).drop("_last")
    w = Window.partitionBy(*by, "_bucket").orderBy(*order)
    within = cut.withColumns({"_place": F.row_number().over(w), "_within": F.lag(take).over(w)})
    edges = edges.select(*[F.col(b).alias(f"_e{i}") for i, b in enumerate(by)], F.col("_bucket").alias("_eb"), "_carry")
    on = [F.col(b).eqNullSafe(F.col(f"_e{i}")) for i, b in enumerate(by)] + [F.col("_bucket").eqNullSafe(F.col("_eb"))]
    joined = within.join(edges, on).withColumn("_before", F.when(F.col("_place") == 1, F.col("_carry")).otherwise(F.col("_within")))
    return joined.select(*rows.columns, "_before")


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """Rows with the sum of a value up to and with each, in the order of `by`; in buckets as in with_before."""
    if bucket is None:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = rows.withColumns({"_bucket": bucket, "_value": value})
    sums = cut.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    up = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(b).alias(f"_e{i}") for i, b in enumerate(by)], F.col("_bucket").alias("_eb"), F.coalesce(F.sum("_sum").over(up), F.lit(0)).alias("_carry"))
    on = [F.col(b).eqNullSafe(F.col(f"_e{i}")) for i, b in enumerate(by)] + [F.col("_bucket").eqNullSafe(F.col("_eb"))]
    w = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("_within", F.sum("_value").over(w)).join(sums, on).withColumn(name, F.col("_carry") + F.col("_within")).select(*rows.columns, name)


def stream_runs(segments: DataFrame, stream: Sequence[str], file: str, start: str, end: str, rotates: str, first_offset: int = 4, tie: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Segments with `run`, from 1, and `gap`: whether the segment does not follow on from the one before it.

    It follows if it starts where the one before ended in the same file, or at the first offset of the next file after
    one that rotates. Segments go by (file, start, end); those that repeat the end of the one before follow on too.
    bucket: as in with_before, such as blocks of files, for streams of very many segments.
    """
    order = [file, start, end, *tie]
    rows = with_before(segments, stream, order, F.struct(F.col(file).alias("f"), F.col(end).alias("e"), F.col(rotates).alias("r")), bucket)
    before = F.col("_before")
    follows = ((before["f"] == F.col(file)) & (before["e"] == F.col(start))) | (F.coalesce(before["r"], F.lit(False)) & (before["f"] + 1 == F.col(file)) & (F.col(start) == first_offset))
    marked = rows.withColumn("gap", before.isNotNull() & ~F.coalesce(follows, F.lit(False))).drop("_before")
    return running_sum(marked, stream, order, F.col("gap").cast("int"), "run", bucket).withColumn("run", 1 + F.col("run"))


def first_gap(segments: DataFrame, stream: Sequence[str], file: str, start: str, end: str, rotates: str, at_file: int, at: int, first_offset: int = 4) -> DataFrame:
    """Segments of each stream from a position on, with `in_run` and `is_gap` for the first that breaks the run.

    The run starts with the segment that begins at the position or holds it; without one nothing is in a run.
    """
    from_here = segments.filter((F.col(file) > at_file) | ((F.col(file) == at_file) & (F.col(end) >= at) & (F.col(start) >= at)) | ((F.col(file) == at_file) & (F.col(start) <= at) & (F.col(end) > at)))
    runs = stream_runs(from_here, stream, file, start, end, rotates, first_offset)
    w = Window.partitionBy(*stream)
    holds = F.max(((F.col(file) == at_file) & (F.col(start) <= at)).cast("int")).over(w) == 1
    gap_order = Window.partitionBy(*stream).orderBy(file, start, end)
    return runs.withColumns({"in_run": holds & (F.col("run") == 1), "is_gap": F.when(holds, F.col("gap") & (F.sum(F.col("gap").cast("int")).over(gap_order) == 1)).otherwise(F.row_number().over(gap_order) == 1)})


def missing_numbers(segments: DataFrame, series: Sequence[str], number: str) -> DataFrame:
    """series, first_missing, last_missing of each hole in a series of numbers; no numbers, no holes."""
    w = Window.partitionBy(*series).orderBy(number)
    rows = segments.filter(F.col(number).isNotNull()).select(*series, number).distinct().withColumn("_next", F.lead(number).over(w))
    return rows.filter(F.col("_next") > F.col(number) + 1).select(*series, (F.col(number) + 1).alias("first_missing"), (F.col("_next") - 1).alias("last_missing"))


def recovery_window(bases: DataFrame, segments: DataFrame, series: Sequence[str]) -> DataFrame:
    """series, base_id, reach, usable of each base: the last segment up to which it can be replayed without a hole.

    bases: series, base_id, first_seg, end_seg. segments: series, seg. A base is usable if its segments reach end_seg.
    Runs of consecutive segments are formed once; each base then finds the run that holds its first segment by an as-of
    step in one sorted pass, not by a join on ranges.
    """
    w = Window.partitionBy(*series).orderBy("seg")
    one = segments.select(*series, F.col("seg").cast("long").alias("seg")).filter("seg IS NOT NULL").distinct()
    runs = one.withColumn("_run", F.col("seg") - F.row_number().over(w)).groupBy(*series, "_run").agg(F.min("seg").alias("at"), F.max("seg").alias("until")).drop("_run")
    found = as_of(bases.withColumn("at", F.col("first_seg").cast("long")), runs, series, "at", "at", ["until"])
    reach = F.when(F.col("until") >= F.col("first_seg"), F.col("until"))
    return found.select(*series, "base_id", reach.alias("reach"), F.coalesce(reach >= F.col("end_seg"), F.lit(False)).alias("usable"))


def windows(reaches: DataFrame, bases: DataFrame, series: Sequence[str]) -> DataFrame:
    """series, base_id, window_end: of the usable bases the one that reaches farthest, the earliest of those."""
    usable = reaches.filter("usable").join(bases.select(*series, "base_id", "first_seg"), [*series, "base_id"])
    best = usable.groupBy(*series).agg(F.max(F.struct(F.col("reach"), (-F.col("first_seg")).alias("f"), F.col("base_id"))).alias("b"))
    return best.select(*series, F.col("b.base_id").alias("base_id"), F.col("b.reach").alias("window_end"))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, take: Sequence[str], strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """Left rows with `take` of the newest right row of equal `by` at or before them, strictly before with `strict`.

    Both sides are united and sorted once by key and time, and the last right row is carried forward: one shuffle on the
    key, no pairs. Of right rows at one time the greatest holds. Null times match nothing; rows without one keep nulls.

    bucket: a rising expression of the time, which is named `at_`. Keys with very many rows are then cut into buckets;
    what a bucket begins with is the last right row of the buckets before it, one row a bucket.
    """
    out = F.struct(*[F.col(c).alias(c) for c in take])
    names = left.columns
    kind = right.select(out.alias("x")).schema["x"].dataType
    l = left.select(*by, F.col(left_at).alias("at_"), F.struct(*[F.col(c) for c in names]).alias("_row"), F.lit(None).cast(kind).alias("_take"), F.lit(0 if strict else 1).alias("_side"))  # noqa: E741
    r = right.filter(F.col(right_at).isNotNull()).groupBy(*by, F.col(right_at).alias("at_")).agg(F.max(out).alias("_take"))
    r = r.select(*by, "at_", F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), "_take", F.lit(1 if strict else 0).alias("_side"))
    both = l.unionByName(r)
    if bucket is None:
        keys, carried = [*by], both.withColumn("_before", F.lit(None).cast(kind))
    else:
        keys, both = [*by, "_bucket"], both.withColumn("_bucket", bucket)
        ends = both.groupBy(*by, "_bucket").agg(F.max_by("_take", F.when(F.col("_take").isNotNull(), F.col("at_"))).alias("_end"))
        past = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*[F.col(k).alias(f"_e_{k}") for k in keys], F.last("_end", ignorenulls=True).over(past).alias("_before"))
        carried = both.join(ends, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys])
    w = Window.partitionBy(*keys).orderBy("at_", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = carried.withColumn("_found", F.coalesce(F.last("_take", ignorenulls=True).over(w), "_before")).filter("_row IS NOT NULL")
    kept = F.when(F.col("at_").isNotNull(), F.col("_found"))
    return found.select(*[F.col("_row")[c].alias(c) for c in names], *[kept[c].alias(c) for c in take])


def transactions(events: DataFrame, log: Sequence[str], order: Sequence[str], closes: Column, bucket: Column | None = None) -> DataFrame:
    """Events with `tx`, from 1: a closing event ends its transaction, the next event starts another.

    bucket: as in with_before, such as hours, for logs of very many events.
    """
    closing = F.coalesce(closes, F.lit(False)).cast("int")
    rows = running_sum(events.withColumn("_closes", closing), log, order, F.col("_closes"), "tx", bucket)
    return rows.withColumn("tx", 1 + F.col("tx") - F.col("_closes")).drop("_closes")


def transaction_times(grouped: DataFrame, log: Sequence[str], commit_at: str, header_at: str) -> DataFrame:
    """log, tx, events, at, exact: the commit's time if known, else the latest header second."""
    agg = grouped.groupBy(*log, "tx").agg(F.count(F.lit(1)).alias("events"), F.max(commit_at).alias("c"), F.max(header_at).alias("h"))
    return agg.select(*log, "tx", "events", F.coalesce("c", "h").alias("at"), F.col("c").isNotNull().alias("exact"))


def replays_by(at: Column, exact: Column, target: Column) -> Column:
    """Whether a transaction belongs before a target: a time known to the second only might be a second later."""
    late = F.timestamp_micros(F.unix_micros(at.cast("timestamp")) + 1_000_000)
    return F.when(exact, at <= target).otherwise(late <= target)


def own_transactions(events: DataFrame, tx: Sequence[str], own: Column) -> DataFrame:
    """Transactions with something of one's own: their own events and the framing ones, which `own` leaves null."""
    has = events.withColumn("_own", own).groupBy(*tx).agg(F.bool_or(F.coalesce("_own", F.lit(False))).alias("_any")).filter("_any").drop("_any")
    return events.filter(F.coalesce(own, F.lit(True))).join(has, list(tx), "left_semi")


def nested_own(operations: Column, namespace: str) -> Column:
    """The operations of an array whose `ns` is the database's own."""
    return F.filter(operations, lambda o: F.startswith(o["ns"], F.lit(namespace + ".")))


def state_at(base: DataFrame, log: DataFrame, key: Sequence[str], at: str, until: Column, deletes: Column, tie: str) -> DataFrame:
    """Rows as of a moment: of base and log up to it the last per key, without those deleted.

    base and log have the same columns; base rows come before all of the log.
    """
    rest = [c for c in base.columns if c not in key]
    row = F.struct(*rest)
    rows = base.select(*key, F.struct(F.lit(0).alias("s"), F.lit(None).cast(log.schema[at].dataType).alias("a"), F.lit(None).cast(log.schema[tie].dataType).alias("t")).alias("o"), row.alias("row"), F.lit(False).alias("gone"))
    rows = rows.unionByName(log.filter(F.col(at) <= until).select(*key, F.struct(F.lit(1).alias("s"), F.col(at).alias("a"), F.col(tie).alias("t")).alias("o"), row.alias("row"), F.coalesce(deletes, F.lit(False)).alias("gone")))
    last = rows.groupBy(*key).agg(F.max_by(F.struct("row", "gone"), "o").alias("last"))
    return last.filter(~F.col("last.gone")).select(*key, *[F.col("last.row")[c].alias(c) for c in rest])


def count_band(points: DataFrame, counted: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, low, high, counted, holds: counts between two that bracket a moment; a table that was not counted fails."""
    joined = points.join(counted.select(*on, "counted"), list(on), "left")
    low, high = F.least("before", "after"), F.greatest("before", "after")
    return joined.select(*on, low.alias("low"), high.alias("high"), "counted", F.coalesce(F.col("counted").between(low, high), F.lit(False)).alias("holds"))


def incremental_chain(bases: DataFrame) -> DataFrame:
    """base_id, status, chain_bytes: incremental bases joined to their full one; whole, missing_full or wrong_start.

    bases: base_id, full_id (null for a full base), start_at, full_start_at, bytes.
    """
    full = bases.filter("full_id IS NULL").select(F.col("base_id").alias("full_id"), F.col("start_at").alias("_start"), F.col("bytes").alias("_bytes"))
    joined = bases.join(full, "full_id", "left")
    status = F.when(F.col("full_id").isNull(), "full").when(F.col("_start").isNull(), "missing_full").when(~F.col("full_start_at").eqNullSafe(F.col("_start")), "wrong_start").otherwise("whole")
    return joined.select("base_id", status.alias("status"), (F.col("bytes") + F.coalesce("_bytes", F.lit(0))).alias("chain_bytes"))


def first_wins(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of several lists; of equal keys the row of the first list holds, then the least row."""
    from functools import reduce

    tagged = reduce(DataFrame.unionByName, [p.withColumn("_from", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in tagged.columns if c not in (*key, "_from")]
    best = tagged.groupBy(*key).agg(F.min(F.struct("_from", *rest)).alias("b"))
    return best.select(*key, *[F.col("b")[c].alias(c) for c in rest])
