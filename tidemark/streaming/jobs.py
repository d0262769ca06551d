"""Streams of log segments and events: pushes that must not conflict, positions and gaps, heartbeats, shipping, fan-out.

Every job runs alike as a batch of all there is (`availableNow`) and as a stream that goes on. Progress is the
checkpoint's; sinks are idempotent by key, so what is written twice after a failure counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.session import shared_folder


def folder(spark: SparkSession, name: str) -> str:
    """The name of a fresh folder below the shared one."""
    root = shared_folder(spark)
    return f"{root.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, directory: str, pattern: str, schema, most: int | None = None) -> DataFrame:
    """Parquet files of a directory as a stream, at most `most` of them a batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", most) if most else reader).parquet(directory)


def sliced_stream(df: DataFrame, name: str, order: str, slices: int = 4) -> DataFrame:
    """Rows as a stream of `slices` batches in rising order: written as one file after the other, read one a batch."""
    spark = df.sparkSession
    out = folder(spark, name + "-slices")
    low, high = df.agg(F.min(order), F.max(order)).first()
    part = F.lit(0) if low is None else F.least(F.floor((F.col(order) - low) * slices / (high - low + 1)), F.lit(slices - 1))
    for i in range(slices):
        df.filter(part == i).coalesce(1).write.parquet(f"{out}/{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{out}/*")


def drained(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """What a stream gives over all there is, from a table written in the shared folder.

    In update mode every batch is kept under its number, and of a key's rows those of the last batch that told of it count.
    """
    spark = stream.sparkSession
    out, kept = folder(spark, name), folder(spark, name + "-state")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    if not keys:
        raise ValueError("what is updated needs its keys")
    query = stream.writeStream.outputMode(mode).foreachBatch(shipping(out)).option("checkpointLocation", kept).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return last.select(*keys, "row.*").select(*stream.columns)


def pushes(stream: DataFrame, name: str, digest: str, arrival: str) -> DataFrame:
    """name, digest, outcome of segments pushed: accepted, repeated (same first 16 hex digits) or refused (others).

    The state of a name is the digest that it was accepted with: that of the push that arrived first.
    """

    def push(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("arrival", kind="stable")  # of one batch of the stream
        short = rows[digest].fillna("").str[:16].to_numpy()
        held = state.get[0] if state.exists else short[0]
        outcome = np.where(short == held, "repeated", "refused").astype(object)
        if not state.exists:
            outcome[0] = "accepted"
            state.update((held,))
        yield pd.DataFrame({name: key[0], digest: rows[digest], "outcome": outcome})

    kind = stream.schema[name].dataType.simpleString()
    rows = stream.select(name, digest, F.col(arrival).alias("arrival"))
    return rows.groupBy(name).applyInPandasWithState(push, f"{name} {kind}, {digest} string, outcome string", "held string", "append", GroupStateTimeout.NoTimeout)


def heartbeats(stream: DataFrame, surface: str, at: str, ok: str) -> DataFrame:
    """surface, attempts, last_attempt, last_success, failures: running state of each surface, failures since the last success."""

    def beat(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, last, good, failures = state.get if state.exists else (0, 0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("us", kind="stable")  # of one batch of the stream
        times, fine = rows["us"].to_numpy(), np.flatnonzero(rows[ok].to_numpy())
        attempts, last = attempts + len(rows), max(last, int(times[-1]))
        good, failures = (int(times[fine[-1]]), len(rows) - 1 - int(fine[-1])) if len(fine) else (good, failures + len(rows))
        state.update((int(attempts), int(last), int(good), int(failures)))
        yield pd.DataFrame({surface: [key[0]], "attempts": [attempts], "last_attempt": [last], "last_success": [good], "failures": [failures]})

    kind = stream.schema[surface].dataType.simpleString()
    rows = stream.select(surface, F.unix_micros(F.col(at).cast("timestamp")).alias("us"), ok)
    numbers = "attempts bigint, last_attempt bigint, last_success bigint, failures bigint"
    return rows.groupBy(surface).applyInPandasWithState(beat, f"{surface} {kind}, {numbers}", numbers, "update", GroupStateTimeout.NoTimeout)


def positions(stream: DataFrame, log: str, start: str, end: str) -> DataFrame:
    """log, position, gaps: how far each log was followed and how often what came next did not start there."""

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        position, gaps = state.get if state.exists else (-1, 0)
        rows = pd.concat(list(batches)).sort_values([start, end], kind="stable")  # of one batch of the stream
        reach = np.maximum.accumulate(np.append([position], rows[end].to_numpy()))
        gaps += int(((rows[start].to_numpy() > reach[:-1]) & (reach[:-1] >= 0)).sum())
        state.update((int(reach[-1]), gaps))
        yield pd.DataFrame({log: [key[0]], "position": [int(reach[-1])], "gaps": [gaps]})

    kind = stream.schema[log].dataType.simpleString()
    return stream.select(log, start, end).groupBy(log).applyInPandasWithState(follow, f"{log} {kind}, position bigint, gaps bigint", "position bigint, gaps bigint", "update", GroupStateTimeout.NoTimeout)


def shipping(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch as one object named by its number, so that a repeated batch replaces itself."""

    def ship(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return ship


def fan_out(targets: list[str], failures: list[tuple[str, int, str]]) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch to a first target and to copies; a copy's failure is noted and drops only that copy (K6)."""

    def write(df: DataFrame, batch: int) -> None:
        cached = df.persist()
        try:
            for i, target in enumerate(targets):
                try:
                    cached.write.mode("overwrite").parquet(f"{target}/batch={batch}")
                except Exception as e:  # noqa: BLE001
                    if i == 0:
                        raise
                    failures.append((target, batch, type(e).__name__))
        finally:
            cached.unpersist()

    return write


def compacted(spark: SparkSession, source: str, target: str, files: int = 1) -> None:
    """Small files joined into few, read back and compared before they count."""
    rows = spark.read.parquet(source)
    rows.coalesce(files).write.mode("overwrite").parquet(target)
    a, b = (d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns))).first() for d in (rows, spark.read.parquet(target)))
    if tuple(a) != tuple(b):
        raise RuntimeError("the compacted files do not read back as their sources")
