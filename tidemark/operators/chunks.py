"""Chunks: cutting contents, storing each chunk once, packing and reading them back."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
#: An irreducible polynomial of degree 53 over GF(2); each repository may have its own.
POLYNOMIAL = 0x3DA3358B4DC173
BLOCK = 1 << 20


def fixed_chunks(rows: DataFrame, keep: Sequence[str], content: str, size: int) -> DataFrame:
    """keep, seq, offset, length, id of the pieces of `size` characters or bytes, the last one shorter; empty contents have none."""
    pieces = F.sequence(F.lit(0), F.floor((F.length(content) - 1) / size).cast("int"))
    placed = rows.filter(F.length(content) > 0).select(*keep, F.col(content).alias("_c"), F.explode(pieces).alias("seq"))
    piece = F.substring(F.col("_c"), F.col("seq") * size + 1, F.lit(size))
    return placed.select(*keep, "seq", (F.col("seq").cast("long") * size).alias("offset"), F.length(piece).cast("long").alias("length"), F.sha2(piece.cast("binary"), 256).alias("id"))


@functools.cache
def _places(polynomial: int) -> np.ndarray:
    """What a byte adds to the fingerprint at each place of the window: byte x^(8 place) modulo the polynomial."""
    degree = polynomial.bit_length() - 1
    table = np.empty((WINDOW, 256), np.uint64)
    table[0] = np.arange(256)
    for k in range(1, WINDOW):
        v = table[k - 1].copy()
        for _ in range(8):
            v <<= np.uint64(1)
            v = np.where(v >> np.uint64(degree), v ^ np.uint64(polynomial), v)
        table[k] = v
    return table


def fingerprints(data: bytes, polynomial: int = POLYNOMIAL) -> np.ndarray:
    """The Rabin fingerprint of the WINDOW bytes that end at each byte; bytes before the first count as zeros.

    A fingerprint is linear in the bytes of its window, so those of all places are summed side by side."""
    table = _places(polynomial)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(len(raw), np.uint64)
    for k in range(min(WINDOW, len(raw))):
        out[k:] ^= table[k][raw[: len(raw) - k]]
    return out


def cut_points(data: bytes, least: int, mean: int, most: int, polynomial: int = POLYNOMIAL) -> list[int]:
    """Ends of the chunks of content-defined cutting: where the low bits of the fingerprint of the last WINDOW bytes are
    all zero, `mean` being a power of two. An insertion moves cuts only until the next common one.

    Where `least` is WINDOW or more a window lies within its chunk; below that it reaches into the chunk before.
    """
    if mean < 1 or mean & (mean - 1) or mean > 1 << 52:
        raise ValueError("the mean length is no power of two")
    n = len(data)
    marks: list[np.ndarray] = []
    for start in range(0, n, BLOCK):
        before = min(start, WINDOW - 1)
        prints = fingerprints(data[start - before : start + BLOCK], polynomial)[before:]
        marks.append(np.flatnonzero((prints & np.uint64(mean - 1)) == 0) + start + 1)
    ends_at = np.concatenate([*marks, np.empty(0, np.int64)])
    ends, start = [], 0
    while start < n:
        i = int(np.searchsorted(ends_at, start + least))
        end = int(ends_at[i]) if i < len(ends_at) else n
        end = min(end, start + most, n)
        ends.append(end)
        start = end
    return ends


def defined_chunks(rows: DataFrame, keep: Sequence[str], content: str, least: int, mean: int, most: int, polynomial: int = POLYNOMIAL) -> DataFrame:
    """keep, seq, offset, length, id of content-defined chunks; the same polynomial cuts alike, every chunk but the last is
    between `least` and `most` long. Null and empty contents have none."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            found: list[tuple] = []
            for i, value in enumerate(batch.column("c")):
                data = value.as_py() or b""
                start = 0
                for seq, end in enumerate(cut_points(data, least, mean, most, polynomial)):
                    at.append(i)
                    found.append((seq, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            if found:
                seq, offset, length, ids = zip(*found, strict=True)
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).take(pick) for n in names], pa.array(seq, pa.int32()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(ids)], names=[*names, "seq", "offset", "length", "id"])

    slim = rows.select(*[F.col(k).alias(n) for k, n in zip(keep, names, strict=True)], F.col(content).cast("binary").alias("c"))
    kinds = ", ".join(f"{n} {slim.schema[n].dataType.simpleString()}" for n in names)
    out = slim.mapInArrow(run, f"{kinds}, seq int, offset bigint, length bigint, id string")
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)], "seq", "offset", "length", "id")


def new_chunks(refs: DataFrame, known: DataFrame, id_: str = "id") -> DataFrame:
    """id, length of the chunks that are stored: each once, and none that is known."""
    return refs.groupBy(id_).agg(F.max("length").alias("length")).join(known.select(id_), id_, "left_anti")


def new_bytes(refs: DataFrame, known: DataFrame, by: Sequence[str], order: Sequence[str], id_: str = "id") -> DataFrame:
    """by, new_bytes: bytes that each file adds; a chunk is new to the first file that holds it, in order."""
    first = Window.partitionBy(id_).orderBy(*order)
    marked = refs.withColumn("_n", F.row_number().over(first)).join(known.select(id_, F.lit(True).alias("_known")), id_, "left")
    return marked.groupBy(*by).agg(F.sum(F.when((F.col("_n") == 1) & F.col("_known").isNull(), F.col("length")).otherwise(0)).cast("long").alias("new_bytes"))


def merged_ranges(blobs: DataFrame, pack: Sequence[str], offset: str, length: str, gap: int = 1 << 20) -> DataFrame:
    """pack, start, end, blobs: reads of each pack merged where the next starts within `gap` of the farthest end so far."""
    end = F.col(offset) + F.col(length)
    w = Window.partitionBy(*pack).orderBy(offset, length)
    rows = blobs.filter(F.col(offset).isNotNull() & (F.col(length) > 0)).select(*pack, F.col(offset).alias(offset), F.col(length).alias(length), end.alias("_end")).distinct()
    far = F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_fresh", (F.coalesce(F.col(offset) - far > gap, F.lit(True))).cast("int")).withColumn("_run", F.sum("_fresh").over(w))
    return runs.groupBy(*pack, "_run").agg(F.min(offset).alias("start"), F.max("_end").alias("end"), F.count(F.lit(1)).alias("blobs")).drop("_run")


def _pack_numbers(sizes: np.ndarray, held: int, number: int, target: int) -> tuple[np.ndarray, int, int]:
    """Pack of each size in order, and what the last one holds and its number: a pack that holds the target is closed by
    the next size. One search in the running sum a pack."""
    out = np.empty(len(sizes), np.int64)
    total = np.cumsum(sizes)
    start, base = 0, -held
    while start < len(sizes):
        if (total[start - 1] if start else 0) - base >= target:
            number, base = number + 1, int(total[start - 1]) if start else 0
        stop = min(int(np.searchsorted(total, base + target)) + 1, len(sizes))
        stop = max(stop, start + 1)
        out[start:stop] = number
        start = stop
    return out, int(total[-1] - base) if len(sizes) else held, number


def sequential_packs(blobs: DataFrame, group: Sequence[str], order: Sequence[str], length: str, target: int) -> DataFrame:
    """Blobs with `pack`, from 0: a pack takes blobs in order and closes once it holds the target. A null length is 0.

    Which pack a blob is in depends on all blobs before it, so a group is one ordered stream and one task; it passes batch
    by batch in constant memory, at one search a pack.
    """
    columns = blobs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, number = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = np.zeros(batch.num_rows, bool)
            for g in group:
                code = batch.column(g).dictionary_encode()
                ids = np.asarray(code.indices.fill_null(len(code.dictionary)))
                fresh[1:] |= ids[1:] != ids[:-1]
            sizes = np.asarray(batch.column(length).fill_null(0)).astype(np.int64)
            numbers = []
            edges = [0, *np.flatnonzero(fresh).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                tag = tuple(batch.column(g)[a].as_py() for g in group)
                if tag != now:
                    now, held, number = tag, 0, 0
                found, held, number = _pack_numbers(sizes[a:b], held, number, target)
                numbers.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(numbers))], names=[*columns, "pack"])

    from pyspark.sql import types as T

    placed = blobs.repartition(*group).sortWithinPartitions(*group, *order)
    return placed.mapInArrow(run, T.StructType([*placed.schema.fields, T.StructField("pack", T.LongType())]))


def reference_problems(refs: DataFrame, blobs: DataFrame, packs: DataFrame, ref: Sequence[str]) -> DataFrame:
    """ref, problem of chunk references: not_indexed, wrong_kind or pack_missing; blobs: id, type, pack_id; packs: id."""
    index = blobs.groupBy("id").agg(F.min("type").alias("_type"), F.max_by("pack_id", F.struct("indexed_at", "pack_id")).alias("_pack"))
    there = packs.select(F.col("id").alias("_pack")).distinct().withColumn("_there", F.lit(True))
    joined = refs.join(index, "id", "left").join(there, "_pack", "left")
    problem = F.when(F.col("_type").isNull(), "not_indexed").when(F.col("_type") != 0, "wrong_kind").when(F.col("_there").isNull(), "pack_missing")
    return joined.select(*ref, "id", problem.alias("problem")).filter("problem IS NOT NULL")


def unchanged(files: DataFrame, before: DataFrame, key: Sequence[str], known: DataFrame, blobs: str = "blobs") -> DataFrame:
    """key of files that need no reading: size, times, device and inode as before, and every chunk of before known."""
    stat = ["size", "mtime_ns", "ctime_ns", "dev", "ino"]
    old = before.select(*key, *[F.col(c).alias(f"_{c}") for c in stat], F.col(blobs).alias("_blobs"))
    same = files.join(old, list(key))
    for c in stat:
        same = same.filter(F.col(c).eqNullSafe(F.col(f"_{c}")))
    lost = same.select(*key, F.explode("_blobs").alias("id")).join(known.select("id"), "id", "left_anti").select(*key).distinct()
    return same.select(*key).distinct().join(lost, list(key), "left_anti")


def last_run_wins(index: DataFrame, key: Sequence[str], run_order: Column) -> DataFrame:
    """One row a key: that of the last run."""
    rest = [c for c in index.columns if c not in key]
    best = index.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(run_order.alias("o"), *[c for c in rest if dict(index.dtypes)[c] not in ("variant",)])).alias("b"))
    return best.select(*key, *[F.col("b")[c].alias(c) for c in rest])


def unsteady(first: DataFrame, again: DataFrame, key: Sequence[str], stat: Sequence[str] = ("size", "mtime_ns", "ctime_ns")) -> DataFrame:
    """key, problem of files that changed while they were read: `changed` if a stat differs from the one before the read,
    `gone` if there is none any more. What came meanwhile is none."""
    after = again.select(*key, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in stat])
    joined = first.join(after, list(key), "left")
    differs = F.lit(False)
    for c in stat:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.select(*key, F.when(F.col("_there").isNull(), "gone").when(differs, "changed").alias("problem")).filter("problem IS NOT NULL")


def rewrites(wanted: DataFrame, present: DataFrame, file: Sequence[str]) -> DataFrame:
    """file, action, start, bytes: what brings present files to the wanted contents, told by their chunks.

    wanted, present: file, seq, offset, length, id. A file is rewritten from its first chunk that differs on, cut if it
    only is too long (`truncate`), written whole if it is not there, deleted if it is not wanted; `bytes` are to be
    written. Files that hold the wanted chunks need nothing.
    """
    have = present.select(*file, "seq", F.col("id").alias("_id"), (F.col("offset") + F.col("length")).alias("_end"))
    both = wanted.join(have, [*file, "seq"], "full")
    differs = F.col("id").isNotNull() & ~F.col("id").eqNullSafe(F.col("_id"))
    grouped = both.groupBy(*file).agg(
        F.min(F.when(differs, F.col("offset"))).alias("start"),
        F.max(F.col("offset") + F.col("length")).alias("_size"),
        F.max("_end").alias("_had"),
    )
    action = (
        F.when(F.col("_size").isNull(), "delete").when(F.col("_had").isNull(), "write").when(F.col("start").isNotNull(), "rewrite").when(F.col("_had") > F.col("_size"), "truncate")
    )
    start = F.when(action == "truncate", F.col("_size")).when(action == "delete", F.lit(0)).otherwise(F.col("start"))
    return grouped.select(*file, action.alias("action"), start.cast("long").alias("start"), F.when(action.isin("write", "rewrite"), F.col("_size") - F.col("start")).otherwise(0).cast("long").alias("bytes")).filter("action IS NOT NULL")
