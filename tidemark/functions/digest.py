"""Digests over ordered rows, and the text forms they are taken of."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def percent_escaped(c: Column) -> Column:
    """Bytes below 0x21, above 0x7e and `%` as `%XX` in upper case; other text as it is, without touching its bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "utf-8")), F.lit("(..)"), F.lit(1))
    byte = lambda h: F.conv(h, 16, 10).cast("int")
    shown = lambda h: F.when((byte(h) < 0x21) | (byte(h) > 0x7E) | (h == "25"), F.concat(F.lit("%"), h)).otherwise(F.char(byte(h)))
    return F.when(c.rlike("^[\\x21-\\x24\\x26-\\x7e]*$"), c).otherwise(F.concat_ws("", F.transform(pairs, shown)))


def rendered(c: Column, kind: T.DataType) -> Column:
    """A value as text: null as `\\N`, booleans t and f, timestamps with six digits and Z, binary in hex."""
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "t").otherwise("f")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = stamp(c)
    elif isinstance(kind, T.BinaryType):
        text = F.lower(F.hex(c))
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "\\N").otherwise(text)


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _streamed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, rows = None, None, 0
        done: list[tuple] = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for tag, line in zip(zip(*columns[:n], strict=True), columns[n], strict=True):
                if tag != now:
                    if digest is not None:
                        done.append((*now, digest.hexdigest(), rows))
                    now, digest, rows = tag, hashlib.sha256(), 0
                digest.update(line)
                rows += 1
        if digest is not None:
            done.append((*now, digest.hexdigest(), rows))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[f"k{i}" for i in range(n)] + ["digest", "lines"])

    return run


def ordered_digest(df: DataFrame, group: Sequence[str], order: Sequence[str], line: Column) -> DataFrame:
    """group, digest, lines: SHA-256 of each group's lines in order.

    A digest is sequential, so a group is one task, but its lines stream through: memory does not grow with the group.
    Null lines are left out; groups without lines do not come out.
    """
    names = [f"k{i}" for i in range(len(group))]
    rows = df.select(*[F.col(g).cast("string").alias(n) for g, n in zip(group, names, strict=True)], *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.encode(line, "utf-8").alias("line")).filter("line IS NOT NULL")
    sorted_rows = rows.repartition(*names).sortWithinPartitions(*names, *[f"o{i}" for i in range(len(order))]).select(*names, "line")
    found = sorted_rows.mapInArrow(_streamed(len(group)), ", ".join(f"{n} string" for n in names) + ", digest string, lines bigint")
    return found.select(*[F.col(n).alias(g) for n, g in zip(names, group, strict=True)], "digest", "lines")


def listed_digest(lines: Column, *order: Column) -> Column:
    """SHA-256 of a small ordered list of lines inside an aggregation; no lines give the empty text."""
    body = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], lines.alias("line")))), lambda x: x["line"]))
    return F.when(F.count(lines) == 0, "").otherwise(F.sha2(body, 256))
