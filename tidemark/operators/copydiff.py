"""Differences between two copies of a dataset.

Both sides are tagged and united, grouped once by key with the newest row of each side kept as a struct, and the two
structs are compared field by field by a generated higher-order expression. The aggregation is combined before the
shuffle, so a key that holds many rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ids import percent_decoded
from tidemark.session import checkpointed


def compare_copies(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str], newest: Sequence[str] = (), carry: Sequence[str] = (), both_known: bool = False) -> DataFrame:
    """One row per key that differs: keys, `missing_left`, `missing_right`, `changes`, `left_row`, `right_row`.

    keys: equal keys match, null matching null. fields: compared null-safely, or with `both_known` only where both
    sides are known. newest: of several rows of a key on one side, the greatest by these columns holds; equal ones are
    settled by the fields. carry: kept in the structs, not compared. `changes` lists struct(field, left, right) as
    text. Repeated rows count once, empty sides make every row of the other missing, other columns are dropped.
    """
    used = [*dict.fromkeys([*keys, *fields, *carry, *newest])]
    names = {c: f"c{i}" for i, c in enumerate(used)}
    tagged = lambda df, left: df.select(*[df[c].alias(n) for c, n in names.items()], F.lit(left).alias("left"))
    of = lambda cs: [names[c] for c in cs]
    both = tagged(left, True).unionByName(tagged(right, False))
    shown = {n: c for c, n in names.items()}
    return compare_sides(both, "left", of(keys), of(fields), of(newest), of(carry), both_known, shown)


def compare_sides(both: DataFrame, left: str, keys: Sequence[str], fields: Sequence[str], newest: Sequence[str] = (), carry: Sequence[str] = (), both_known: bool = False, shown: dict[str, str] | None = None) -> DataFrame:
    """compare_copies of rows that are united already, those of the left side being tagged `left`. shown: names of the
    columns in the result, where they are others."""
    inner = [*dict.fromkeys([*fields, *carry])]
    shown = {c: c for c in (*keys, *inner)} | (shown or {})
    row = F.struct(*[both[c].alias(f"v{i}") for i, c in enumerate(inner)])
    order = F.struct(*[both[c].alias(f"o{i}") for i, c in enumerate(newest)], row.alias("tie")) if newest else row
    sided = both.select(*[both[k].alias(f"k{i}") for i, k in enumerate(keys)], both[left].alias("side"), order.alias("ord"))
    of = lambda side: F.max(F.when(side, F.col("ord")))
    grouped = sided.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(of(F.col("side")).alias("l"), of(~F.col("side")).alias("r"))
    body = (lambda c: c["tie"]) if newest else (lambda c: c)
    lrow, rrow = body(F.col("l")), body(F.col("r"))

    def cell(i: int, name: str) -> Column:
        a, b = lrow[f"v{i}"], rrow[f"v{i}"]
        differs = ((a != b) & a.isNotNull() & b.isNotNull()) if both_known else ~a.eqNullSafe(b)
        return F.struct(F.lit(shown[name]).alias("field"), a.cast("string").alias("left"), b.cast("string").alias("right"), F.coalesce(differs, F.lit(False)).alias("differs"))

    found = F.filter(F.array(*[cell(i, f) for i, f in enumerate(inner) if f in fields]), lambda x: x["differs"])
    changes = F.transform(found, lambda x: F.struct(x["field"].alias("field"), x["left"].alias("left"), x["right"].alias("right")))
    there = F.col("l").isNotNull() & F.col("r").isNotNull()
    named = lambda row, side: F.when(F.col(side).isNotNull(), F.struct(*[row[f"v{i}"].alias(shown[c]) for i, c in enumerate(inner)]))
    compared = grouped.select(
        *[F.col(f"k{i}").alias(shown[k]) for i, k in enumerate(keys)],
        F.col("l").isNull().alias("missing_left"),
        F.col("r").isNull().alias("missing_right"),
        F.when(there, changes).otherwise(F.array().cast("array<struct<field:string,left:string,right:string>>")).alias("changes"),
        named(lrow, "l").alias("left_row"),
        named(rrow, "r").alias("right_row"),
    )
    return compared.filter("missing_left OR missing_right OR size(changes) > 0")


def object_names(objects: DataFrame) -> DataFrame:
    """store, epoch_id, name, size, modified, listed_at of each listed object; rows whose key lacks the epoch are no objects of it."""
    key = percent_decoded(F.col("key"))
    at = F.instr(F.concat(F.lit("/"), key), F.concat(F.lit("/"), F.col("epoch_id"), F.lit("/")))
    name = F.when(at > 0, F.substring(key, at + F.length("epoch_id") + 1, F.length(key)))
    rows = objects.select("store", F.col("epoch_id").alias("epoch_id"), name.alias("name"), "size", "modified", "listed_at")
    return rows.filter("store IS NOT NULL AND epoch_id IS NOT NULL AND name IS NOT NULL AND name <> ''")


def store_differences(objects: DataFrame, copy_results: DataFrame, first: str = "first") -> DataFrame:
    """(store, epoch_id, name, diff): objects that a copy or the first store lacks, sizes that differ, and claims of
    `behind` that the listings contradict, for every (copy, epoch) that copy_results mentions.

    Of several rows of one object in one store the latest listed_at holds, ties settled by the greater modified and
    size. An unknown size differs from nothing. An object modified after the lacking store's last listing of the epoch
    is not missing; one with no modification time is. Claims of null are passed over; ties of finished_at are settled
    for `true`. Null names or epochs are compared with nothing.

    The listings are read twice, once for the times of the last listings only. The differences are checkpointed, as
    both the answer and the claims need them.
    """
    claims = copy_results.filter("name IS NOT NULL AND epoch_id IS NOT NULL").groupBy(F.col("name").alias("store"), "epoch_id")
    claims = claims.agg(F.max(F.when(F.col("behind").isNotNull(), F.struct("finished_at", "behind")))["behind"].alias("behind"))
    claims = claims.filter(F.col("store") != first)
    listed = objects.filter("store IS NOT NULL AND epoch_id IS NOT NULL").groupBy(F.col("store").alias("s"), F.col("epoch_id").alias("e")).agg(F.max("listed_at").alias("last"))
    in_first = listed.filter(F.col("s") == first).select("e", F.col("last").alias("first_last"))
    pairs = claims.join(listed, (F.col("store") == F.col("s")) & (F.col("epoch_id") == F.col("e")), "left").drop("s", "e")
    pairs = pairs.join(in_first, F.col("epoch_id") == F.col("e"), "left").drop("e")

    # one pass of the listings: a row of the first store stands once for each copy of its epoch, others for themselves
    copies = claims.groupBy(F.col("epoch_id").alias("e")).agg(F.collect_set("store").alias("copies"))
    named = object_names(objects).join(copies, F.col("epoch_id") == F.col("e")).drop("e")
    at_first = F.col("store") == first
    own = F.filter("copies", lambda c: c == F.col("store"))
    tagged = named.select(at_first.alias("left"), F.explode(F.when(at_first, F.col("copies")).otherwise(own)).alias("store"), "epoch_id", "name", "size", "modified", "listed_at")
    diffs = compare_sides(tagged, "left", ["store", "epoch_id", "name"], ["size"], ["listed_at", "modified"], ["modified"], both_known=True)

    kind = F.when(F.col("missing_right"), "missing_in_copy").when(F.col("missing_left"), "missing_in_first").otherwise("size")
    state = diffs.select("store", "epoch_id", "name", kind.alias("diff"), F.coalesce(F.col("left_row.modified"), F.col("right_row.modified")).alias("modified"))
    lacks = F.when(F.col("diff") == "missing_in_copy", F.col("last")).when(F.col("diff") == "missing_in_first", F.col("first_last"))
    young = (F.col("diff") != "size") & lacks.isNotNull() & (F.col("modified") > lacks)
    rows = state.join(pairs, ["store", "epoch_id"]).filter(~F.coalesce(young, F.lit(False))).select("store", "epoch_id", "name", "diff")
    rows = checkpointed(rows)

    short = rows.filter(F.col("diff") == "missing_in_copy").groupBy("store", "epoch_id").agg(F.lit(True).alias("short"))
    # a mentioned pair without any difference is needed as well, for its claim
    wrong = claims.join(short, ["store", "epoch_id"], "left").filter(F.col("behind") != F.coalesce(F.col("short"), F.lit(False)))
    return rows.unionByName(wrong.select("store", "epoch_id", F.lit("-").alias("name"), F.lit("behind").alias("diff")))
