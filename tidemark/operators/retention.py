"""Retention: tiers of backups, what to keep, what to prune and when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import day_key, month_key, plus_days, plus_months, tier_until, week_key


def tiers(backups: DataFrame, entity: Sequence[str], at: str, base_days: int, daily: int = 0, weekly: int = 0, monthly: int = 0, tie: Sequence[str] = ()) -> DataFrame:
    """Backups with `tier` and `keep_until`.

    The first backup of an entity in a UTC day, ISO week or month takes that slot whether or not another tier keeps it
    longer; of the slots it takes, the one that ends latest holds, and the base holds against equal ends. Only backups
    that succeeded may be passed in: a failed one takes no slot.
    """
    moment = F.col(at).cast("timestamp")
    slots = {"daily": day_key(moment), "weekly": week_key(moment), "monthly": month_key(moment)}
    until = tier_until(moment, base_days, daily, weekly, monthly)
    rows = backups.withColumns({f"_{k}": v for k, v in slots.items()})
    first = {k: F.row_number().over(Window.partitionBy(*entity, f"_{k}").orderBy(at, *tie)) == 1 for k in slots if k in until}
    rows = rows.withColumns({f"_first_{k}": v for k, v in first.items()})
    tier, keep = F.lit("base"), until["base"]
    for k in ("daily", "weekly", "monthly"):
        if k in until:
            better = F.col(f"_first_{k}") & (until[k] > keep)
            tier, keep = F.when(better, k).otherwise(tier), F.when(better, until[k]).otherwise(keep)
    return rows.withColumns({"tier": tier, "keep_until": keep}).drop(*[f"_{k}" for k in slots], *[f"_first_{k}" for k in slots])


def keep_newest(drills: DataFrame, entity: Sequence[str], at: str, passed: str, keep: int, tie: Sequence[str] = ()) -> DataFrame:
    """Rows with `rank`, newest first, and `kept`: the newest max(keep, 1), and beyond them the newest that passed if none
    of those passed and the last of them failed. `passed` is null where no drill ran."""
    n = max(keep, 1)
    w = Window.partitionBy(*entity).orderBy(F.col(at).desc(), *[F.col(t).desc() for t in tie])
    every = Window.partitionBy(*entity)
    ranked = drills.withColumn("rank", F.row_number().over(w))
    inside = F.col("rank") <= n
    none = ~F.coalesce(F.max(F.when(inside, F.col(passed))).over(every), F.lit(False))
    nth_failed = F.coalesce(F.max(F.when(F.col("rank") == n, F.col(passed) == F.lit(False))).over(every), F.lit(False))
    spare = F.min(F.when(~inside & F.col(passed), F.col("rank"))).over(every)
    return ranked.withColumn("kept", inside | F.coalesce(none & nth_failed & (F.col("rank") == spare), F.lit(False)))


def prune_outcome(locked_until: Column, held: Column, now: Column, grace_hours: int = 24) -> Column:
    """held, locked, grace or deleted: by legal hold, by lock, by the hours after it, else free to go. A null lock is held."""
    grace = F.timestamp_micros(F.unix_micros(locked_until.cast("timestamp")) + F.lit(grace_hours * 3_600_000_000).cast("long"))
    return F.when(F.coalesce(held, F.lit(False)) | locked_until.isNull(), "held").when(now < locked_until, "locked").when(now < grace, "grace").otherwise("deleted")


def epoch_prune(snapshots: DataFrame, epoch: Sequence[str], newest_of: Sequence[str], at: str, expires: str, now: Column) -> DataFrame:
    """epoch, later_objects, opening_object: `keep` or `delete` of an epoch's later and opening objects.

    Later objects go when all later snapshots have expired, the opening one when all have; an epoch that holds the
    newest snapshot of its owner keeps everything. The opening snapshot is the epoch's first; a null expiry never comes.
    """
    w = Window.partitionBy(*epoch)
    newest = F.max(at).over(Window.partitionBy(*newest_of)) == F.col(at)
    rows = snapshots.withColumns({"_opening": F.col(at) == F.min(at).over(w), "_newest": newest, "_expired": F.coalesce(F.col(expires) <= now, F.lit(False))})
    each = rows.groupBy(*epoch).agg(F.bool_or("_newest").alias("n"), F.bool_and(F.col("_expired") | F.col("_opening")).alias("later"), F.bool_and("_expired").alias("every"))
    out = lambda c: F.when(F.col(c) & ~F.col("n"), "delete").otherwise("keep")
    return each.select(*epoch, out("later").alias("later_objects"), out("every").alias("opening_object"))


def epoch_dates(opened: Column, tier_until_opening: Column, mid_days: Column) -> dict[str, Column]:
    """planned_end a month after opening, later_retain_until the days of the middle tier after it, opening lock 3 days more."""
    planned = plus_months(opened, 1)
    return {"planned_end": planned, "later_retain_until": plus_days(planned, mid_days), "opening_retain_until": plus_days(tier_until_opening, 3)}


def retain_cap(planned: Column, lock: Column) -> tuple[Column, Column]:
    """The earlier of a planned end and a class's lock, and whether the lock capped it."""
    return F.least(planned, lock), F.coalesce(planned > lock, F.lit(False))


def first_reason(reasons: dict[str, Column], otherwise: str) -> Column:
    """The first reason whose condition holds; a null condition does not."""
    found = F.lit(otherwise)
    for name, condition in reversed(reasons.items()):
        found = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(found)
    return found


def drop_oldest(rows: DataFrame, queue: Sequence[str], order: str, size: str, most: int, incoming: int = 0) -> DataFrame:
    """Rows with `kept`: the newest whose sizes, with what comes in, fit into `most`; the oldest are dropped first."""
    w = Window.partitionBy(*queue).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("kept", F.sum(F.coalesce(F.col(size), F.lit(0))).over(w) + incoming <= most)
