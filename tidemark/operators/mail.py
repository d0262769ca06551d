"""Messages of mailboxes: folders with their statistics, one body for all labels, and what a restore lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Uses of folders that are not backed up unless asked for.
JUNK = ("\\Junk", "\\Trash")


def chosen_folders(folders: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """mailbox, folder of the folders to read: mailbox, folder, use, all_mail.

    Excluded ones go, and so do junk and trash unless folders are named. A mailbox whose labels show as folders has one
    that holds every message: unless folders are named it is read alone.
    """
    kept = folders.filter(~F.col("folder").isin(*exclude)) if exclude else folders
    if include:
        return kept.filter(F.col("folder").isin(*include)).select("mailbox", "folder")
    kept = kept.filter(~F.coalesce(F.col("use").isin(*JUNK), F.lit(False)))
    whole = F.max(F.coalesce("all_mail", F.lit(False))).over(Window.partitionBy("mailbox"))
    return kept.withColumn("_whole", whole).filter(~F.col("_whole") | F.col("all_mail")).select("mailbox", "folder")


def folder_stats(messages: DataFrame) -> DataFrame:
    """mailbox, folder, messages, bytes, uid_validity, highest_uid of messages with size, uid_validity and uid."""
    return messages.groupBy("mailbox", "folder").agg(F.count(F.lit(1)).alias("messages"), F.sum("size").alias("bytes"), F.max("uid_validity").alias("uid_validity"), F.max("uid").alias("highest_uid"))


def new_messages(messages: DataFrame, stats: DataFrame) -> DataFrame:
    """Messages beyond what was read before: all of a folder that is new or whose numbering began anew."""
    seen = stats.select("mailbox", "folder", F.col("uid_validity").alias("_valid"), F.col("highest_uid").alias("_high"))
    joined = messages.join(seen, ["mailbox", "folder"], "left")
    return joined.filter(F.col("_valid").isNull() | (F.col("_valid") != F.col("uid_validity")) | (F.col("uid") > F.col("_high"))).drop("_valid", "_high")


def stored_bodies(messages: DataFrame, digest: str = "digest") -> DataFrame:
    """mailbox, digest, size, copies: each body once for all folders that hold it."""
    return messages.groupBy("mailbox", digest).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def compared_messages(listed: DataFrame, restored: DataFrame, by: Sequence[str] = ("mailbox", "folder"), digest: str = "digest", readable: Column | None = None) -> DataFrame:
    """by, messages, unreadable, lost, passed: each folder's listed messages against the restored ones by digest.

    A digest that is listed n times must be restored n times. Messages that did not read when they were listed have no
    digest to compare; they are told and fail nothing.
    """
    ok = F.col(digest).isNotNull() if readable is None else readable
    want = listed.withColumn("_ok", ok).groupBy(*by, digest).agg(F.count(F.lit(1)).alias("n"), F.min("_ok").alias("ok"))
    have = restored.groupBy(*by, F.col(digest).alias("_digest")).agg(F.count(F.lit(1)).alias("_n"))
    have = have.withColumnsRenamed({b: f"_{b}" for b in by})
    joined = want.join(have, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by] + [F.col(digest) == F.col("_digest")], "left")
    lost = F.when(F.col("ok"), F.greatest(F.col("n") - F.coalesce("_n", F.lit(0)), F.lit(0))).otherwise(0)
    found = joined.groupBy(*by).agg(F.sum("n").alias("messages"), F.sum(F.when(F.col("ok"), 0).otherwise(F.col("n"))).alias("unreadable"), F.sum(lost).alias("lost"))
    return found.withColumn("passed", F.col("lost") == 0)
