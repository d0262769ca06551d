"""Version history of paths across snapshots, and the state as of a snapshot."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_pattern(glob: str) -> str:
    """An anchored regular expression of a path glob: `*`, `?` and `[..]` within a segment, `**` across segments.

    A match of a directory takes everything below it along. A pattern without a slash stands for `**/name`.
    """
    glob = glob.strip("/") if "/" in glob.strip("/") else "**/" + glob.strip("/")
    parts = []
    for segment in glob.split("/"):
        if segment == "**":
            parts.append("**")
            continue
        out, i = "", 0
        while i < len(segment):
            c = segment[i]
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif c == "[" and (end := segment.find("]", i + 2)) > 0:
                inner = segment[i + 1 : end]
                out += "[" + ("^" + inner[1:] if inner[0] in "^!" else inner).replace("\\", "\\\\") + "]"
                i = end
            else:
                out += re.escape(c)
            i += 1
        parts.append(out)
    text = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            text += ".*" if last else "(?:[^/]+/)*"
        else:
            text += p + ("" if last else "/")
    return f"^{text}(?:/.*)?$"


def selected(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path is chosen; no globs choose every path."""
    if not globs:
        return F.lit(True)
    return path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))


def with_ancestors(entries: DataFrame, path: str, globs: Sequence[str]) -> DataFrame:
    """Chosen paths and the directories on the way to them, once each, with their depth."""
    chosen = entries.filter(selected(F.col(path), globs)).select(path)
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return chosen.select(F.explode(prefixes).alias(path)).distinct().withColumn("depth", F.size(F.split(path, "/")))


def version_islands(events: DataFrame, snapshots: DataFrame, series: Sequence[str], path: str, content: Sequence[str], epoch: str) -> DataFrame:
    """series, path, version, first, last, snapshots, epochs, current: runs of snapshots in which a path held one content.

    events: series, ord, path, event (present, added, changed, deleted) and content. snapshots: series, ord, complete
    and the epoch. A deletion ends a run before it, and so does a complete snapshot that does not list the path; a delta
    that does not mention the path continues the run.

    What a run needs of its snapshots is looked up by (series, ord): the next complete one, the newest, and how often the
    epoch had changed. Only in a series that goes back to an earlier epoch are the epochs of a run told apart one by one.
    """
    key = [*series, path]
    each = Window.partitionBy(*series)
    up = each.orderBy("ord")
    moved = ~F.coalesce(F.lag(epoch).over(up).eqNullSafe(F.col(epoch)), F.lit(False))
    places = snapshots.withColumn("_moved", (moved | F.lag("ord").over(up).isNull()).cast("int"))
    places = places.select(*series, "ord", epoch, F.min(F.when(F.col("complete"), F.col("ord"))).over(up.rowsBetween(1, Window.unboundedFollowing)).alias("silent"), F.max("ord").over(each).alias("newest"), F.sum("_moved").over(up).alias("changes"))
    state = F.when(F.col("event") != "deleted", F.struct(*content))
    w = Window.partitionBy(*key).orderBy("ord")
    rows = events.select(*key, "ord", state.alias("state")).join(places.drop(epoch), [*series, "ord"]).withColumn("next", F.lead("ord").over(w))
    # the state lasts until the event after it, the first complete snapshot that says nothing of the path, or the end
    rows = rows.withColumn("until", F.least(F.coalesce("next", F.col("newest") + 1), F.coalesce("silent", F.col("newest") + 1)) - 1)
    held = rows.filter("state IS NOT NULL")
    before = F.lag(F.struct("state", "until")).over(w)
    fresh = ~F.coalesce((before["until"] + 1 == F.col("ord")) & before["state"].eqNullSafe(F.col("state")), F.lit(False))
    runs = held.withColumn("run", F.sum(fresh.cast("int")).over(w))
    made = runs.groupBy(*key, "run").agg(F.min("ord").alias("first"), F.max("until").alias("last"), F.first("newest").alias("newest"), F.min("changes").alias("from"))
    numbered = made.withColumn("version", F.row_number().over(Window.partitionBy(*key).orderBy("first")))
    numbered = numbered.join(places.select(*series, F.col("ord").alias("last"), F.col("changes").alias("to")), [*series, "last"])
    again = places.groupBy(*series).agg(F.count_distinct(F.struct(epoch)).alias("n"), F.max("changes").alias("c"), F.map_from_entries(F.collect_set(F.struct("ord", epoch))).alias("epoch_of")).filter("n < c").select(*series, "epoch_of")
    numbered = numbered.join(again, list(series), "left")
    apart = F.size(F.array_distinct(F.transform(F.sequence("first", "last"), lambda o: F.col("epoch_of")[o])))
    epochs = F.when(F.col("epoch_of").isNull(), (F.col("to") - F.col("from") + 1).cast("int")).otherwise(apart)
    return numbered.select(*key, "version", "first", "last", (F.col("last") - F.col("first") + 1).alias("snapshots"), epochs.alias("epochs"), (F.col("last") == F.col("newest")).alias("current"))


def deleted_only(versions: DataFrame, series: Sequence[str], path: str) -> DataFrame:
    """series, path, last of paths whose newest version is not current."""
    grouped = versions.groupBy(*series, path).agg(F.max("last").alias("last"), F.bool_or("current").alias("current"))
    return grouped.filter(~F.col("current")).drop("current")


def state_as_of(events: DataFrame, snapshots: DataFrame, series: Sequence[str], path: str, at: int) -> DataFrame:
    """The last event of each path at or before snapshot `at`, from the newest complete snapshot on; deleted paths go."""
    start = snapshots.filter(F.col("complete") & (F.col("ord") <= at)).groupBy(*series).agg(F.max("ord").alias("start"))
    rows = events.filter(F.col("ord") <= at).join(start, list(series)).filter("ord >= start").drop("start")
    rest = [c for c in events.columns if c not in (*series, path)]
    newest = rows.groupBy(*series, path).agg(F.max(F.struct("ord", *[c for c in rest if c != "ord"])).alias("row"))
    return newest.select(*series, path, *[F.col("row")[c].alias(c) for c in rest]).filter("event <> 'deleted'")
