"""Restoring and handing out: files put together again, logs replayed or refused, exports, salvage, definitions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def assembled(refs: DataFrame, chunks: DataFrame, by: Sequence[str], order: str, id_: str = "id", body: str = "body") -> DataFrame:
    """by, body, missing: each file's chunks joined in order, and how many of them are not stored. A file is one row."""
    joined = refs.select(*by, order, id_).join(chunks.select(id_, F.col(body).alias("_b")).dropDuplicates([id_]), id_, "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "_b"))), lambda x: x["_b"])
    return joined.groupBy(*by).agg(F.array_join(parts, "").alias("body"), F.count(F.when(F.col("_b").isNull(), 1)).alias("missing"))


def salvaged(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """What verifies and what does not; a null outcome does not."""
    ok = F.coalesce(sound, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def pages_applied(frames: DataFrame, log: Sequence[str], page: str, seq: str, commit: str, image: str) -> DataFrame:
    """log, page, image: of the frames up to a log's last commit the last image of each page."""
    last = frames.filter(F.col(commit)).groupBy(*log).agg(F.max(seq).alias("_last"))
    return frames.join(last, list(log)).filter(F.col(seq) <= F.col("_last")).groupBy(*log, page).agg(F.max_by(image, seq).alias(image))


def replay_refusals(runs: DataFrame, targets: DataFrame, log: Sequence[str], start: str, end: str) -> DataFrame:
    """log, target, refusal: `gap` if a run that begins after the base's breaks off before the target, `past_end` if the
    log ends before it, else null. runs: continuous runs with start, end and run, the base lying in run 1."""
    spans = runs.groupBy(*log).agg(F.max(F.when(F.col("run") == 1, F.col(end))).alias("_first"), F.max(end).alias("_all"))
    refusal = F.when(F.col("_all").isNull() | (F.col("target") > F.col("_all")), "past_end").when(F.col("target") > F.coalesce("_first", F.lit(-1)), "gap")
    return targets.join(spans, list(log), "left").select(*log, "target", refusal.alias("refusal"))


def newest_queue(rows: DataFrame, queue: Sequence[str], order: Sequence[str], most: int = 500) -> DataFrame:
    """A bounded queue for each surface: the newest `most` entries stay, the oldest are dropped."""
    w = Window.partitionBy(*queue).orderBy(*[F.col(o).desc() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def timelines(requests: DataFrame, branches: DataFrame, series: Sequence[str]) -> DataFrame:
    """series, from_timeline, seg, timeline: the greatest timeline from the asked one on that begins at or before the segment.

    branches: series, timeline, begins. They are few a series, one row each: they go along as a sorted array.
    """
    listed = branches.groupBy(*series).agg(F.collect_set(F.struct("timeline", "begins")).alias("_b"))
    fit = F.filter(F.coalesce("_b", F.array().cast("array<struct<timeline:bigint,begins:bigint>>")), lambda b: (b["timeline"] >= F.col("from_timeline")) & (b["begins"] <= F.col("seg")))
    found = F.array_max(F.transform(fit, lambda b: b["timeline"]))
    return requests.join(listed, list(series), "left").select(*series, "from_timeline", "seg", F.greatest("from_timeline", F.coalesce(found, F.col("from_timeline"))).alias("timeline"))


def certificate(fields: Sequence[Column], optional: Sequence[Column] = (), prefix: str = "sha256:") -> Column:
    """A digest over parts joined by colons; optional parts count where they are there."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(":", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields], *optional), 256))


def digests_agree(*names: str) -> Column:
    """The first pair of digests in a chain that differ, or null; unknown ones are passed over."""
    found = F.lit(None).cast("string")
    for a, b in reversed(list(zip(names, names[1:], strict=False))):
        differs = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.lower(a) != F.lower(b))
        found = F.when(differs, f"{a}<>{b}").otherwise(found)
    return found


def kept_lines(lines: DataFrame, by: Sequence[str], number: str, text: str, known_settings: Sequence[str] = ()) -> DataFrame:
    """Lines of a dump without the rows of cron tables, comments on extensions and unknown settings.

    A COPY block of a cron table goes from its head to its end mark; blocks are told apart by a running count.
    """
    w = Window.partitionBy(*by).orderBy(number)
    head = F.col(text).rlike(r"^COPY cron\.")
    end = F.lag(F.col(text) == "\\.", 1, False).over(w)
    state = F.last(F.when(head, True).when(end, False), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    setting = F.regexp_extract(F.col(text), r"^SET (\w+)\s*=", 1)
    unknown = (setting != "") & ~setting.isin(*known_settings) if known_settings else setting != ""
    marked = lines.withColumn("_cron", F.coalesce(state, F.lit(False)))
    return marked.filter(~F.col("_cron") & ~F.col(text).rlike(r"^COMMENT ON EXTENSION ") & ~unknown).drop("_cron")


def without_owners(text: Column) -> Column:
    """A script without statements that set owners and policies, and without meta-commands."""
    for pattern in (r"(?im)^ALTER [^;]* OWNER TO [^;]*;\n?", r"(?im)^(CREATE|ALTER) POLICY [^;]*;\n?", r"(?m)^\\(connect|restrict|unrestrict)[^\n]*\n?"):
        text = F.regexp_replace(text, pattern, "")
    return text


def table_definition(text: Column, table: str) -> Column:
    """The sections of a dump's text that belong to one table, by the names in their headers."""
    sections = F.split(text, r"(?m)^--\n(?=-- Name: )")
    own = F.filter(sections, lambda s: s.rlike(rf"^-- Name: {table}[ ;]|^-- Name: \S+ {table}_|ALTER TABLE ONLY \S*\b{table}\b"))
    return F.array_join(own, "--\n")


def shown_path(path: Column) -> Column:
    """`data/s/t.copy` as `s.t`; other paths as they are."""
    return F.when(path.rlike(r"^data/[^/]+/[^/]+\.copy$"), F.regexp_replace(path, r"^data/([^/]+)/([^/]+)\.copy$", "$1.$2")).otherwise(path)


def could_hold(prefix: Column, globs: Sequence[str]) -> Column:
    """Whether something at or below a directory could match a glob: the segments before the first wildcard agree with the
    directory's as far as both go. A bare name, and no globs at all, could match anywhere."""
    own = F.filter(F.split(prefix, "/"), lambda s: s != "")
    could = F.lit(not globs)
    for glob in globs:
        segments = glob.strip("/").split("/")
        fixed = next((segments[:i] for i, s in enumerate(segments) if any(c in s for c in "*?[")), segments)
        if len(segments) == 1 or not fixed:
            return F.lit(True)
        start = F.array(*map(F.lit, fixed))
        shared = F.least(F.size(own), F.lit(len(fixed)))
        could |= F.slice(own, F.lit(1), shared) == F.slice(start, F.lit(1), shared)
    return F.coalesce(could, F.lit(False))


def export_tables(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Each table as Parquet in a folder of its own, read back and counted, and a manifest written last.

    The manifest's presence makes the export whole: a reader that finds none sees no export.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").parquet(f"{folder}/data/{name}")
        rows.append((name, spark.read.parquet(f"{folder}/data/{name}").count(), json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema])))
    manifest = spark.createDataFrame(rows, "table_name string, row_count long, columns string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def read_export(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The manifest of an export and its tables."""
    manifest = spark.read.schema("table_name string, row_count long, columns string").json(f"{folder}/manifest")
    return manifest, {r.table_name: spark.read.parquet(f"{folder}/data/{r.table_name}") for r in manifest.collect()}


def lacking_copies(listings: DataFrame, item: str, store: str, first: str) -> DataFrame:
    """store, item: for every store but the first the items that the first lists and it does not.

    An item's stores are gathered once and taken from the set of all, which is one row; only what is missing comes out.
    """
    held = listings.filter(F.col(item).isNotNull() & F.col(store).isNotNull()).groupBy(item).agg(F.collect_set(store).alias("_held"))
    every = listings.filter(F.col(store) != first).agg(F.collect_set(store).alias("_all"))
    missing = held.filter(F.array_contains("_held", first)).crossJoin(F.broadcast(every))  # one row
    return missing.select(F.explode(F.array_except("_all", "_held")).alias(store), item)


def live_versions(versions: DataFrame, key: Sequence[str], version: str, modified: str, marker: str, latest: str, place: str) -> DataFrame:
    """key, version, shadowed: the newest version of each object that is no delete marker, and whether a marker that is
    the latest hides it.

    Versions of one time go by their place in the listing. An object of markers only has no version and is not shadowed.
    """
    real = F.when(~F.col(marker), F.col(version))
    newest = F.max_by(real, F.when(~F.col(marker), F.struct(F.col(modified), -F.col(place))))
    hidden = F.max(F.col(marker) & F.col(latest))
    found = versions.groupBy(*key).agg(newest.alias(version), hidden.alias("shadowed"))
    return found.withColumn("shadowed", F.col("shadowed") & F.col(version).isNotNull())


def newest_at(objects: DataFrame, place: Sequence[str], modified: str, key: str) -> DataFrame:
    """place, key of the object that was modified last at each place, of equal times the one with the greatest key."""
    return objects.groupBy(*place).agg(F.max(F.struct(F.col(modified).alias("m"), F.col(key).alias("k")))["k"].alias(key))


def segments_between(segments: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """Segments from `first` to `last` whatever their timeline, and every history file, by name.

    A segment's place in the log is its name behind the eight digits of the timeline.
    """
    place = F.substring(name, 9, 16)
    segment = F.col(name).rlike("^[0-9A-F]{24}$")
    history = F.col(name).rlike(r"^[0-9A-F]{8}\.history$")
    return segments.filter((segment & place.between(first[8:24], last[8:24])) | history)


def capture_states(tables: DataFrame, triggers: DataFrame, left_out: DataFrame, table: str = "table_name") -> DataFrame:
    """table, state of the trigger that captures a table's changes: missing, disabled or valid, and whether it captures
    all that it must (`partial` where it lacks an event); tables that are left out are not told.

    triggers: table, enabled, and events, the array of what it fires on. Of several triggers the best counts.
    """
    must = F.array(*map(F.lit, ("DELETE", "INSERT", "TRUNCATE", "UPDATE")))
    whole = F.size(F.array_except(must, F.coalesce("events", F.array().cast("array<string>")))) == 0
    rank = F.when(~F.col("enabled"), 1).when(~whole, 2).otherwise(3)
    best = triggers.groupBy(table).agg(F.max(rank).alias("_rank"))
    kept = tables.join(left_out.select(table), table, "left_anti").join(best, table, "left")
    return kept.select(table, F.when(F.col("_rank").isNull(), "missing").when(F.col("_rank") == 1, "disabled").when(F.col("_rank") == 2, "partial").otherwise("valid").alias("state"))


def export_rows(rows: DataFrame, key: str, chosen: DataFrame | None = None, **same: object) -> DataFrame:
    """Rows whose key is among the chosen ones, by a semi-join, and rows in which every column of `same` has its value;
    each row once. Without either, all rows."""
    if chosen is None and not same:
        return rows
    match = F.lit(bool(same))
    for column, value in same.items():
        match = match & F.coalesce(F.col(column) == F.lit(value), F.lit(False))
    if chosen is None:
        return rows.filter(match)
    picked = chosen.select(F.col(key).alias("_chosen")).distinct()
    return rows.join(picked, F.col(key) == F.col("_chosen"), "left").filter(F.col("_chosen").isNotNull() | match).drop("_chosen")


def deletion_turns(objects: DataFrame, key: str, suffixes: Sequence[Sequence[str]]) -> DataFrame:
    """Objects with `turn`: those with a suffix of the first group go first, and so on; what has none goes before the last
    group, whose objects describe the others and are deleted only when those are gone."""
    turn = F.lit(len(suffixes))
    for n, group in reversed(list(enumerate(suffixes, 1))):
        ends = F.lit(False)
        for s in group:
            ends |= F.endswith(key, F.lit(s))
        turn = F.when(ends, n if n < len(suffixes) else n + 1).otherwise(turn)
    return objects.withColumn("turn", turn)


def by_size(tables: DataFrame, size: str, name: Sequence[str]) -> DataFrame:
    """Tables with `turn`, the largest first, of equal size by name; an unknown size comes last."""
    return tables.withColumn("turn", F.row_number().over(Window.orderBy(F.col(size).desc_nulls_last(), *name)))


def batches_by_id(rows: DataFrame, id_: str, size: int) -> DataFrame:
    """Rows with `batch`, from 0: `size` rows each in order of id, whatever gaps the ids have.

    Ranks come from counts of blocks of ids and a window within each block, so no task sorts all rows.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(id_) / (size * 16)))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(id_)) - 1
    ranked = blocked.withColumn("_rank", rank).join(before, "_block")
    return ranked.withColumn("batch", F.floor((F.col("_before") + F.col("_rank")) / size)).drop("_block", "_rank", "_before")


def parts_in_order(entries: DataFrame, archive: Sequence[str], place: str, name: str, part: str) -> DataFrame:
    """archive, problems: entries that break an archive's order: names that do not rise strictly by their bytes, and parts
    of one name that do not follow on from 0."""
    w = Window.partitionBy(*archive).orderBy(place)
    was, last = F.lag(F.encode(name, "utf-8")).over(w), F.lag(part).over(w)
    now = F.encode(F.col(name), "utf-8")
    follows = (was == now) & (F.col(part) == last + 1)
    begins = (was.isNull() | (now > was)) & (F.coalesce(F.col(part), F.lit(0)) == 0)
    marked = entries.withColumn("_bad", ~F.coalesce(follows, F.lit(False)) & ~begins)
    return marked.groupBy(*archive).agg(F.count(F.when(F.col("_bad"), 1)).alias("problems"))
