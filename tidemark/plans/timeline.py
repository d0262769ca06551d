"""Histories, retention, calendars, logs and recovery over the tables at hand."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import lsn
from tidemark.operators import delta, history, logs, restores, retention
from tidemark.plans.registry import catalog
from tidemark.session import table as t

CATALOG, query = catalog()

# Histories: a series is (surface_id, root); a snapshot's place is its order in time; every 4th snapshot is complete, the
# others list what changed. An event is a path's latest entry in a snapshot whose content differs from before.
_PLACES = """snaps AS (SELECT surface_id, root, snapshot_id, min(epoch_id) AS epoch_id, coalesce(max(created_at), min(recorded_at)) AS taken FROM snapshot_entries WHERE path IS NOT NULL GROUP BY 1, 2, 3),
places AS (SELECT *, CAST(row_number() OVER (PARTITION BY surface_id, root ORDER BY taken, snapshot_id) AS INTEGER) AS ord FROM snaps),
ents AS (SELECT e.surface_id, e.root, e.path, p.ord, arg_max(e.type, e.recorded_at) AS type, arg_max(coalesce(lower(e.value), ''), e.recorded_at) AS value FROM snapshot_entries e JOIN places p USING (surface_id, root, snapshot_id) WHERE e.path IS NOT NULL GROUP BY 1, 2, 3, 4),
marked AS (SELECT *, lag(ord) OVER w AS before, lag(type || ' ' || value) OVER w AS content FROM ents WINDOW w AS (PARTITION BY surface_id, root, path ORDER BY ord)),
runs AS (SELECT *, sum(CASE WHEN before + 1 = ord AND content = type || ' ' || value THEN 0 ELSE 1 END) OVER (PARTITION BY surface_id, root, path ORDER BY ord ROWS UNBOUNDED PRECEDING) AS run FROM marked),
made AS (SELECT surface_id, root, path, run, min(ord) AS first, max(ord) AS last FROM runs GROUP BY 1, 2, 3, 4),
newest AS (SELECT surface_id, root, max(ord) AS newest FROM places GROUP BY 1, 2)"""


def _placed(spark, d):
    rows = t(spark, d, "snapshot_entries").filter("path IS NOT NULL")
    each = rows.groupBy("surface_id", "root", "snapshot_id").agg(F.min("epoch_id").alias("epoch_id"), F.coalesce(F.max("created_at"), F.min("recorded_at")).alias("taken"))
    return rows, each.withColumn("ord", F.row_number().over(Window.partitionBy("surface_id", "root").orderBy("taken", "snapshot_id")))


def _catalog(spark, d, complete_every=4):
    """Events and snapshots of a change log of which every `complete_every`-th entry is complete, the others deltas."""
    rows, places = _placed(spark, d)
    series = ["surface_id", "root"]
    joined = rows.join(places.select(*series, "snapshot_id", "ord"), [*series, "snapshot_id"])
    latest = joined.groupBy(*series, "path", "ord").agg(F.max_by(F.struct("type", F.coalesce(F.lower("value"), F.lit("")).alias("value")), "recorded_at").alias("c")).select(*series, "path", "ord", "c.*")
    w = Window.partitionBy(*series, "path").orderBy("ord")
    seen = latest.withColumn("before", F.lag(F.struct("ord", "type", "value")).over(w)).withColumn("next", F.lead("ord").over(w))
    same = (F.col("before.ord") + 1 == F.col("ord")) & (F.col("before.type") == F.col("type")) & (F.col("before.value") == F.col("value"))
    full = F.col("ord") % complete_every == 1
    newest = F.max("ord").over(Window.partitionBy(*series))
    places = places.withColumn("newest", newest)
    seen = seen.join(places.select(*series, "ord", "newest"), [*series, "ord"])
    text = F.lit(None).cast("string")
    event = lambda ord_, name, type_, value: F.struct(ord_.alias("ord"), F.lit(name).alias("event"), type_.alias("type"), value.alias("value"))
    present = F.when(full | ~F.coalesce(same, F.lit(False)), event(F.col("ord"), "present", F.col("type"), F.col("value")))
    left = (F.coalesce("next", F.lit(0)) != F.col("ord") + 1) & (F.col("ord") < F.col("newest")) & ((F.col("ord") + 1) % complete_every != 1)
    gone = F.when(left, event(F.col("ord") + 1, "deleted", text, text))
    events = seen.select(*series, "path", F.explode(F.array_compact(F.array(present, gone))).alias("e")).select(*series, "path", "e.*")
    return events, places.select(*series, "ord", "epoch_id", full.alias("complete"))


@query(f"""WITH {_PLACES}
SELECT m.surface_id, m.root, m.path, row_number() OVER (PARTITION BY m.surface_id, m.root, m.path ORDER BY first) AS version, first, last, last - first + 1 AS snapshots,
  (SELECT count(DISTINCT epoch_id) FROM places p WHERE p.surface_id = m.surface_id AND p.root = m.root AND p.ord BETWEEN m.first AND m.last) AS epochs, last = newest AS "current" FROM made m JOIN newest n ON n.surface_id = m.surface_id AND n.root = m.root""")
def history_versions(spark, d):
    """Versions of each path, replayed from deltas and complete entries."""
    return history.version_islands(*_catalog(spark, d), ["surface_id", "root"], "path", ["type", "value"], "epoch_id")


@query(f"""WITH {_PLACES} SELECT m.surface_id, m.root, m.path, max(last) AS last FROM made m JOIN newest n ON n.surface_id = m.surface_id AND n.root = m.root GROUP BY 1, 2, 3 HAVING max(last) < max(newest)""")
def history_deleted(spark, d):
    """paths that are gone, with the last snapshot that held them."""
    versions = history.version_islands(*_catalog(spark, d), ["surface_id", "root"], "path", ["type", "value"], "epoch_id")
    return history.deleted_only(versions, ["surface_id", "root"], "path")


@query(f"WITH {_PLACES} SELECT surface_id, root, path, type, value FROM ents WHERE ord = 3")
def catalog_as_of(spark, d):
    """The state as of the third snapshot; a series with fewer has none there."""
    events, snapshots = _catalog(spark, d)
    has = snapshots.filter("ord = 3").select("surface_id", "root")
    return history.state_as_of(events, snapshots, ["surface_id", "root"], "path", 3).join(has, ["surface_id", "root"], "left_semi").select("surface_id", "root", "path", "type", "value")


@query(f"WITH {_PLACES} SELECT surface_id, root, path, ord, type, value FROM (SELECT *, row_number() OVER (PARTITION BY surface_id, root, path ORDER BY ord DESC) AS rn FROM ents) WHERE rn = 1")
def history_newest_version(spark, d):
    """For each path the newest snapshot that holds it."""
    rows, places = _placed(spark, d)
    series = ["surface_id", "root"]
    joined = rows.join(places.select(*series, "snapshot_id", "ord"), [*series, "snapshot_id"])
    content = F.struct("type", F.coalesce(F.lower("value"), F.lit("")).alias("value"))
    best = joined.groupBy(*series, "path").agg(F.max_by(F.struct("ord", content.alias("c")), F.struct("ord", "recorded_at")).alias("b"))
    return best.select(*series, "path", "b.ord", "b.c.type", "b.c.value")


_GLOBS = ["archive", "**/*.log", "media/**/spool", "photo-?*.png"]


@query(r"""SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(archive(/.*)?|(.+/)?[^/]*\.log(/.*)?|media/([^/]+/)*spool(/.*)?|(.+/)?photo-[^/][^/]*\.png(/.*)?|(.+/)?archive(/.*)?)$')""")
def select_paths(spark, d):
    """paths chosen by globs; a directory takes along what is below it."""
    return t(spark, d, "files").select("path").distinct().filter(history.selected(F.col("path"), _GLOBS))


@query(r"""WITH c AS (SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(.+/)?[^/]*\.log(/.*)?$')),
a AS (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM c, range(1, 60) r(n) WHERE n <= len(string_split(path, '/')))
SELECT path, CAST(len(string_split(path, '/')) AS INTEGER) AS depth FROM a""")
def select_with_ancestors(spark, d):
    """Chosen paths and the directories on the way."""
    return history.with_ancestors(t(spark, d, "files"), "path", ["**/*.log"])


@query(r"""SELECT count(*) AS kept FROM (SELECT DISTINCT epoch_id, path FROM files) WHERE NOT (regexp_matches(path, '^(.+/)?[^/]*\.tmp(/.*)?$') OR regexp_matches(path, '^media(/.*)?$'))""")
def exclude_paths(spark, d):
    """files left after excludes."""
    rows = t(spark, d, "files").select("epoch_id", "path").distinct()
    return rows.filter(~history.selected(F.col("path"), ["**/*.tmp", "/media/**"]) & ~F.col("path").rlike("^media(/.*)?$")).agg(F.count(F.lit(1)).alias("kept"))


# Retention over the events of each user: base 7 days, daily 14, weekly 4, monthly 12.
_GFS = """WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS d, row_number() OVER (PARTITION BY user_id, strftime(ts, '%G-%V') ORDER BY ts, event_id) AS w, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS m FROM events),
k AS (SELECT *, ts + INTERVAL 7 DAY AS kb, ts + INTERVAL 14 DAY AS kd, ts + INTERVAL 28 DAY AS kw, date_trunc('month', ts) + INTERVAL 12 MONTH + (ts - date_trunc('month', ts)) AS km FROM e)
SELECT event_id, CASE WHEN m = 1 THEN 'monthly' WHEN w = 1 THEN 'weekly' WHEN d = 1 THEN 'daily' ELSE 'base' END AS tier, CASE WHEN m = 1 THEN km WHEN w = 1 THEN kw WHEN d = 1 THEN kd ELSE kb END AS keep_until FROM k"""


@query(_GFS)
def retention_tiers(spark, d):
    """Tier of each backup and how long it is kept."""
    found = retention.tiers(t(spark, d, "events"), ["user_id"], "ts", 7, 14, 4, 12, ["event_id"])
    return found.select("event_id", "tier", F.col("keep_until").cast("timestamp_ntz").alias("keep_until"))


_DRILLS = "d AS (SELECT user_id, event_id, ts, CASE WHEN value > 50 THEN true WHEN value > 10 THEN false END AS passed FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM d)"


@query(f"""WITH {_DRILLS}, x AS (SELECT *, coalesce(bool_or(rank <= 3 AND passed) OVER (PARTITION BY user_id), false) AS ok, coalesce(bool_or(rank = 3 AND passed = false) OVER (PARTITION BY user_id), false) AS bad, min(CASE WHEN rank > 3 AND passed THEN rank END) OVER (PARTITION BY user_id) AS spare FROM r)
SELECT event_id, rank, rank <= 3 OR coalesce(NOT ok AND bad AND rank = spare, false) AS kept FROM x""")
def retention_keep(spark, d):
    """The newest three and the drill that must not be lost."""
    rows = t(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("value") > 50, True).when(F.col("value") > 10, False).alias("passed"))
    return retention.keep_newest(rows, ["user_id"], "ts", "passed", 3, ["event_id"]).select("event_id", "rank", "kept")


@query("""SELECT outcome, count(*) AS epochs FROM (SELECT CASE WHEN retention_mode = 'kept' OR later_retain_until IS NULL THEN 'held' WHEN TIMESTAMP '2026-01-01' < later_retain_until THEN 'locked' WHEN TIMESTAMP '2026-01-01' < later_retain_until + INTERVAL 24 HOUR THEN 'grace' ELSE 'deleted' END AS outcome FROM (SELECT DISTINCT * FROM epochs)) GROUP BY 1""")
def prune_report(spark, d):
    """What a prune would do with the epochs."""
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    rows = t(spark, d, "epochs").distinct()
    return rows.groupBy(retention.prune_outcome(F.col("later_retain_until"), F.col("retention_mode") == "kept", now).alias("outcome")).agg(F.count(F.lit(1)).alias("epochs"))


@query("""WITH s AS (SELECT epoch_id, surface_id, snapshot_id, min(recorded_at) AS at_, min(recorded_at) + INTERVAL 60 DAY AS expires FROM snapshot_entries GROUP BY 1, 2, 3),
x AS (SELECT *, at_ = min(at_) OVER (PARTITION BY epoch_id) AS opening, at_ = max(at_) OVER (PARTITION BY surface_id) AS newest, expires <= TIMESTAMP '2026-01-01' AS expired FROM s)
SELECT epoch_id, CASE WHEN bool_and(expired OR opening) AND NOT bool_or(newest) THEN 'delete' ELSE 'keep' END AS later_objects, CASE WHEN bool_and(expired) AND NOT bool_or(newest) THEN 'delete' ELSE 'keep' END AS opening_object FROM x GROUP BY 1""")
def prune_epochs(spark, d):
    """What may go of each epoch."""
    s = t(spark, d, "snapshot_entries").groupBy("epoch_id", "surface_id", "snapshot_id").agg(F.min("recorded_at").alias("taken"))
    s = s.withColumn("expires", F.col("taken") + F.expr("INTERVAL 60 DAYS"))
    return retention.epoch_prune(s, ["epoch_id"], ["surface_id"], "taken", "expires", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))


_OVER = "date_trunc('month', opened_at) + INTERVAL 1 MONTH + (opened_at - date_trunc('month', opened_at))"


@query(f"""SELECT DISTINCT epoch_id, {_OVER} AS planned_end, {_OVER} + to_days(t_mid_days) AS later_retain_until, opening_retain_until + INTERVAL 3 DAY AS opening_retain_until, CAST(date_trunc('month', opened_at) + INTERVAL 1 MONTH AS DATE) AS next_month FROM epochs""")
def epoch_dates(spark, d):
    """Dates that follow from an epoch's opening; months overflow instead of being cut."""
    e = t(spark, d, "epochs")
    dates = retention.epoch_dates(F.col("opened_at"), F.col("opening_retain_until"), F.col("t_mid_days"))
    return e.select("epoch_id", *[v.cast("timestamp_ntz").alias(k) for k, v in dates.items()], cal.next_month_start(F.col("opened_at")).alias("next_month")).distinct()


@query("""SELECT epoch_id, least(planned_end, opening_retain_until) AS retain_until, coalesce(planned_end > opening_retain_until, false) AS capped,
  CASE WHEN recipient IS NULL THEN 'no recipient' WHEN planned_end <= TIMESTAMP '2026-01-01' THEN 'past its end' WHEN chunker_avg > 65536 THEN 'chunker changed' WHEN opening_retain_until < TIMESTAMP '2026-03-01' THEN 'lock too short' ELSE 'continue' END AS decision FROM (SELECT DISTINCT * FROM epochs)""")
def epoch_decision(spark, d):
    """Capped ends and the first reason for a new epoch."""
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    until, capped = retention.retain_cap(F.col("planned_end"), F.col("opening_retain_until"))
    reasons = {"no recipient": F.col("recipient").isNull(), "past its end": F.col("planned_end") <= at("2026-01-01 00:00:00"), "chunker changed": F.col("chunker_avg") > 65536, "lock too short": F.col("opening_retain_until") < at("2026-03-01 00:00:00")}
    return t(spark, d, "epochs").distinct().select("epoch_id", until.alias("retain_until"), capped.alias("capped"), retention.first_reason(reasons, "continue").alias("decision"))


_WINDOWS = "22:00-02:00, 12:00-12:30, 02:00-03:00"


@query("""WITH m AS (SELECT event_id, date_trunc('day', ts) AS day, hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT event_id, m >= 1320 OR m < 180 OR (m >= 720 AND m < 750) AS inside, CASE WHEN m >= 1320 THEN day + INTERVAL 27 HOUR WHEN m < 180 THEN day + INTERVAL 3 HOUR WHEN m >= 720 AND m < 750 THEN day + INTERVAL 750 MINUTE END AS until FROM m""")
def blackout_at(spark, d):
    """Moments inside of blackout windows and when those end, windows that touch joined."""
    w = cal.parse_blackout(_WINDOWS)
    e = t(spark, d, "events")
    return e.select("event_id", cal.in_blackout(F.col("ts"), w).alias("inside"), cal.blackout_end(F.col("ts"), w).cast("timestamp_ntz").alias("until"))


@query("SELECT n_regionkey, CAST(sum(30 * (n_nationkey % 5 + 1)) AS BIGINT) AS minutes, count(*) AS windows FROM nation GROUP BY 1")
def blackout_total(spark, d):
    """Total length of each surface's windows, not of their union; windows may pass midnight."""
    n = F.col("n_nationkey")
    rows = t(spark, d, "nation").select("n_regionkey", (n * 57 % 1440).alias("a"), ((n * 57 + 30 * (n % 5 + 1)) % 1440).alias("b"))
    return cal.blackout_minutes(rows, ["n_regionkey"], "a", "b")


@query("SELECT user_id, CAST(min(g) AS BIGINT) AS shortest_us, CAST(max(g) AS BIGINT) AS longest_us FROM (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS g FROM events) WHERE g IS NOT NULL GROUP BY 1")
def schedule_gaps(spark, d):
    """Shortest and longest gap between the runs of each user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = t(spark, d, "events").select("user_id", (F.lead(us).over(w) - us).alias("g")).filter("g IS NOT NULL")
    return gaps.groupBy("user_id").agg(F.min("g").alias("shortest_us"), F.max("g").alias("longest_us"))


@query("""WITH m AS (SELECT event_id, ts, date_trunc('day', ts) AS day, epoch(ts) - epoch(date_trunc('day', ts)) AS s FROM events)
SELECT event_id, CASE WHEN s < 7200 THEN day + INTERVAL 2 HOUR ELSE day + INTERVAL 26 HOUR END AS daily,
  CASE WHEN s < 1800 THEN day + INTERVAL 30 MINUTE ELSE day + INTERVAL 30 MINUTE + INTERVAL 6 HOUR * CAST(floor((s - 1800) / 21600) + 1 AS INTEGER) END AS quarterly, date_trunc('month', ts) + INTERVAL 1 MONTH AS monthly,
  CASE WHEN isodow(ts) <= 5 AND s < 10800 THEN day + INTERVAL 3 HOUR WHEN isodow(ts) <= 4 OR isodow(ts) = 7 THEN day + INTERVAL 27 HOUR WHEN isodow(ts) = 5 THEN day + INTERVAL 75 HOUR ELSE day + INTERVAL 51 HOUR END AS workdays FROM m""")
def schedule_next(spark, d):
    """The next run of each schedule after a moment."""
    schedules = {"daily": "at 02:00", "quarterly": "30 */6 * * *", "monthly": "0 0 1 * *", "workdays": "0 3 * * 1-5"}
    return t(spark, d, "events").select("event_id", *[cal.next_run(F.col("ts"), text).alias(name) for name, text in schedules.items()])


@query("""SELECT DISTINCT user_id, CASE WHEN n = 0 THEN 'never' WHEN last > TIMESTAMP '2024-01-20' THEN 'due: clock went back' WHEN fails BETWEEN 1 AND 3 AND last + INTERVAL 5 MINUTE <= TIMESTAMP '2024-01-20' THEN 'retry' WHEN last + INTERVAL 1 DAY <= TIMESTAMP '2024-01-20' THEN 'due' ELSE 'wait' END AS state
FROM (SELECT user_id, count(*) AS n, max(ts) AS last, count(*) FILTER (event_type = 'error') AS fails FROM events GROUP BY 1)""")
def schedule_due(spark, d):
    """Which runs are due."""
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    each = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.count(F.when(F.col("event_type") == "error", 1)).alias("fails"))
    reasons = {"never": F.col("n") == 0, "due: clock went back": F.col("last") > now, "retry": F.col("fails").between(1, 3) & (F.col("last") + F.expr("INTERVAL 5 MINUTES") <= now), "due": F.col("last") + F.expr("INTERVAL 1 DAY") <= now}
    return each.select("user_id", retention.first_reason(reasons, "wait").alias("state"))


# Logs: an event's segment starts where the one before ended, except for every 97th, which leaves a hole.
_SEGS = "g AS (SELECT user_id, event_id AS file, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_id % 97 <> 0), s AS (SELECT user_id, CAST(k // 10 AS INTEGER) AS file, k AS n, CASE WHEN k % 10 = 0 THEN 4 ELSE (k % 10) * 100 END AS s, (k % 10 + 1) * 100 AS e, k % 10 = 9 AS rotates FROM (SELECT *, k + CASE WHEN k > 40 THEN 3 ELSE 0 END AS k2 FROM g))"


def _segments(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    k = t(spark, d, "events").filter("event_id % 97 <> 0").select("user_id", F.row_number().over(w).cast("long").alias("n"))
    n = F.col("n")
    return k.select("user_id", F.floor(n / 10).cast("int").alias("file"), "n", F.when(n % 10 == 0, 4).otherwise((n % 10) * 100).cast("long").alias("s"), ((n % 10 + 1) * 100).alias("e"), (n % 10 == 9).alias("rotates")).filter("n % 37 <> 5")


@query(f"""WITH {_SEGS}, h AS (SELECT * FROM s WHERE n % 37 <> 5), b AS (SELECT *, lag(file) OVER w AS bf, lag(e) OVER w AS be, lag(rotates) OVER w AS br FROM h WINDOW w AS (PARTITION BY user_id ORDER BY file, s, e)),
m AS (SELECT *, bf IS NOT NULL AND NOT ((bf = file AND be = s) OR (br AND bf + 1 = file AND s = 4)) AS gap FROM b)
SELECT user_id, n, gap, 1 + sum(CAST(gap AS INTEGER)) OVER (PARTITION BY user_id ORDER BY file, s, e ROWS UNBOUNDED PRECEDING) AS run FROM m""")
def log_runs(spark, d):
    """Continuous runs of log segments and the gaps between them."""
    found = logs.stream_runs(_segments(spark, d), ["user_id"], "file", "s", "e", "rotates", bucket=F.floor(F.col("file") / 2))
    return found.select("user_id", "n", "gap", F.col("run").cast("long").alias("run"))


@query(f"WITH {_SEGS}, h AS (SELECT DISTINCT user_id, n FROM s WHERE n % 37 <> 5), x AS (SELECT user_id, n, lead(n) OVER (PARTITION BY user_id ORDER BY n) AS m FROM h) SELECT user_id, n + 1 AS first_missing, m - 1 AS last_missing FROM x WHERE m > n + 1")
def log_missing(spark, d):
    """Holes in the numbers of segments."""
    return logs.missing_numbers(_segments(spark, d), ["user_id"], "n")


_BASES9 = "b AS (SELECT user_id, n AS base_id, n AS first_seg, n + 4 AS end_seg FROM s WHERE n % 20 = 3)"


@query(f"""WITH {_SEGS}, h AS (SELECT DISTINCT user_id, n FROM s WHERE n % 37 <> 5), i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM h), r AS (SELECT user_id, min(n) AS a, max(n) AS z FROM i GROUP BY user_id, g), {_BASES9}
SELECT b.user_id, base_id, z AS reach, coalesce(z >= end_seg, false) AS usable FROM b LEFT JOIN r ON r.user_id = b.user_id AND first_seg BETWEEN a AND z""")
def recovery_reach(spark, d):
    """How far each base can be replayed."""
    every = t(spark, d, "events").filter("event_id % 97 <> 0").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"))
    bases = every.filter("n % 20 = 3").select("user_id", F.col("n").alias("base_id"), F.col("n").alias("first_seg"), (F.col("n") + 4).alias("end_seg"))
    return logs.recovery_window(bases, _segments(spark, d).select("user_id", F.col("n").alias("seg")), ["user_id"])


@query(f"""WITH {_SEGS}, h AS (SELECT DISTINCT user_id, n FROM s WHERE n % 37 <> 5), i AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM h), r AS (SELECT user_id, min(n) AS a, max(n) AS z FROM i GROUP BY user_id, g), {_BASES9},
x AS (SELECT b.user_id, base_id, z, row_number() OVER (PARTITION BY b.user_id ORDER BY z DESC, first_seg) AS rn FROM b JOIN r ON r.user_id = b.user_id AND first_seg BETWEEN a AND z WHERE z >= end_seg) SELECT user_id, base_id, z AS window_end FROM x WHERE rn = 1""")
def recovery_window(spark, d):
    """The base that reaches farthest."""
    every = t(spark, d, "events").filter("event_id % 97 <> 0").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("n"))
    bases = every.filter("n % 20 = 3").select("user_id", F.col("n").alias("base_id"), F.col("n").alias("first_seg"), (F.col("n") + 4).alias("end_seg"))
    reach = logs.recovery_window(bases, _segments(spark, d).select("user_id", F.col("n").alias("seg")), ["user_id"])
    return logs.windows(reach, bases, ["user_id"])


_AS_OF = """SELECT e.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = e.user_id AND b.event_id % 5 = 0 AND b.ts = (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_id % 5 = 0 AND x.ts {op} e.ts)) AS base_id FROM events e WHERE e.event_type = 'purchase'"""


def _as_of(spark, d, strict, bucket=None):
    e = t(spark, d, "events")
    right = e.filter("event_id % 5 = 0").select("user_id", F.col("ts").alias("ended"), F.col("event_id").alias("base_id"))
    return logs.as_of(e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), right, ["user_id"], "ts", "ended", ["base_id"], strict, bucket).select("event_id", "base_id")


@query(_AS_OF.format(op="<"))
def base_as_of(spark, d):
    """The newest base strictly before each target."""
    return _as_of(spark, d, True)


@query(_AS_OF.format(op="<="))
def stream_base_as_of(spark, d):
    """The newest base at or before each target."""
    return _as_of(spark, d, False)


@query(_AS_OF.format(op="<="))
def base_as_of_in_buckets(spark, d):
    """J19, J20 for keys with very many rows: each key's time is cut into days, and days are joined by what they end with."""
    return _as_of(spark, d, False, F.to_date("at_"))


@query(r"""WITH b AS (SELECT DISTINCT base_id, surface_id, timeline, CAST('0x' || split_part(trim(end_lsn, E' \n\t\r'), '/', 1) AS HUGEINT) * 4294967296 + CAST('0x' || split_part(trim(end_lsn, E' \n\t\r'), '/', 2) AS HUGEINT) AS p FROM bases WHERE regexp_matches(end_lsn, '^\s*[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\s*$')),
l AS (SELECT surface_id, timeline, max(p) AS p FROM b GROUP BY 1, 2) SELECT surface_id, timeline, max(base_id) AS base_id, CAST(max(p) AS DECIMAL(20, 0)) AS position FROM b JOIN l USING (surface_id, timeline, p) GROUP BY 1, 2""")
def base_newest(spark, d):
    """J19 by position, C8: the base that ends last on each timeline."""
    b = t(spark, d, "bases").select("surface_id", "timeline", "base_id", lsn.biased(F.col("end_lsn")).alias("p")).filter("p IS NOT NULL")
    best = b.groupBy("surface_id", "timeline").agg(F.max(F.struct("p", "base_id")).alias("b"))
    return best.select("surface_id", "timeline", "b.base_id", lsn.as_decimal(F.col("b.p")).alias("position"))


_TX = "x AS (SELECT *, 1 + coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tx FROM events)"


def _tx(spark, d):
    return logs.transactions(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.date_trunc("day", "ts"))


@query(f"WITH {_TX}, a AS (SELECT user_id, tx, count(*) AS events, max(CASE WHEN event_type = 'purchase' THEN ts END) AS c, max(date_trunc('second', ts)) AS h FROM x GROUP BY 1, 2) SELECT user_id, tx, events, coalesce(c, h) AS at, c IS NOT NULL AS exact FROM a")
def tx_groups(spark, d):
    """Transactions of a log and their times."""
    rows = _tx(spark, d).withColumn("tx", F.col("tx").cast("long")).withColumns({"commit": F.when(F.col("event_type") == "purchase", F.col("ts")), "second": F.date_trunc("second", "ts").cast("timestamp_ntz")})
    return logs.transaction_times(rows, ["user_id"], "commit", "second")


@query(f"WITH {_TX}, a AS (SELECT user_id, tx, count(*) AS events, max(CASE WHEN event_type = 'purchase' THEN ts END) AS c, max(date_trunc('second', ts)) AS h FROM x GROUP BY 1, 2) SELECT user_id, tx, CASE WHEN c IS NOT NULL THEN c <= TIMESTAMP '2024-01-15' ELSE h + INTERVAL 1 SECOND <= TIMESTAMP '2024-01-15' END AS replays FROM a")
def tx_replay(spark, d):
    """which transactions belong before a moment."""
    rows = _tx(spark, d).withColumn("tx", F.col("tx").cast("long")).withColumns({"commit": F.when(F.col("event_type") == "purchase", F.col("ts")), "second": F.date_trunc("second", "ts").cast("timestamp_ntz")})
    times = logs.transaction_times(rows, ["user_id"], "commit", "second")
    return times.select("user_id", "tx", logs.replays_by(F.col("at"), F.col("exact"), F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("replays"))


@query(f"WITH {_TX}, o AS (SELECT *, CASE WHEN event_type IN ('view', 'login') THEN NULL ELSE event_id % 2 = 0 END AS own FROM x) SELECT event_id, tx FROM o WHERE coalesce(own, true) AND (user_id, tx) IN (SELECT user_id, tx FROM o WHERE own)")
def tx_own(spark, d):
    """F16: transactions with something of one's own, without what is others'."""
    own = F.when(~F.col("event_type").isin("view", "login"), F.col("event_id") % 2 == 0)
    return logs.own_transactions(_tx(spark, d), ["user_id", "tx"], own).select("event_id", F.col("tx").cast("long").alias("tx"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS own_operations, count(*) AS operations FROM events GROUP BY 1")
def nested_operations(spark, d):
    """operations inside of transactions that touch one's own database."""
    tx = t(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 100).alias("tx"))  # at most 100 operations a transaction
    ops = tx.agg(F.collect_list(F.struct(F.concat("event_type", F.lit(".t")).alias("ns"))).alias("ops"))
    own, every = F.size(logs.nested_own(F.col("ops"), "purchase")), F.size("ops")
    return ops.groupBy("user_id").agg(F.sum(own).alias("own_operations"), F.sum(every).alias("operations"))


@query("""WITH l AS (SELECT user_id AS c_custkey, event_type AS c_mktsegment, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-15')
SELECT c_custkey, coalesce(l.c_mktsegment, c.c_mktsegment) AS c_mktsegment FROM (SELECT c_custkey, c_mktsegment FROM customer UNION SELECT c_custkey, NULL FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)) c LEFT JOIN (SELECT * FROM l WHERE rn = 1) l USING (c_custkey) WHERE coalesce(l.c_mktsegment, '') <> 'error'""")
def pitr_state(spark, d):
    """Customers as of a moment, from a base and a log; errors are deletions."""
    base = t(spark, d, "customer").select("c_custkey", "c_mktsegment", F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("event_id"))
    log = t(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), "ts", "event_id")
    return logs.state_at(base, log, ["c_custkey"], "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.col("c_mktsegment") == "error", "event_id").select("c_custkey", "c_mktsegment")


@query("""WITH a AS (SELECT event_type, count(*) FILTER (ts <= TIMESTAMP '2024-01-10') AS b, count(*) FILTER (ts <= TIMESTAMP '2024-01-12') AS f, count(*) FILTER (ts <= TIMESTAMP '2024-01-11') AS c FROM events GROUP BY 1) SELECT event_type, least(b, f) AS low, greatest(b, f) AS high, CASE WHEN event_type = 'click' THEN f + 1 ELSE c END AS counted, CASE WHEN event_type = 'click' THEN false ELSE c BETWEEN least(b, f) AND greatest(b, f) END AS holds FROM a""")
def count_band(spark, d):
    """Counts between two that bracket a moment."""
    e = t(spark, d, "events")
    upto = lambda s: F.count(F.when(F.col("ts") <= F.lit(s).cast("timestamp_ntz"), 1))
    points = e.groupBy("event_type").agg(upto("2024-01-10 00:00:00").alias("before"), upto("2024-01-12 00:00:00").alias("after"))
    counted = e.groupBy("event_type").agg(F.when(F.col("event_type") == "click", upto("2024-01-12 00:00:00") + 1).otherwise(upto("2024-01-11 00:00:00")).alias("counted"))
    return logs.count_band(points, counted, ["event_type"])


@query("""WITH b AS (SELECT o_orderkey AS base_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey - o_orderkey % 4 END AS full_id, o_custkey AS start_at, o_orderkey * 7 AS bytes FROM orders WHERE o_orderkey % 28 <> 0),
c AS (SELECT b.*, f.start_at + CASE WHEN b.base_id % 9 = 0 THEN 1 ELSE 0 END AS full_start_at, f.start_at AS fs, f.bytes AS fb FROM b LEFT JOIN b f ON f.base_id = b.full_id AND f.full_id IS NULL)
SELECT base_id, CASE WHEN full_id IS NULL THEN 'full' WHEN fs IS NULL THEN 'missing_full' WHEN full_start_at <> fs THEN 'wrong_start' ELSE 'whole' END AS status, bytes + coalesce(fb, 0) AS chain_bytes FROM c""")
def incremental_chain(spark, d):
    """Incremental bases and their full ones."""
    o = t(spark, d, "orders").filter("o_orderkey % 28 <> 0").select(F.col("o_orderkey").alias("base_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - F.col("o_orderkey") % 4).alias("full_id"), F.col("o_custkey").alias("start_at"), (F.col("o_orderkey") * 7).alias("bytes"))
    starts = o.filter("full_id IS NULL").select(F.col("base_id").alias("full_id"), F.col("start_at").alias("fs"))
    b = o.join(starts, "full_id", "left").withColumn("full_start_at", F.col("fs") + F.when(F.col("base_id") % 9 == 0, 1).otherwise(0)).drop("fs")
    return logs.incremental_chain(b)


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'bundled' ELSE 'pushed' END AS "from" FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def segments_listed(spark, d):
    """Union of bundled and pushed segments, the first list wins."""
    e = t(spark, d, "events").select("event_id")
    return logs.first_wins([e.filter("event_id % 2 = 0").withColumn("from", F.lit("bundled")), e.filter("event_id % 3 = 0").withColumn("from", F.lit("pushed"))], ["event_id"])


@query("""SELECT event_id, sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 50 <= 500 AS kept FROM (SELECT *, CAST(length(event_type) AS BIGINT) AS n FROM events)""")
def spool_drop_oldest(spark, d):
    """What stays of a bounded queue."""
    e = t(spark, d, "events").withColumn("n", F.length("event_type").cast("long"))
    return retention.drop_oldest(e, ["user_id"], "event_id", "n", 500, 50).select("event_id", "kept")


@query("""WITH k AS (SELECT DISTINCT epoch_id, store FROM objects), f AS (SELECT epoch_id FROM k WHERE store = 'first') SELECT c.store, f.epoch_id FROM f CROSS JOIN (SELECT DISTINCT store FROM k WHERE store <> 'first') c WHERE (f.epoch_id, c.store) NOT IN (SELECT epoch_id, store FROM k)""")
def copies_missing(spark, d):
    """Epochs of the first store that a copy lacks."""
    return restores.lacking_copies(t(spark, d, "objects"), "epoch_id", "store", "first")


_VERSIONS = "v AS (SELECT DISTINCT store, key, etag, listed_at, modified, size IS NULL AS marker FROM objects), o AS (SELECT *, row_number() OVER (PARTITION BY store, key ORDER BY listed_at DESC, modified DESC NULLS LAST, etag DESC NULLS LAST, marker DESC) AS place FROM v)"


def _versions(spark, d):
    """Every listing of a key as a version of it: one without a size is a delete marker, the newest listing the latest."""
    v = t(spark, d, "objects").select("store", "key", "etag", "listed_at", "modified", F.col("size").isNull().alias("marker")).distinct()
    w = Window.partitionBy("store", "key").orderBy(F.desc("listed_at"), F.desc_nulls_last("modified"), F.desc_nulls_last("etag"), F.desc("marker"))
    return v.withColumn("place", F.row_number().over(w)).withColumn("latest", F.col("place") == 1)


@query(f"""WITH {_VERSIONS}, n AS (SELECT store, key, etag, row_number() OVER (PARTITION BY store, key ORDER BY listed_at DESC, place) AS rn FROM o WHERE NOT marker)
SELECT k.store, k.key, n.etag, k.hidden AND n.etag IS NOT NULL AS shadowed FROM (SELECT store, key, bool_or(marker AND place = 1) AS hidden FROM o GROUP BY 1, 2) k LEFT JOIN n ON n.store = k.store AND n.key = k.key AND n.rn = 1""")
def live_version(spark, d):
    """The newest version of each object that is no delete marker, and whether one hides it."""
    return restores.live_versions(_versions(spark, d), ["store", "key"], "etag", "listed_at", "marker", "latest", "place")


@query("SELECT store, epoch_id, arg_max(key, (modified, key)) AS key FROM objects WHERE modified IS NOT NULL GROUP BY 1, 2")
def newest_object(spark, d):
    """The object that was modified last at each place, of equal times the one with the greatest key."""
    rows = t(spark, d, "objects").filter("modified IS NOT NULL")
    return restores.newest_at(rows, ["store", "epoch_id"], "modified", "key").select("store", "epoch_id", "key")


_CHAIN = "c AS (SELECT n_regionkey, n_nationkey, md5(n_name) AS certificate_hash, CASE WHEN n_nationkey = 12 THEN 'broken' ELSE lag(md5(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) END AS prev_hash FROM nation)"


@query(f"WITH {_CHAIN} SELECT n_nationkey, coalesce(prev_hash, '') = coalesce(lag(certificate_hash) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), '') AS linked FROM c")
def attestation_chain(spark, d):
    """Records that name the hash of the one before."""
    from tidemark.operators.verify import certificate_chain

    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    n = t(spark, d, "nation").withColumn("certificate_hash", F.md5("n_name"))
    n = n.withColumn("prev_hash", F.when(F.col("n_nationkey") == 12, "broken").otherwise(F.lag("certificate_hash").over(w)))
    return certificate_chain(n, ["n_regionkey"], ["n_nationkey"]).select("n_nationkey", "linked")


@query("""WITH e AS (SELECT epoch_id, path, seen_at, ino % 4 AS part, row_number() OVER (PARTITION BY epoch_id ORDER BY seen_at, path, ino % 4) AS place FROM (SELECT DISTINCT epoch_id, path, seen_at, ino FROM files)),
m AS (SELECT *, lag(encode(path)) OVER w AS was, lag(part) OVER w AS last FROM e WINDOW w AS (PARTITION BY epoch_id ORDER BY place))
SELECT epoch_id, count(*) FILTER (NOT (coalesce(was = encode(path) AND part = last + 1, false) OR ((was IS NULL OR encode(path) > was) AND part = 0))) AS problems FROM m GROUP BY 1""")
def part_order(spark, d):
    """Entries of each archive that do not come in order of their names' bytes, or whose parts do not follow."""
    rows = t(spark, d, "files").select("epoch_id", "path", "seen_at", "ino").distinct().withColumn("part", F.col("ino") % 4)
    place = F.row_number().over(Window.partitionBy("epoch_id").orderBy("seen_at", "path", "part"))
    return restores.parts_in_order(rows.withColumn("place", place), ["epoch_id"], "place", "path", "part")


@query("""WITH f AS (SELECT path, min(sha256) AS sha256, min(ino) AS ino FROM files WHERE sha256 IS NOT NULL GROUP BY 1), o AS (SELECT 'old/' || path AS path, sha256 FROM f WHERE ino % 3 = 0 UNION ALL SELECT path, sha256 FROM f WHERE ino % 3 = 1),
n AS (SELECT path, sha256 FROM f WHERE ino % 2 = 0), g AS (SELECT sha256, min(path) AS from_path FROM o WHERE path NOT IN (SELECT path FROM n) GROUP BY 1) SELECT n.path, n.sha256, from_path FROM n JOIN g USING (sha256) WHERE n.path NOT IN (SELECT path FROM o)""")
def renamed_files(spark, d):
    """New paths that hold the content of one that is gone."""
    f = t(spark, d, "files").filter("sha256 IS NOT NULL").groupBy("path").agg(F.min("sha256").alias("sha256"), F.min("ino").alias("ino"))
    old = f.filter("ino % 3 = 0").select(F.concat(F.lit("old/"), "path").alias("path"), "sha256").unionByName(f.filter("ino % 3 = 1").select("path", "sha256"))
    return delta.renamed(old, f.filter("ino % 2 = 0").select("path", "sha256"), "path", "sha256")
