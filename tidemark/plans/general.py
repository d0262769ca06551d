"""Queries of the general problems over the repository tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import lsn
from tidemark.operators import copydiff, intervals, orphans, snapdiff
from tidemark.session import table as t


def p1_found(spark, d):
    return copydiff.store_differences(t(spark, d, "objects"), t(spark, d, "copy_results"))


def p1_field_differences(spark, d):
    """Every object of the first store against each copy's, whatever the copy's claims, by size, with both values."""
    named = copydiff.object_names(t(spark, d, "objects"))
    copies = t(spark, d, "copy_results").filter("name IS NOT NULL AND epoch_id IS NOT NULL").select(F.col("name").alias("store"), "epoch_id").distinct()
    ours = named.filter("store = 'first'").drop("store").join(copies, "epoch_id")
    theirs = named.join(copies, ["store", "epoch_id"])
    found = copydiff.compare_copies(ours, theirs, ["store", "epoch_id", "name"], ["size"], ["listed_at", "modified"], ["modified"], both_known=True)
    change = F.get("changes", F.lit(0))
    return found.select("store", "epoch_id", "name", "missing_left", "missing_right", change["field"].alias("field"), change["left"].alias("left_value"), change["right"].alias("right_value"))


def p3_found(spark, d):
    return intervals.base_gaps(t(spark, d, "bases"))


def p3_periods(spark, d):
    """Continuous periods of log per surface and timeline."""
    rows = intervals.period_rows(intervals.base_periods(t(spark, d, "bases")), ["surface_id", "timeline"])
    return rows.select("surface_id", "timeline", lsn.shown(F.col("period_start")).alias("period_start"), lsn.shown(F.col("period_end")).alias("period_end"))


def p4_found(spark, d):
    return snapdiff.entry_changes(t(spark, d, "snapshot_entries")).drop("fields")


def p4_change_counts(spark, d):
    """Changes per snapshot and kind, with how many touched each field."""
    found = snapdiff.entry_changes(t(spark, d, "snapshot_entries"))
    touched = lambda f: F.count(F.when(F.array_contains("fields", f), 1)).alias(f"{f}s")
    return found.groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("paths"), *[touched(f) for f in ("type", "value", "mode", "target")])


def p5_found(spark, d):
    return orphans.repository_orphans(t(spark, d, "packs"), t(spark, d, "blobs"), t(spark, d, "files"))


def p5_by_month(spark, d):
    return orphans.orphans_by_month(t(spark, d, "packs"), t(spark, d, "blobs"), t(spark, d, "files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_field_differences, p3_found, p3_periods, p4_found, p4_change_counts, p5_found, p5_by_month)}

_OBJECTS = """
decoded AS (
  SELECT store, epoch_id, size, modified, listed_at, '/' || url_decode(replace(key, '+', '%2B')) AS k
  FROM objects WHERE store IS NOT NULL AND epoch_id IS NOT NULL
),
named AS (
  SELECT *, CASE WHEN strpos(k, '/' || epoch_id || '/') > 0 THEN substr(k, strpos(k, '/' || epoch_id || '/') + length(epoch_id) + 2) END AS name FROM decoded
),
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store, epoch_id, name ORDER BY listed_at DESC, modified DESC NULLS LAST, size DESC NULLS LAST) AS rn FROM named WHERE name <> '') WHERE rn = 1
),
pairs AS (SELECT DISTINCT name AS store, epoch_id FROM copy_results WHERE name <> 'first'),
lasts AS (SELECT store, epoch_id, max(listed_at) AS last FROM objects GROUP BY ALL),
a AS (SELECT p.store, p.epoch_id, l.name, l.size, l.modified FROM pairs p JOIN latest l ON l.epoch_id = p.epoch_id AND l.store = 'first'),
b AS (SELECT p.store, p.epoch_id, l.name, l.size, l.modified FROM pairs p JOIN latest l ON l.epoch_id = p.epoch_id AND l.store = p.store)"""

_BASES = r"""
spans AS (
  SELECT DISTINCT surface_id, timeline, s, e FROM (
    SELECT surface_id, timeline,
      CASE WHEN regexp_matches(start_lsn, '^\s*[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\s*$') THEN CAST('0x' || split_part(trim(start_lsn, E' \n\t\r'), '/', 1) AS HUGEINT) * 4294967296 + CAST('0x' || split_part(trim(start_lsn, E' \n\t\r'), '/', 2) AS HUGEINT) END AS s,
      CASE WHEN regexp_matches(end_lsn, '^\s*[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\s*$') THEN CAST('0x' || split_part(trim(end_lsn, E' \n\t\r'), '/', 1) AS HUGEINT) * 4294967296 + CAST('0x' || split_part(trim(end_lsn, E' \n\t\r'), '/', 2) AS HUGEINT) END AS e
    FROM bases) WHERE e > s
),
marked AS (SELECT *, max(e) OVER (PARTITION BY surface_id, timeline ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
runs AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY surface_id, timeline ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM marked),
periods AS (SELECT surface_id, timeline, min(s) AS s, max(e) AS e FROM runs GROUP BY surface_id, timeline, run),
following AS (SELECT surface_id, timeline, e, lead(s) OVER (PARTITION BY surface_id, timeline ORDER BY s) AS n FROM periods)"""

_ENTRIES = r"""
rows_ AS (
  SELECT surface_id, root, snapshot_id, created_at, recorded_at, type, mode & 4095 AS mode,
    regexp_replace(url_decode(replace(path, '+', '%2B')), '^/', '') AS path,
    CASE WHEN regexp_matches(value, '^[0-9A-Fa-f]+$') THEN lower(value) WHEN value NOT IN ('', '-') THEN value END AS value,
    nullif(nullif(target, ''), '-') AS target
  FROM snapshot_entries WHERE path IS NOT NULL AND snapshot_id IS NOT NULL
),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY surface_id, root, snapshot_id, path ORDER BY recorded_at DESC, type DESC, value DESC, mode DESC, target DESC) AS rn FROM rows_) WHERE rn = 1),
snaps AS (SELECT surface_id, root, snapshot_id, coalesce(max(created_at), min(recorded_at)) AS taken FROM rows_ GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY surface_id, root ORDER BY taken, snapshot_id) AS ord, lead(snapshot_id) OVER (PARTITION BY surface_id, root ORDER BY taken, snapshot_id) AS next FROM snaps),
x AS (SELECT n.*, p.ord, p.next FROM newest n JOIN places p USING (surface_id, root, snapshot_id)),
pairs AS (
  SELECT b.snapshot_id AS now_id, a.next AS then_next, a.ord AS a_ord, b.ord AS b_ord, coalesce(b.path, a.path) AS path,
    CASE WHEN b.path IS NOT NULL AND a.path IS NOT NULL THEN 'changed' WHEN b.path IS NULL THEN 'removed' ELSE 'added' END AS change,
    a.type IS DISTINCT FROM b.type AS t, a.value IS DISTINCT FROM b.value AS v, coalesce(a.mode <> b.mode, false) AS m, a.target IS DISTINCT FROM b.target AS g
  FROM x a FULL JOIN x b ON a.surface_id = b.surface_id AND a.root = b.root AND a.path = b.path AND a.ord + 1 = b.ord
),
changes AS (
  SELECT CASE WHEN change = 'removed' THEN then_next ELSE now_id END AS snapshot_id, path, change, t, v, m, g FROM pairs
  WHERE (change = 'changed' AND (t OR v OR m OR g)) OR (change = 'removed' AND then_next IS NOT NULL) OR (change = 'added' AND b_ord > 1)
)"""

_ORPHANS = r"""
pk AS (SELECT lower(trim(id, E' \n\t\r')) AS id, min(uploaded_at) AS at, bool_and(deleted_at IS NOT NULL) AS gone FROM packs GROUP BY 1),
bl AS (SELECT lower(trim(id, E' \n\t\r')) AS id, min(indexed_at) AS at FROM blobs GROUP BY 1),
f AS (SELECT epoch_id, path, seen_at, lower(trim(unnest(blobs), E' \n\t\r')) AS ref FROM files),
found AS (
  SELECT DISTINCT 'blobs' AS referrer, b.epoch_id, lower(trim(b.id, E' \n\t\r')) AS row_key, lower(trim(b.pack_id, E' \n\t\r')) AS missing_id, strftime(b.indexed_at, '%Y-%m') AS month,
    CASE WHEN pk.id IS NULL THEN 'missing' WHEN pk.gone THEN 'deleted' WHEN pk.at > b.indexed_at THEN 'late' END AS reason
  FROM blobs b LEFT JOIN pk ON pk.id = lower(trim(b.pack_id, E' \n\t\r')) WHERE trim(b.pack_id, E' \n\t\r') <> ''
  UNION ALL
  SELECT DISTINCT 'files', f.epoch_id, f.path, f.ref, strftime(f.seen_at, '%Y-%m'), CASE WHEN bl.id IS NULL THEN 'missing' WHEN bl.at > f.seen_at THEN 'late' END
  FROM f LEFT JOIN bl ON bl.id = f.ref WHERE f.ref <> ''
)"""

_DIFFS = """
diffs AS (
  SELECT coalesce(a.store, b.store) AS store, coalesce(a.epoch_id, b.epoch_id) AS epoch_id, coalesce(a.name, b.name) AS name, a.size AS a_size, b.size AS b_size,
    a.name IS NULL AS missing_left, b.name IS NULL AS missing_right, coalesce(a.modified, b.modified) AS modified
  FROM a FULL JOIN b ON a.store = b.store AND a.epoch_id = b.epoch_id AND a.name = b.name
  WHERE a.name IS NULL OR b.name IS NULL OR a.size <> b.size
)"""

ORACLES = {
    "p1_found": f"""WITH {_OBJECTS}, {_DIFFS},
found AS (
  SELECT d.store, d.epoch_id, d.name, CASE WHEN missing_right THEN 'missing_in_copy' WHEN missing_left THEN 'missing_in_first' ELSE 'size' END AS diff
  FROM diffs d LEFT JOIN lasts c ON c.store = d.store AND c.epoch_id = d.epoch_id LEFT JOIN lasts f ON f.store = 'first' AND f.epoch_id = d.epoch_id
  WHERE NOT coalesce(missing_right AND d.modified > c.last, false) AND NOT coalesce(missing_left AND d.modified > f.last, false)
),
claims AS (SELECT * FROM (SELECT name AS store, epoch_id, behind, row_number() OVER (PARTITION BY name, epoch_id ORDER BY finished_at DESC, behind DESC) AS rn FROM copy_results WHERE behind IS NOT NULL AND name <> 'first') WHERE rn = 1)
SELECT * FROM found UNION ALL
SELECT c.store, c.epoch_id, '-', 'behind' FROM claims c
WHERE c.behind <> EXISTS (SELECT 1 FROM found f WHERE f.store = c.store AND f.epoch_id = c.epoch_id AND f.diff = 'missing_in_copy')""",
    "p1_field_differences": f"""WITH {_OBJECTS}, {_DIFFS}
SELECT store, epoch_id, name, missing_left, missing_right, CASE WHEN NOT missing_left AND NOT missing_right THEN 'size' END AS field,
  CASE WHEN NOT missing_left AND NOT missing_right THEN CAST(a_size AS VARCHAR) END AS left_value, CASE WHEN NOT missing_left AND NOT missing_right THEN CAST(b_size AS VARCHAR) END AS right_value FROM diffs""",
    "p3_found": f"""WITH {_BASES}
SELECT surface_id, timeline, upper(printf('%x', CAST(e // 4294967296 AS BIGINT))) || '/' || upper(printf('%x', CAST(e % 4294967296 AS BIGINT))) AS gap_start,
  upper(printf('%x', CAST(n // 4294967296 AS BIGINT))) || '/' || upper(printf('%x', CAST(n % 4294967296 AS BIGINT))) AS gap_end FROM following WHERE n > e""",
    "p3_periods": f"""WITH {_BASES}
SELECT surface_id, timeline, upper(printf('%x', CAST(s // 4294967296 AS BIGINT))) || '/' || upper(printf('%x', CAST(s % 4294967296 AS BIGINT))) AS period_start,
  upper(printf('%x', CAST(e // 4294967296 AS BIGINT))) || '/' || upper(printf('%x', CAST(e % 4294967296 AS BIGINT))) AS period_end FROM periods""",
    "p4_found": f"WITH {_ENTRIES} SELECT snapshot_id, path, change FROM changes",
    "p4_change_counts": f"""WITH {_ENTRIES}
SELECT snapshot_id, change, count(*) AS paths, count(*) FILTER (change = 'changed' AND t) AS types, count(*) FILTER (change = 'changed' AND v) AS "values",
  count(*) FILTER (change = 'changed' AND m) AS modes, count(*) FILTER (change = 'changed' AND g) AS targets FROM changes GROUP BY ALL""",
    "p5_found": f"WITH {_ORPHANS} SELECT DISTINCT referrer, epoch_id, row_key, missing_id, reason FROM found WHERE reason IS NOT NULL",
    "p5_by_month": f"WITH {_ORPHANS} SELECT referrer, month, reason, count(*) AS misses FROM found WHERE reason IS NOT NULL GROUP BY ALL",
}
