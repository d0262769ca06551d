"""Profiles, verification, deltas and upserts over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.digest import listed_digest, ordered_digest, percent_escaped
from tidemark.operators import changelog, delta, profile, verify
from tidemark.plans.registry import catalog
from tidemark.session import table as t

CATALOG, query = catalog()
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
FRESH = ("ts", "o_orderdate", "l_shipdate")


def tables(spark, d, names=BASE):
    return {n: t(spark, d, n) for n in names}


_COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in BASE)


@query(_COUNTS)
def profile_row_counts(spark, d):
    """A1: rows of each table."""
    return profile.row_counts(tables(spark, d))


@query()
def profile_estimated_counts(spark, d):
    """A2: estimated rows, exact where small or unknown."""
    return profile.estimated_counts(tables(spark, d))


@query(f"SELECT count(*) AS tables, CAST(sum(row_count) AS BIGINT) AS rows FROM ({_COUNTS})")
def profile_totals(spark, d):
    """A3: tables and rows of the snapshot."""
    return profile.row_counts(tables(spark, d)).agg(F.count(F.lit(1)).alias("tables"), F.sum("row_count").alias("rows"))


_FRESH = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS freshness_column, coalesce(strftime(max({c}), '%Y-%m-%dT%H:%M:%S.%fZ'), 'no rows') AS freshness_max FROM {n}" for n, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts"))
)


@query(_FRESH)
def profile_freshness(spark, d):
    """A6, A18 text form: newest row of each table with a freshness column."""
    return profile.freshness(tables(spark, d), FRESH)


@query("""SELECT 'customer' AS table_name, sha256(string_agg(c_custkey || chr(9) || c_name || chr(9) || c_mktsegment || chr(10), '' ORDER BY c_custkey)) AS sample_hash FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 100)
UNION ALL SELECT 'nation', sha256(string_agg(n_nationkey || chr(9) || n_name || chr(9) || n_regionkey || chr(10), '' ORDER BY n_nationkey)) FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 100)""")
def profile_sample_hash(spark, d):
    """Digest of the first hundred rows by key."""
    one = lambda n, k, c: profile.sample_digest(t(spark, d, n), k, c).select(F.lit(n).alias("table_name"), "sample_hash")
    return one("customer", ["c_custkey"], ["c_custkey", "c_name", "c_mktsegment"]).unionByName(one("nation", ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"]))


_COLUMNS = """WITH c AS (SELECT table_name, column_name, ordinal_position AS p,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS type
  FROM information_schema.columns WHERE table_name IN ('region','nation','customer','supplier','part','orders','lineitem','events'))"""


def _columns(spark, d):
    return spark.createDataFrame(profile.column_rows(tables(spark, d)), "table_name string, place int, name string, type string, not_null boolean, primary_key boolean")


@query(_COLUMNS + " SELECT table_name, sha256(string_agg(column_name || chr(0) || type || chr(0) || 'false' || chr(0) || 'false' || chr(10), '' ORDER BY p)) AS columns_hash FROM c GROUP BY 1")
def profile_columns_hash(spark, d):
    """Digest of the columns of each table."""
    return profile.columns_digest(_columns(spark, d))


@query(_COLUMNS + " SELECT table_name, md5(string_agg(column_name || ' ' || type, ',' ORDER BY p)) AS definition_hash FROM c GROUP BY 1")
def profile_definition_hash(spark, d):
    """MD5 of the ordered definitions."""
    return profile.definition_digest(_columns(spark, d))


@query(r"""SELECT CASE WHEN lower(regexp_extract(path, '(\.[^./]*)$', 1)) = '' THEN '(no extension)' ELSE lower(regexp_extract(path, '(\.[^./]*)$', 1)) END AS extension, count(*) AS files, CAST(sum(coalesce(size, 0)) AS BIGINT) AS bytes
FROM (SELECT DISTINCT epoch_id, path, size FROM files) GROUP BY 1 ORDER BY bytes DESC, extension LIMIT 10""")
def profile_extensions(spark, d):
    """The ten extensions with most bytes."""
    return profile.extension_histogram(t(spark, d, "files").select("epoch_id", "path", "size").distinct())


@query("""SELECT split_part(path, '/', 1) AS folder, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(mtime_ns) AS oldest, max(mtime_ns) AS newest
FROM (SELECT DISTINCT epoch_id, path, size, mtime_ns FROM files) GROUP BY 1""")
def profile_folders(spark, d):
    """A5: files, bytes and times of each top folder."""
    rows = t(spark, d, "files").select("epoch_id", "path", "size", "mtime_ns").distinct()
    return rows.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.min("mtime_ns").alias("oldest"), F.max("mtime_ns").alias("newest"))


@query("""WITH e AS (SELECT event_id, unnest(json_keys(props)) AS field, props FROM events WHERE json_valid(props)),
k AS (SELECT field, json_type(props, '$.' || field) AS kind FROM e)
SELECT field, count(*) AS count, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' WHEN min(kind) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN min(kind) = 'VARCHAR' THEN 'STRING' ELSE min(kind) END AS type,
  count(*) = (SELECT count(*) FROM events WHERE json_valid(props)) AS not_null FROM k GROUP BY field""")
def profile_json_shape(spark, d):
    """Fields of the events' properties."""
    return profile.json_shape(t(spark, d, "events"), "props", "event_id")


@query("""SELECT key, count(*) AS versions, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT key, etag, count(*) AS n FROM objects WHERE key IS NOT NULL AND etag IS NOT NULL GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1""")
def profile_conflicts(spark, d):
    """Keys listed with more than one digest."""
    return profile.conflicts(t(spark, d, "objects"), "key", "etag")


@query("""SELECT surface_id, count(*) AS bases, CAST(sum(stored_bytes) AS BIGINT) AS bytes, max(ended_at) AS newest, max(locked_until) AS locked_to,
  CAST(floor(sum(tar_bytes) * 1000.0 / sum(stored_bytes)) AS BIGINT) AS ratio_thousandths FROM (SELECT DISTINCT * FROM bases) GROUP BY 1""")
def archive_status(spark, d):
    """Bases of each surface, their bytes, newest end, last lock and compression."""
    rows = t(spark, d, "bases").distinct().groupBy("surface_id")
    ratio = F.floor(F.sum("tar_bytes").cast("double") * 1000.0 / F.sum("stored_bytes")).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("bases"), F.sum("stored_bytes").alias("bytes"), F.max("ended_at").alias("newest"), F.max("locked_until").alias("locked_to"), ratio.alias("ratio_thousandths"))


_ESCAPED = "list_aggregate(list_transform(range(1, length(hex(encode(path))) + 1, 2), lambda i: CASE WHEN substr(hex(encode(path)), i, 2) = '25' OR substr(hex(encode(path)), i, 2) < '21' OR substr(hex(encode(path)), i, 2) > '7E' THEN '%' || substr(hex(encode(path)), i, 2) ELSE chr(CAST('0x' || substr(hex(encode(path)), i, 2) AS INTEGER)) END), 'string_agg', '')"


def _entries(spark, d):
    """One row a path and snapshot: the latest recorded."""
    rows = t(spark, d, "snapshot_entries").filter("path IS NOT NULL")
    return rows.groupBy("snapshot_id", "path").agg(F.max(F.struct("recorded_at", "type", "value", "mode", "target")).alias("r")).select("snapshot_id", "path", "r.*")


_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, path ORDER BY recorded_at DESC, type DESC, value DESC NULLS LAST, mode DESC NULLS LAST, target DESC NULLS LAST) AS rn FROM snapshot_entries WHERE path IS NOT NULL) WHERE rn = 1)"


@query(f"SELECT snapshot_id, sha256(string_agg(type || ' ' || coalesce(value, '') || ' ' || {_ESCAPED} || chr(10), '' ORDER BY encode(path))) AS digest, count(*) AS lines FROM {_NEWEST} GROUP BY 1")
def content_root(spark, d):
    """Digest of the sorted, escaped entries of each snapshot."""
    line = F.concat("type", F.lit(" "), F.coalesce("value", F.lit("")), F.lit(" "), percent_escaped(F.col("path")), F.lit("\n"))
    return ordered_digest(_entries(spark, d), ["snapshot_id"], ["path"], line)


@query(f"SELECT snapshot_id, count(*) FILTER (type = 'f') AS files, count(*) FILTER (type = 'd') AS dirs, count(*) FILTER (type = 'l') AS links, max(length(path) - length(replace(path, '/', ''))) + 1 AS depth FROM {_NEWEST} GROUP BY 1")
def snapshot_stats(spark, d):
    """Entries of each snapshot by kind, and its depth."""
    of = lambda k: F.count(F.when(F.col("type") == k, 1))
    return _entries(spark, d).groupBy("snapshot_id").agg(of("f").alias("files"), of("d").alias("dirs"), of("l").alias("links"), F.max(F.size(F.split("path", "/"))).cast("long").alias("depth"))


@query("SELECT epoch_id, sha256(string_agg(id || ':' || coalesce(CAST(bytes AS VARCHAR), '') || chr(10), '' ORDER BY id, bytes NULLS FIRST)) AS digest, count(*) AS lines FROM (SELECT DISTINCT epoch_id, lower(trim(id, E' \\n\\t\\r')) AS id, bytes FROM packs) GROUP BY 1")
def object_digest(spark, d):
    """Digest of the packs of each epoch in order of id."""
    from tidemark.functions.ids import hex_id

    rows = t(spark, d, "packs").select("epoch_id", hex_id(F.col("id")).alias("id"), "bytes").distinct()
    return ordered_digest(rows, ["epoch_id"], ["id", "bytes"], F.concat("id", F.lit(":"), F.coalesce(F.col("bytes").cast("string"), F.lit("")), F.lit("\n")))


# Verification: the recorded manifest counts nations per region; the restore lacks region 3 and one nation of region 1.
_MANIFEST = """m AS (SELECT n_regionkey AS region, count(*) AS row_count FROM nation GROUP BY 1),
r AS (SELECT n_regionkey AS region, count(*) AS row_count FROM nation WHERE n_regionkey <> 3 AND n_nationkey <> 1 GROUP BY 1),
a AS (SELECT m.region, CASE WHEN r.region IS NULL THEN 'table existence' ELSE 'row count' END AS name, coalesce(m.row_count = r.row_count, false) AS passed,
  CASE WHEN r.region IS NULL THEN 'present' ELSE CAST(m.row_count AS VARCHAR) END AS expected, CASE WHEN r.region IS NULL THEN 'missing' ELSE CAST(r.row_count AS VARCHAR) END AS actual FROM m LEFT JOIN r ON m.region = r.region)"""


def _assertions(spark, d):
    nation = t(spark, d, "nation")
    per = lambda df: df.groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("row_count"))
    return verify.manifest_assertions(per(nation), per(nation.filter("n_regionkey <> 3 AND n_nationkey <> 1")), ["region"])


@query(f"WITH {_MANIFEST} SELECT *, CASE WHEN passed THEN 'passed' ELSE 'failed' END AS result FROM a")
def verify_manifest(spark, d):
    """Row counts of a manifest against a restore."""
    return _assertions(spark, d).withColumn("result", verify.result(F.col("passed"), F.lit(False)))


@query(f"WITH {_MANIFEST} SELECT 'drill' AS run, count(*) AS checks, sha256(string_agg(name || '|' || passed || '|' || expected || '|' || actual || chr(10), '' ORDER BY region)) AS digest FROM a")
def verify_checks_digest(spark, d):
    """Digest of the outcome of the checks."""
    return verify.checks_digest(_assertions(spark, d).withColumn("run", F.lit("drill")), ["run"], "region")


@query("""SELECT coalesce(a.k, b.k) AS o_orderpriority, a.k IS NOT NULL AS in_archive, b.k IS NOT NULL AS in_manifest
FROM (SELECT DISTINCT o_orderpriority AS k FROM orders WHERE o_orderkey % 3 = 0 AND o_orderpriority > '2') a FULL JOIN (SELECT DISTINCT o_orderpriority AS k FROM orders WHERE o_orderpriority < '5') b ON a.k = b.k""")
def verify_table_union(spark, d):
    """Union of the tables of an archive and a manifest."""
    orders = t(spark, d, "orders")
    return verify.table_union(orders.filter("o_orderkey % 3 = 0 AND o_orderpriority > '2'"), orders.filter("o_orderpriority < '5'"), ["o_orderpriority"])


@query("""WITH f AS (SELECT o_orderpriority AS k, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS m FROM orders GROUP BY 1), g AS (SELECT o_orderpriority AS k, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS m FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT f.k AS o_orderpriority, f.m = g.m AS passed, f.m AS expected, g.m AS actual FROM f JOIN g ON f.k = g.k""")
def verify_freshness(spark, d):
    """Newest rows recorded and restored."""
    from tidemark.functions.digest import stamp

    per = lambda df: df.groupBy("o_orderpriority").agg(stamp(F.max("o_orderdate")).alias("freshness_max"))
    orders = t(spark, d, "orders")
    return verify.freshness_assertions(per(orders), per(orders.filter("o_orderkey % 2 = 0")), ["o_orderpriority"])


# A listing of files against what was seen: every 13th is missing, every 11th has another size, every 17th is unlisted.
@query("""WITH f AS (SELECT epoch_id, path, max(size) AS size, max(lower(sha256)) AS sha, min(ino) AS ino FROM files GROUP BY 1, 2)
SELECT epoch_id, path, CASE WHEN ino % 17 = 0 AND ino % 13 <> 0 THEN 'unlisted' WHEN ino % 13 = 0 AND ino % 17 <> 0 THEN 'missing' WHEN ino % 11 = 0 THEN 'size' END AS problem FROM f
WHERE NOT (ino % 17 = 0 AND ino % 13 = 0) AND (ino % 17 = 0 OR ino % 13 = 0 OR ino % 11 = 0)""")
def verify_files(spark, d):
    """Listed files that are missing, differ or are unlisted; hashes without case."""
    f = t(spark, d, "files").groupBy("epoch_id", "path").agg(F.max("size").alias("size"), F.max(F.lower("sha256")).alias("sha256"), F.min("ino").alias("ino"))
    seen = f.filter("ino % 13 <> 0").select("epoch_id", "path", F.when(F.col("ino") % 11 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.upper("sha256").alias("sha256"))
    return verify.listed_files(f.filter("ino % 17 <> 0"), seen, ["epoch_id", "path"])


@query("""SELECT DISTINCT o.o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_custkey % 5 <> 0)""")
def verify_attachments(spark, d):
    """Names that a table refers to and the archive lacks."""
    return t(spark, d, "orders").select("o_custkey").distinct().join(t(spark, d, "customer").filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")


#: Expectations, values and whether they hold.
EXPECTATIONS = [("0", "0", True), ("0", "1", False), ("> 0", "3", True), (">0", "0", False), (">= 1000", "1000", True), ("< 10", "9.5", True), ("<= 2", "2.0", True), ("> 5", None, False), ("!= 0", "0", False), ("42.75", "42.75", True), ("42.75", "4275e-2", True), ("true", "t", True), ("true", "false", False), ("ok", "ok", True), ("!= broken", "ok", True), ("0", None, False), ("!= 0", None, True)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{e}', {'NULL' if a is None else repr(a)}, {str(h).lower()})" for e, a, h in EXPECTATIONS) + ") AS v(expect, actual, holds)")
def check_expectations(spark, d):
    """Expectations against values."""
    rows = spark.createDataFrame([(e, a) for e, a, _ in EXPECTATIONS], "expect string, actual string")
    return rows.withColumn("holds", verify.holds(F.col("expect"), F.col("actual")))


@query("SELECT o_orderstatus, CAST(count(*) AS VARCHAR) AS actual, count(*) >= 100 AS holds FROM orders GROUP BY 1")
def check_sql(spark, d):
    """A user's SQL check, one value per status, against an expectation."""
    t(spark, d, "orders").createOrReplaceTempView("_tm_orders")
    rows = spark.sql("SELECT o_orderstatus, CAST(count(*) AS STRING) AS actual FROM _tm_orders GROUP BY 1")
    return rows.withColumn("holds", verify.holds(F.lit(">= 100"), F.col("actual")))


# Deltas: the old state lacks every 7th order; the new one lacks every 5th and changed the status of every 11th.
_STATES = "old AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0)"


def _states(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.filter("o_orderkey % 7 <> 0"), o.filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))


@query(f"WITH {_STATES} SELECT * FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)")
def diff_added(spark, d):
    """J1, U4."""
    return delta.added(*_states(spark, d), ["o_orderkey"])


@query(f"WITH {_STATES} SELECT n.* FROM new n JOIN old o USING (o_orderkey) WHERE n.o_orderstatus IS DISTINCT FROM o.o_orderstatus")
def diff_changed(spark, d):
    """J2."""
    return delta.changed(*_states(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query(f"WITH {_STATES} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)")
def diff_deleted(spark, d):
    """J3."""
    return delta.deleted(*_states(spark, d), ["o_orderkey"])


@query(f"""WITH {_STATES} SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'only_left' WHEN o.o_orderkey IS NULL THEN 'only_right' ELSE 'o_orderstatus' END AS problem
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus IS DISTINCT FROM n.o_orderstatus""")
def diff_states(spark, d):
    """Both directions and the field that differs."""
    return delta.states_differ(*_states(spark, d), ["o_orderkey"], ["o_orderstatus"])


@query(f"""WITH {_STATES} (SELECT 'added' AS change, count(*) AS rows FROM new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM old)) UNION ALL (SELECT 'gone', count(*) FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new))
UNION ALL (SELECT 'before', count(*) FROM old) UNION ALL (SELECT 'after', count(*) FROM new)""")
def diff_counts(spark, d):
    """Rows before and after, added and gone, of one full join."""
    old, new = (s.select("o_orderkey") for s in _states(spark, d))
    both = old.withColumn("o", F.lit(1)).join(new.withColumn("n", F.lit(1)), "o_orderkey", "full")
    sums = both.agg(F.count("o").alias("before"), F.count("n").alias("after"), F.count(F.when(F.col("o").isNull(), 1)).alias("added"), F.count(F.when(F.col("n").isNull(), 1)).alias("gone"))
    return sums.unpivot([], ["before", "after", "added", "gone"], "change", "rows")


@query(f"WITH {_STATES}, c AS (SELECT o_orderpriority AS name, count(*) FILTER (w = 0) AS b, count(*) FILTER (w = 1) AS a FROM (SELECT o_orderpriority, 0 AS w FROM old UNION ALL SELECT o_orderpriority, 1 FROM new) GROUP BY 1) SELECT 'orders' AS tables, sha256(string_agg(name || '|' || b || '|' || a || chr(10), '' ORDER BY name)) AS digest FROM c")
def table_changes_digest(spark, d):
    """Digest of the list of changes."""
    old, new = _states(spark, d)
    both = old.select("o_orderpriority", F.lit(0).alias("w")).unionByName(new.select("o_orderpriority", F.lit(1).alias("w")))
    each = both.groupBy("o_orderpriority").agg(F.count(F.when(F.col("w") == 0, 1)).alias("b"), F.count(F.when(F.col("w") == 1, 1)).alias("a"))
    line = F.concat(F.concat_ws("|", "o_orderpriority", "b", "a"), F.lit("\n"))
    return each.groupBy(F.lit("orders").alias("tables")).agg(listed_digest(line, F.col("o_orderpriority")).alias("digest"))


# Upserts: every third customer with another segment, and some with keys that the target lacks.
_UPSERT = "tgt AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 4 <> 0), src AS (SELECT c_custkey, c_name, 'RESTORED' AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)"


def _upsert(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.filter("c_custkey % 4 <> 0"), c.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("RESTORED"))


@query(f"WITH {_UPSERT} SELECT * FROM tgt UNION ALL SELECT * FROM src WHERE c_custkey NOT IN (SELECT c_custkey FROM tgt)")
def upsert_keep(spark, d):
    """J17."""
    return delta.upsert(*_upsert(spark, d), ["c_custkey"], overwrite=False)


@query(f"WITH {_UPSERT} SELECT * FROM src UNION ALL SELECT * FROM tgt WHERE c_custkey NOT IN (SELECT c_custkey FROM src)")
def upsert_overwrite(spark, d):
    """J17."""
    return delta.upsert(*_upsert(spark, d), ["c_custkey"], overwrite=True)


@query(f"WITH {_UPSERT} SELECT count(*) FILTER (m) AS matched, count(*) FILTER (NOT m) AS inserted, CAST(0 AS BIGINT) AS updated, count(*) FILTER (m) AS kept FROM (SELECT c_custkey IN (SELECT c_custkey FROM tgt) AS m FROM src)")
def upsert_outcome(spark, d):
    """Counts of what an upsert would do."""
    return delta.upsert_outcome(*_upsert(spark, d), ["c_custkey"], overwrite=False)


# Erasures: purchases are erasures of customers by the event's user; the snapshot is 100:110:103,107.
_ERASE = "e AS (SELECT event_id AS xid, ts AS seen, user_id FROM events WHERE event_type = 'purchase'), v AS (SELECT *, (seen > TIMESTAMP '2024-01-15 01:00:00') OR xid >= 110 OR xid IN (103, 107) AS replays FROM e)"


def _erasures(spark, d):
    e = t(spark, d, "events").filter("event_type = 'purchase'")
    snap = changelog.parse_snapshot(F.lit("100:110:103,107"))
    replays = changelog.replays(F.col("event_id"), F.col("ts"), snap, F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return e.select(F.col("event_id").alias("xid"), F.col("ts").alias("at"), replays.alias("replays"), F.when(F.col("event_id") % 10 == 0, "gone").otherwise("customer").alias("rel"), F.create_map(F.lit("c_custkey"), F.col("user_id").cast("string")).alias("key"))


@query(f"WITH {_ERASE} SELECT xid, replays FROM v")
def erasure_visible(spark, d):
    """Erasures that a backup has not seen."""
    return _erasures(spark, d).select("xid", "replays")


@query(f"WITH {_ERASE} SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM v WHERE replays AND xid % 10 <> 0)")
def erasure_replay(spark, d):
    """Customers left after the erasures are replayed."""
    return changelog.replay_erasures(t(spark, d, "customer").select("c_custkey", "c_name"), _erasures(spark, d).filter("replays"), "customer", ["c_custkey"])


@query("SELECT CASE WHEN event_id % 10 = 0 THEN 'gone' ELSE 'customer' END AS rel, count(*) AS erasures, bool_and(event_id % 10 <> 0) AS present FROM events WHERE event_type = 'purchase' GROUP BY 1")
def erasure_counts(spark, d):
    """Erasures per relation, also of those that were not restored."""
    return changelog.erasure_counts(_erasures(spark, d), ["customer"])


@query("""SELECT n_nationkey, '{"n_regionkey":"' || n_regionkey || '","n_nationkey":"' || n_nationkey || '"}' AS key FROM nation""")
def erasure_key(spark, d):
    """A row's key as JSON."""
    return t(spark, d, "nation").select("n_nationkey", changelog.key_json(["n_regionkey", "n_nationkey"]).alias("key"))


@query("""SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey = 1 UNION SELECT c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION SELECT r_name FROM region WHERE r_regionkey = 1""")
def inheritance_closure(spark, d):
    """A region with all that hangs below it, however deep."""
    r, n, c, s = (t(spark, d, x) for x in ("region", "nation", "customer", "supplier"))
    edges = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    edges = edges.unionByName(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("c_name").alias("child")))
    edges = edges.unionByName(s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("parent"), F.col("s_name").alias("child")))
    return changelog.descendants(edges, r.filter("r_regionkey = 1").select(F.col("r_name").alias("name")))


@query("SELECT event_id FROM events WHERE NOT (event_id >= 500 OR event_id IN (410, 420)) AND NOT (event_id >= 450 OR event_id = 430)")
def log_garbage(spark, d):
    """Changes that all consumers have seen."""
    consumers = spark.createDataFrame([("400:500:410,420",), ("425:450:430",)], "snapshot string")
    return changelog.collectable(t(spark, d, "events").select("event_id"), consumers, "event_id")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'changed' WHEN c_mktsegment = 'BUILDING' THEN 'no key' WHEN c_nationkey IN (3, 4) THEN 'definition differs' ELSE '' END AS reason,
  NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING' OR c_nationkey IN (3, 4)) AS carry FROM customer""")
def carry_forward(spark, d):
    """What is carried forward unread, else the first reason why not."""
    refusals = {"changed": F.col("c_acctbal") < 0, "no key": F.col("c_mktsegment") == "BUILDING", "definition differs": F.col("c_nationkey").isin(3, 4)}
    return changelog.carried(t(spark, d, "customer"), refusals).select("c_custkey", "reason", "carry")
