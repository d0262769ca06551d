"""Catalog questions, binary streams and streaming jobs over the tables at hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.functions.ids import trimmed
from tidemark.operators import catalogs
from tidemark.plans.registry import catalog
from tidemark.session import table as t
from tidemark.sources import binary, dumps, tables
from tidemark.streaming import followers, jobs

CATALOG, query = catalog()

_REL = "CASE p_size % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'p' ELSE 'v' END AS kind, CASE p_size % 5 WHEN 0 THEN 't' ELSE 'p' END AS persistence, CASE p_partkey % 4 WHEN 0 THEN 'pg_catalog' ELSE 's' || p_partkey % 4 END AS schema_name, CASE p_partkey % 7 WHEN 0 THEN 'ext' END AS extension"


def _relations(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    schema = F.when(k % 4 == 0, "pg_catalog").otherwise(F.concat(F.lit("s"), (k % 4).cast("string")))
    kind = F.get(F.array(*map(F.lit, "rpv")), (s % 3).cast("int"))
    return t(spark, d, "part").select("p_partkey", kind.alias("kind"), F.when(s % 5 == 0, "t").otherwise("p").alias("persistence"), schema.alias("schema_name"), F.when(k % 7 == 0, "ext").alias("extension"), F.concat(F.lit("t"), k.cast("string")).alias("table_name"))


@query(f"SELECT p_partkey FROM (SELECT p_partkey, {_REL} FROM part) WHERE kind IN ('r', 'p') AND persistence <> 't' AND schema_name <> 'pg_catalog' AND extension IS NULL")
def user_tables(spark, d):
    """Relations that hold a user's rows."""
    return catalogs.user_tables(_relations(spark, d)).select("p_partkey")


@query("SELECT p_partkey AS ref FROM part WHERE p_partkey % 4 IN (1, 2) AND (p_partkey + 1) % 4 IN (1, 2) AND p_partkey + 1 <= (SELECT max(p_partkey) FROM part)")
def chosen_schemas(spark, d):
    """references of which both ends are in the chosen schemas."""
    r = _relations(spark, d)
    a, b = r.select(F.col("p_partkey").alias("ref"), F.col("schema_name").alias("from_schema"), F.col("table_name").alias("from_table")), r.select((F.col("p_partkey") - 1).alias("ref"), F.col("schema_name").alias("to_schema"), F.col("table_name").alias("to_table"))
    return catalogs.chosen_schemas(r, a.join(b, "ref"), ["s1", "s2"])[1].select("ref")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 1 AND (n_nationkey % 3 <> 0 OR n_nationkey % 5 = 0)")
def hidden_rows(spark, d):
    """tables of which a role does not see all rows."""
    n = F.col("n_nationkey")
    rows = t(spark, d, "nation").select("n_nationkey", (n % 2 == 0).alias("row_security"), (F.col("n_regionkey") == 1).alias("bypass"), (n % 3 == 0).alias("owned"), (n % 5 == 0).alias("forced"))
    return catalogs.hidden_rows(rows).select("n_nationkey")


@query("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'DELETE,INSERT' WHEN 1 THEN '' ELSE 'ALL' END AS writes FROM nation")
def write_grants(spark, d):
    """privileges that write."""
    grant = F.get(F.array(*map(F.lit, ("GRANT SELECT, INSERT (a), DELETE ON x TO y", "GRANT SELECT ON x TO y", "GRANT ALL PRIVILEGES ON x TO y"))), (F.col("n_nationkey") % 3).cast("int"))
    rows = t(spark, d, "nation").select("n_nationkey", grant.alias("grant"))
    return catalogs.write_grants(rows).select("n_nationkey", F.array_join("writes", ",").alias("writes"))


@query("SELECT * FROM (VALUES ('ALGERIA', 'missing'), ('r0.n0', NULL), ('n5', NULL), ('n', 'missing'), ('n1', 'repeated'), ('dup', 'ambiguous')) v(wanted, problem)")
def pick_tables(spark, d):
    """Names that stand for no or several tables, or are asked for twice."""
    n = t(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("schema_name"), F.when(F.col("n_nationkey").isin(23, 24), "dup").otherwise(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))).alias("table_name"))
    wanted = spark.createDataFrame([(x,) for x in ("ALGERIA", "r0.n0", "n5", "n", "n1", "n1", "dup")], "wanted string")
    return catalogs.pick_tables(n, wanted)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'recorded' END, c_mktsegment) AS c_mktsegment FROM customer")
def recorded_overrides(spark, d):
    """Recorded values that replace local ones."""
    c = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    recorded = c.filter("c_custkey % 2 = 1 OR c_custkey % 3 = 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "recorded"))
    return catalogs.overridden(c, recorded, ["c_custkey"], ["c_mktsegment"])


_DAMAGED = "('does not authenticate'), ('is missing'), ('shorter than its index'), ('is in no index'), ('not found'), ('No such object'), ('does not parse'), ('Is Missing'), ('refused')"
_ASSERTIONS = f"""w AS (SELECT row_number() OVER () - 1 AS i, col0 AS words FROM (VALUES {_DAMAGED})),
a AS (SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN 'passed' ELSE 'failed' END AS status, CASE event_id % 7 WHEN 0 THEN 'RepositoryIntegrity' WHEN 1 THEN 'RepositoryRead' ELSE 'Restore' END AS name,
  CASE event_id % 5 WHEN 0 THEN 'check' WHEN 1 THEN 'data' WHEN 2 THEN NULL ELSE 'restore' END AS kind, event_id % 11 = 0 AS passed, ' pack ' || event_id || ' ' AS actual, 'it ' || words AS message, i < 7 AS marked FROM events JOIN w ON i = event_id % 9),
bad AS (SELECT *, NOT passed AND coalesce(kind NOT IN ('check', 'data'), true) AND name <> 'RepositoryRead' AND (name = 'RepositoryIntegrity' OR marked) AS damaged FROM a)"""


def _assertions(spark, d):
    n, u = F.col("event_id"), F.col("user_id")
    words = [*catalogs.DAMAGE, "Is Missing", "refused"]
    name = F.when(n % 7 == 0, "RepositoryIntegrity").when(n % 7 == 1, "RepositoryRead").otherwise("Restore")
    kind = F.when(n % 5 == 0, "check").when(n % 5 == 1, "data").when(n % 5 == 2, F.lit(None)).otherwise("restore")
    message = F.concat(F.lit("it "), F.get(F.array(*map(F.lit, words)), (n % 9).cast("int")))
    return t(spark, d, "events").select("event_id", "user_id", "ts", F.when(u % 3 == 0, "passed").otherwise("failed").alias("status"), name.alias("name"), kind.alias("kind"), (n % 11 == 0).alias("passed"), F.concat(F.lit(" pack "), n.cast("string"), F.lit(" ")).alias("actual"), message.alias("message"))


@query(f"WITH {_ASSERTIONS} SELECT e.event_id, e.event_id % 3 = 0 AND ts < TIMESTAMP '2024-01-20' AS paused, damaged FROM events e JOIN bad USING (event_id)")
def pauses_and_damage(spark, d):
    """paused surfaces, assertions that speak of stored damage."""
    rows = _assertions(spark, d).withColumnRenamed("passed", "held").withColumns({"paused": F.col("event_id") % 3 == 0, "paused_until": F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")})
    return rows.select("event_id", catalogs.paused(F.col("ts")).alias("paused"), catalogs.damaged(*(F.col(c) for c in ("name", "kind", "held", "actual", "message"))).alias("damaged"))


@query(f"WITH {_ASSERTIONS} SELECT user_id, trim(arg_min(actual, event_id)) AS damage FROM bad WHERE damaged AND status <> 'passed' GROUP BY 1")
def stored_damage(spark, d):
    """what the first assertion that speaks of stored damage found, of each report that did not pass."""
    return catalogs.stored_damage(_assertions(spark, d), ["user_id"], "event_id")


@query("""WITH r AS (SELECT n_regionkey AS k, 'r' || n_regionkey AS role, n_regionkey = 0 AS super, n_regionkey IN (1, 3) AS create_role, n_regionkey = 3 AS create_db, n_regionkey = 4 AS bypass FROM (SELECT DISTINCT n_regionkey FROM nation)),
t AS (SELECT n_regionkey AS k, lower(n_name) AS name, n_nationkey % 2 = 0 AND n_regionkey NOT IN (3) AS writes, n_nationkey % 3 = 0 AS hidden FROM nation),
f AS (SELECT r.*, coalesce(list_sort(list_distinct(list(name) FILTER (writes))), []) AS w, coalesce(list_sort(list_distinct(list(name) FILTER (hidden))), []) AS h FROM r LEFT JOIN t USING (k) GROUP BY ALL),
x AS (SELECT *, array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' and ' || (len(w) - 3) || ' more' ELSE '' END AS ws, array_to_string(h[1:3], ', ') || CASE WHEN len(h) > 3 THEN ' and ' || (len(h) - 3) || ' more' ELSE '' END AS hs, concat_ws(' and ', CASE WHEN create_role THEN 'create roles' END, CASE WHEN create_db THEN 'create databases' END) AS extra FROM f)
SELECT role, 'role' AS kind, CASE WHEN super THEN 'connects as ' || role || ', a superuser; a read-only role is enough' WHEN len(w) > 0 THEN role || ' can write to ' || len(w) || ' table(s) (' || ws || ')' || CASE WHEN extra <> '' THEN ' and ' || extra ELSE '' END || '; a read-only role is enough' ELSE role || ' writes to no table but can ' || extra || '; a read-only role is enough' END AS message FROM x WHERE super OR len(w) > 0 OR extra <> ''
UNION ALL SELECT role, 'row_security', 'row-level security hides rows of ' || len(h) || ' table(s) (' || hs || ') from ' || role FROM x WHERE len(h) > 0 AND NOT super AND NOT bypass""")
def role_findings(spark, d):
    """what roles can do beyond reading, and rows that they do not see."""
    n, k = t(spark, d, "nation"), F.col("n_regionkey")
    role = F.concat(F.lit("r"), k.cast("string"))
    roles = n.select("n_regionkey").distinct().select(role.alias("role"), (k == 0).alias("super"), k.isin(1, 3).alias("create_role"), (k == 3).alias("create_db"), (k == 4).alias("bypass"))
    tables = n.select(role.alias("role"), F.lower("n_name").alias("table_name"), ((F.col("n_nationkey") % 2 == 0) & (k != 3)).alias("writes"), (F.col("n_nationkey") % 3 == 0).alias("hidden"))
    return catalogs.role_findings(roles, tables)


@query("SELECT 'f' || n_regionkey AS file, greatest(count(*), n_regionkey * 2) AS failures FROM nation GROUP BY n_regionkey")
def checksum_failures(spark, d):
    """Checksum failures per file, counted and stated."""
    n = t(spark, d, "nation")
    block = n.select(F.concat(F.lit('checksum verification failed in file "f'), F.col("n_regionkey").cast("string"), F.lit('", block '), F.col("n_nationkey").cast("string")).alias("line"))
    total = n.select("n_regionkey").distinct().select(F.concat(F.lit('file "f'), F.col("n_regionkey").cast("string"), F.lit('" has a total of '), (F.col("n_regionkey") * 2).cast("string"), F.lit(" checksum failures")).alias("line"))
    return catalogs.checksum_failures(block.unionByName(total))


@query("SELECT event_id, event_id % 3 <> 0 OR ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15' AS needed FROM events")
def erasure_objects(spark, d):
    """Objects of erasures that a backup may still need."""
    nanos = F.lpad(F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000")), 20, "0")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(nanos, F.lit("-x.json"))).otherwise("other")
    return t(spark, d, "events").select("event_id", catalogs.needed_erasure_object(name, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("needed"))


@query("SELECT 'last_success{surface_id=\"' || surface_id || '\"} ' || CAST(epoch(max(ended_at)) AS BIGINT) AS line FROM bases GROUP BY surface_id HAVING max(ended_at) IS NOT NULL")
def metrics(spark, d):
    """K8: a gauge for each surface."""
    rows = t(spark, d, "bases").groupBy("surface_id").agg(F.floor(F.unix_seconds(F.max("ended_at").cast("timestamp"))).alias("at"))
    return catalogs.metrics(rows, "last_success", "surface_id", "at")


@query("""SELECT '{"surface_id":"' || surface_id || '","bases":' || count(*) || '}' AS line FROM bases GROUP BY surface_id""")
def json_list(spark, d):
    """K9: rows as JSON."""
    return t(spark, d, "bases").groupBy("surface_id").agg(F.count(F.lit(1)).alias("bases")).select(F.to_json(F.struct("surface_id", "bases")).alias("line"))


@query("SELECT 'nation' AS path, count(*) AS tuples, CAST(2 AS INTEGER) AS columns FROM nation")
def copy_stream_tuples(spark, d):
    """Tuples of a binary COPY stream made of a table."""
    field = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c)), 8, "0")), F.encode(c, "utf-8"))
    row = F.concat(F.unhex(F.lit("0002")), field(F.col("n_nationkey").cast("string")), field(F.col("n_name")))
    body = F.unhex(F.array_join(F.collect_list(F.hex(row)), ""))
    stream = F.concat(F.lit(binary.SIGNATURE), F.unhex(F.lit("00" * 8)), body, F.unhex(F.lit("FFFF")))
    parts = t(spark, d, "nation").agg(stream.alias("content")).select(F.lit("nation").alias("path"), "content")
    return binary.copied_tuples(parts).select("path", "tuples", "columns")


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'table' ELSE 'extension' END AS kind, lower(n_name) AS name FROM nation")
def schema_facts(spark, d):
    """Tables and extensions that a schema creates."""
    name = F.lower("n_name")
    ddl = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("-- x\nCREATE TABLE "), name, F.lit(" (\n a int\n);"))).otherwise(F.concat(F.lit("CREATE EXTENSION IF NOT EXISTS "), name, F.lit(" WITH SCHEMA public;")))
    return dumps.schema_facts(t(spark, d, "nation").select(ddl.alias("ddl")))


# Streams: the events table in the order of its ids, as four batches that come one after the other.
def _events(spark, d, name):
    return jobs.sliced_stream(t(spark, d, "events"), name, "event_id")


_PUSHED = "p AS (SELECT event_id, user_id, CASE WHEN event_id % 50 = 0 THEN 'other' ELSE 'own' END AS digest FROM events), f AS (SELECT *, row_number() OVER w AS rn, first(digest) OVER w AS held FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"


@query(f"WITH {_PUSHED} SELECT CASE WHEN rn = 1 THEN 'accepted' WHEN digest = held THEN 'repeated' ELSE 'refused' END AS outcome, count(*) AS segments FROM f GROUP BY 1")
def stream_pushes(spark, d):
    """T4: pushes that are accepted, repeated or refused, over several batches."""
    digest = F.sha2(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 50 == 0, "other").otherwise("own")), 256)
    rows = _events(spark, d, "pushes").select("user_id", digest.alias("digest"), "event_id")
    return jobs.drained(jobs.pushes(rows, "user_id", "digest", "event_id"), "pushes").groupBy("outcome").agg(F.count(F.lit(1)).alias("segments"))


@query("""WITH o AS (SELECT *, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
l AS (SELECT user_id, max(CASE WHEN ok THEN n ELSE 0 END) AS g FROM o GROUP BY 1)
SELECT o.user_id, count(*) AS attempts, max(o.event_id) * 1000000 AS last_attempt, coalesce(max(CASE WHEN ok THEN o.event_id END), 0) * 1000000 AS last_success, count(*) FILTER (n > g) AS failures FROM o JOIN l ON l.user_id = o.user_id GROUP BY 1""")
def stream_heartbeats(spark, d):
    """Last attempt, last success and failures since then of each surface, kept over several batches."""
    rows = _events(spark, d, "beats").select("user_id", F.timestamp_seconds("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return jobs.drained(jobs.heartbeats(rows, "user_id", "at", "ok"), "beats", "update", ["user_id"])


@query("SELECT user_id, max(event_id) + 1 AS position, count(*) - 1 - count(*) FILTER (n = event_id + 1) AS gaps FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) GROUP BY 1")
def stream_positions(spark, d):
    """How far each log was followed, and its gaps, kept over several batches."""
    rows = _events(spark, d, "positions").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 1).alias("e"))
    return jobs.drained(jobs.positions(rows, "user_id", "s", "e"), "positions", "update", ["user_id"])


def _followed(spark, kind, path, name, most=0):
    spark.dataSource.register(followers.LogDataSource)
    return jobs.drained(spark.readStream.format("followed_log").option("kind", kind).option("path", path).option("most", most).load(), name)


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS n, count(*) OVER () AS total FROM events)
SELECT printf('binlog.%06d', CAST(n // 1000 AS BIGINT)) AS log, count(*) AS changes, max(event_id) AS newest FROM n WHERE n < total - total % 7 GROUP BY 1""")
def stream_binlog(spark, d):
    """Changes of a binary log that goes over several files, whole transactions of seven changes only."""
    folder = tables.local_path(jobs.folder(spark, "binlog"))
    held: list = []
    n = 0
    for r in t(spark, d, "events").select("event_id").orderBy("event_id").toLocalIterator():  # the log of this example
        held.append((30, r[0]))
        n += 1
        held += [(followers.XID, r[0])] * (n % 7 == 0)
        if n % 1000 == 0:
            followers.write_binlog(folder, f"binlog.{n // 1000 - 1:06d}", held)
            held = []
    followers.write_binlog(folder, f"binlog.{n // 1000:06d}", held)
    changes = _followed(spark, "binlog", folder, "binlog").filter("kind = '30'")
    return changes.groupBy("log").agg(F.count(F.lit(1)).alias("changes"), F.max("detail").alias("newest"))


@query("""SELECT 'orders' AS log, op AS kind, count(*) AS entries FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'u' END AS op, o_orderkey, max(o_orderkey) OVER () AS last FROM orders) WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey = last) GROUP BY 2""")
def stream_oplog(spark, d):
    """Entries of a log of lines; an entry of a transaction that does not end there waits."""
    folder = tables.local_path(jobs.folder(spark, "oplog"))
    with open(f"{folder}/orders", "w", encoding="utf-8") as f:
        for r in t(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").toLocalIterator():
            k = r[0]
            txn = {"txn": k, "commit": False} if k % 5 == 0 else {"txn": k, "commit": True} if k % 5 == 1 else {}
            f.write(json.dumps({"ts": k, "op": "d" if k % 3 == 0 else "u", **txn}) + "\n")
    return _followed(spark, "lines", folder, "oplog").groupBy("log", "kind").agg(F.count(F.lit(1)).alias("entries"))


@query("SELECT count(DISTINCT n_regionkey) + 1 AS commits, true AS whole FROM nation")
def stream_pages(spark, d):
    """Frames of a page log up to the last commit; here a table and a transaction for each region."""
    import sqlite3

    path = f"{tables.local_path(jobs.folder(spark, 'pages'))}/shop.db"
    db = sqlite3.connect(path, isolation_level=None)
    db.execute("PRAGMA journal_mode = WAL")
    db.execute("PRAGMA wal_autocheckpoint = 0")
    db.execute("CREATE TABLE nation (region INTEGER, name TEXT)")
    for region in sorted({r[0] for r in t(spark, d, "nation").select("n_regionkey").distinct().collect()}):
        db.execute("BEGIN")
        db.executemany("INSERT INTO nation VALUES (?, ?)", [(r[0], r[1]) for r in t(spark, d, "nation").filter(F.col("n_regionkey") == region).select("n_regionkey", "n_name").collect()])
        db.execute("COMMIT")
    frames = _followed(spark, "pages", f"{path}-wal", "pages")
    found = frames.agg(F.count(F.when(F.col("kind") == "commit", 1)).alias("commits"), (F.max("next_position") == F.count(F.lit(1))).alias("whole"))
    found = spark.createDataFrame(found.collect(), found.schema)  # one row, before the database goes
    db.close()
    return found


@query("SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def stream_shipped(spark, d):
    """Events shipped batch by batch to a store and its copy, compacted and read back."""
    target, copy, kept = (jobs.folder(spark, n) for n in ("ship", "copy", "ship-state"))
    failures: list = []
    stream = _events(spark, d, "ship").writeStream.foreachBatch(jobs.fan_out([target, copy], failures)).option("checkpointLocation", kept).trigger(availableNow=True).start()
    stream.awaitTermination()
    jobs.compacted(spark, copy, f"{copy}-compact")
    return spark.read.parquet(f"{copy}-compact").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
