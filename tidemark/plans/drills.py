"""Drills, which compose verification out of the operators, and the orders and formats that they rely on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digest import ordered_digest
from tidemark.operators import catalogs, changelog, delta, logs, mail, restores, verify
from tidemark.plans.registry import catalog
from tidemark.session import table as t
from tidemark.sources import applications, archives, binary, dumps, sqlpass
from tidemark.streaming import jobs

CATALOG, query = catalog()


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'missing' AS problem, count(*) AS files FROM (SELECT DISTINCT epoch_id, path FROM files WHERE ino % 13 = 0) UNION ALL SELECT 'duplicate', count(*) FROM (SELECT epoch_id, path FROM files WHERE ino % 13 <> 0 AND ino % 19 = 0 GROUP BY 1, 2)""")
def drill_files(spark, d):
    """A manifest of files against an archive with entries that are missing or there twice."""
    f = t(spark, d, "files").groupBy("epoch_id", "path").agg(F.max("size").alias("size"), F.max("sha256").alias("sha256"), F.min("ino").alias("ino"))
    seen = f.filter("ino % 13 <> 0")
    twice = seen.filter("ino % 19 = 0").withColumn("size", F.col("size") + 1)
    found = verify.listed_files(f, seen.unionByName(twice), ["epoch_id", "path"]).groupBy("problem").agg(F.count(F.lit(1)).alias("files"))
    names = spark.createDataFrame([("missing",), ("duplicate",)], "problem string")
    return names.join(found, "problem", "left").select("problem", F.coalesce("files", F.lit(0).cast("long")).alias("files"))


_MAIL = "m AS (SELECT lower(source) AS mailbox, coalesce(lower(lang), '') AS folder, doc_id, CASE WHEN text <> '' THEN sha256(text) END AS digest FROM documents)"


def _messages(spark, d):
    text = F.when(F.col("text") != "", F.sha2(F.col("text"), 256))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return t(spark, d, "documents").select(F.lower("source").alias("mailbox"), F.coalesce(F.lower("lang"), F.lit("")).alias("folder"), "doc_id", text.alias("digest"), size.alias("size"), F.lit(7).alias("uid_validity"), F.col("doc_id").alias("uid"))


@query(f"""WITH {_MAIL}, w AS (SELECT mailbox, folder, digest, count(*) AS n FROM m GROUP BY 1, 2, 3), h AS (SELECT mailbox, folder, digest, count(*) AS k FROM m WHERE doc_id % 50 <> 0 GROUP BY 1, 2, 3)
SELECT w.mailbox, w.folder, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(CASE WHEN w.digest IS NULL THEN n ELSE 0 END) AS BIGINT) AS unreadable, CAST(sum(CASE WHEN w.digest IS NULL THEN 0 ELSE n - coalesce(k, 0) END) AS BIGINT) AS lost, sum(CASE WHEN w.digest IS NULL THEN 0 ELSE n - coalesce(k, 0) END) = 0 AS passed
FROM w LEFT JOIN h ON h.mailbox = w.mailbox AND h.folder = w.folder AND h.digest = w.digest GROUP BY 1, 2""")
def drill_messages(spark, d):
    """V8: each folder's messages against what was restored, by digest; unreadable ones are told, not failed."""
    m = _messages(spark, d)
    return mail.compared_messages(m, m.filter("doc_id % 50 <> 0"))


@query(f"""WITH {_MAIL}, s AS (SELECT mailbox, folder, count(*) AS messages, max(doc_id) AS highest_uid FROM m GROUP BY 1, 2) SELECT mailbox, folder, messages, highest_uid FROM s
WHERE NOT (mailbox = 'wiki_export' AND folder <> 'en') AND NOT (mailbox <> 'wiki_export' AND folder = 'fr')""")
def mail_folders(spark, d):
    """Folders of each mailbox that are read; where one holds every label's messages it alone, no junk; their numbers."""
    m = _messages(spark, d)
    folders = m.select("mailbox", "folder").distinct().withColumns({"use": F.when(F.col("folder") == "fr", "\\Junk"), "all_mail": (F.col("mailbox") == "wiki_export") & (F.col("folder") == "en")})
    return mail.folder_stats(m.join(mail.chosen_folders(folders), ["mailbox", "folder"], "left_semi")).select("mailbox", "folder", "messages", "highest_uid")


@query(f"WITH {_MAIL} SELECT mailbox, digest, count(*) AS copies FROM m WHERE digest IS NOT NULL GROUP BY 1, 2")
def mail_bodies(spark, d):
    """Each body once for all folders that hold it."""
    return mail.stored_bodies(_messages(spark, d).filter("digest IS NOT NULL")).select("mailbox", "digest", "copies")


@query("""SELECT 'rows' AS name, (SELECT count(*) FROM customer) = (SELECT count(DISTINCT c_custkey) FROM customer JOIN orders ON o_custkey = c_custkey) AS passed UNION ALL SELECT 'attachments', NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'pending', (SELECT count(*) FROM nation WHERE n_nationkey > 20) = 0""")
def drill_application(spark, d):
    """Rows, attachments and pending migrations of an application's backup; here customers without orders are lost."""
    c, o, n = (t(spark, d, x) for x in ("customer", "orders", "nation"))
    counted = lambda df: df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("k", F.lit(1))
    restored = c.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    rows = verify.manifest_assertions(counted(c), counted(restored), ["k"]).select(F.lit("rows").alias("name"), "passed")
    named, stored = (df.select(F.col(k).cast("string").alias("file")) for df, k in ((o, "o_custkey"), (c, "c_custkey")))
    lost = applications.absent_attachments(named, stored.select(F.concat(F.lit("uploads/"), "file").alias("path")), ["uploads"])
    lost = lost.agg((F.count(F.lit(1)) == 0).alias("passed")).select(F.lit("attachments").alias("name"), "passed")
    paths = n.select(F.concat(F.lit("database/migrations/"), F.col("n_nationkey").cast("string"), F.lit(".php")).alias("path"))
    ran = n.filter("n_nationkey <= 20").select(F.col("n_nationkey").cast("string").alias("migration"))
    pending = applications.pending_migrations(paths, ran).agg((F.count(F.lit(1)) == 0).alias("passed")).select(F.lit("pending").alias("name"), "passed")
    return _union([rows, lost, pending])


_STATE = "SELECT DISTINCT snapshot_id, path, type FROM snapshot_entries WHERE path IS NOT NULL"


@query(f"WITH s AS ({_STATE}), r AS (SELECT snapshot_id, sha256(string_agg(type || ' ' || path || chr(10), '' ORDER BY encode(path), type)) AS digest FROM s GROUP BY 1), x AS (SELECT snapshot_id, sha256(string_agg(type || ' ' || path || chr(10), '' ORDER BY encode(path), type)) AS digest FROM s WHERE NOT (right(snapshot_id, 1) = '0' AND path LIKE 'm%') GROUP BY 1) SELECT r.snapshot_id, r.digest IS NOT DISTINCT FROM x.digest AS passed FROM r LEFT JOIN x USING (snapshot_id)")
def drill_repository(spark, d):
    """The content root of what was restored against the recorded one; some snapshots lost files."""
    s = t(spark, d, "snapshot_entries").filter("path IS NOT NULL").select("snapshot_id", "path", "type").distinct()
    line = F.concat("type", F.lit(" "), "path", F.lit("\n"))
    recorded = ordered_digest(s, ["snapshot_id"], ["path", "type"], line)
    restored = ordered_digest(s.filter(~(F.endswith("snapshot_id", F.lit("0")) & F.startswith("path", F.lit("m")))), ["snapshot_id"], ["path", "type"], line)
    joined = recorded.join(restored.select("snapshot_id", F.col("digest").alias("found")), "snapshot_id", "left")
    return joined.select("snapshot_id", F.col("digest").eqNullSafe(F.col("found")).alias("passed"))


@query("SELECT count(*) AS before, count(*) FILTER (c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')) AS after, count(*) FILTER (c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')) AS erased FROM customer")
def drill_erasures(spark, d):
    """Rows before and after the erasures are replayed."""
    c = t(spark, d, "customer").select("c_custkey")
    e = t(spark, d, "events").filter("event_type = 'purchase'").select(F.lit("customer").alias("rel"), F.create_map(F.lit("c_custkey"), F.col("user_id").cast("string")).alias("key"))
    left = changelog.replay_erasures(c, e, "customer", ["c_custkey"])
    counts = c.agg(F.count(F.lit(1)).alias("before")).crossJoin(F.broadcast(left.agg(F.count(F.lit(1)).alias("after"))))  # one row each
    return counts.select("before", "after", (F.col("before") - F.col("after")).alias("erased"))


@query("SELECT event_id, event_id % 5 = 0 OR event_id % 5 = 4 AS kept FROM events")
def dump_names(spark, d):
    """names of dumps; unfinished and hidden files are passed over, a wish for one engine holds."""
    name = F.get(F.array(*map(F.lit, ("shop.sql", "shop.sql.part", ".shop.sql", "shop.tmp", "shop.dump.gz"))), (F.col("event_id") % 5).cast("int"))
    return t(spark, d, "events").select("event_id", dumps.finished_name(name).alias("kept"))


@query("SELECT 'a' AS list, event_id FROM (SELECT event_id FROM events WHERE event_id % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 5) UNION ALL SELECT 'b', event_id FROM (SELECT event_id FROM events WHERE event_id % 2 = 1 ORDER BY event_id DESC LIMIT 5)")
def newest_of_lists(spark, d):
    """The newest five of two lists, each in its own order."""
    e = t(spark, d, "events").select("event_id", "ts")
    a = e.filter("event_id % 2 = 0").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select(F.lit("a").alias("list"), "event_id")
    return a.unionByName(e.filter("event_id % 2 = 1").orderBy(F.desc("event_id")).limit(5).select(F.lit("b").alias("list"), "event_id"))


@query("SELECT key, CAST(CASE WHEN key LIKE '%.pack' OR key LIKE '%.idx' THEN 1 WHEN key LIKE '%.snap' THEN 3 ELSE 2 END AS INTEGER) AS turn FROM (SELECT DISTINCT key FROM objects)")
def delete_order(spark, d):
    """In which order objects go: data, then what describes it, the snapshot last."""
    return restores.deletion_turns(t(spark, d, "objects").select("key").distinct(), "key", [[".pack", ".idx"], [".snap"]])


@query("SELECT n_regionkey, n_name, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey * 7 % 5 END DESC NULLS LAST, n_regionkey, n_name) AS INTEGER) AS turn FROM nation")
def largest_first(spark, d):
    """The tables of a manifest, the largest first."""
    n = t(spark, d, "nation").select("n_regionkey", "n_name", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey") * 7 % 5).alias("size"))
    return restores.by_size(n, "size", ["n_regionkey", "n_name"]).drop("size")


@query("SELECT batch, count(*) AS erasures, min(event_id) AS first, max(event_id) AS last FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS batch FROM events WHERE event_type = 'purchase') GROUP BY 1")
def erasure_batches(spark, d):
    """Erasures in batches by id, one object each, whatever gaps the ids have."""
    e = restores.batches_by_id(t(spark, d, "events").filter("event_type = 'purchase'").select("event_id"), "event_id", 500)
    return e.groupBy("batch").agg(F.count(F.lit(1)).alias("erasures"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("SELECT event_id, event_id AS timestamp, CAST(event_id % 30 AS BIGINT) AS type, CAST(7 AS BIGINT) AS server_id, CAST(19 + event_id % 100 AS BIGINT) AS length, CAST(event_id + 1 AS BIGINT) AS next_position, CAST(0 AS BIGINT) AS flags FROM events")
def event_headers(spark, d):
    """Headers of binary log events."""
    reversed_hex = lambda c, n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(c), 2 * n, "0"), F.lit("(..)"), F.lit(1))), ""))
    n = F.col("event_id")
    head = F.concat(reversed_hex(n, 4), reversed_hex(n % 30, 1), reversed_hex(F.lit(7), 4), reversed_hex(n % 100 + 19, 4), reversed_hex(n + 1, 4), F.unhex(F.lit("0000")))
    return binary.event_headers(t(spark, d, "events").select("event_id", head.alias("content")), "event_id")


@query("""SELECT 'r' || r AS path, 'shop.' || c AS namespace, c = 'v' AS view, CAST(coalesce(n, 0) AS BIGINT) AS documents, CAST(coalesce(b, 0) AS BIGINT) AS bytes, r <> 4 OR c <> 'even' AS ended, CASE WHEN c = 'v' OR n IS NULL OR (r = 4 AND c = 'even') THEN NULL ELSE r <> 3 END AS sound
FROM (SELECT DISTINCT n_regionkey AS r FROM nation), (VALUES ('even'), ('odd'), ('v')) x(c) LEFT JOIN (SELECT n_regionkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS e, count(*) AS n, sum(4 + 1 + 6 + 8 + 1 + 2 + 4 + length(n_name) + 1 + 1) AS b FROM nation GROUP BY 1, 2) s ON k = r AND e = c""")
def archive_namespaces(spark, d):
    """Namespaces of archives of documents, with their checksums; one archive is damaged, one lacks an end."""
    return archives.archive_namespaces(_archives(spark, d)).drop("problem")


def _archives(spark, d):
    """An archive a region of its nations, even and odd ones in two collections."""
    import pandas as pd

    def build(key, rows):
        kinds = {"even": rows[rows.n_nationkey % 2 == 0], "odd": rows[rows.n_nationkey % 2 == 1]}
        made = archives.write_archive({k: [archives.document(a_num=int(n), b=str(x)) for n, x in zip(v.n_nationkey, v.n_name, strict=True)] for k, v in kinds.items()}, "shop", ("v",), ("even",) if key[0] == 4 else ())
        if key[0] == 3:  # every digit of a name is another one, so that no checksum holds
            made = made.replace(b"NATION_", b"NATI0N_")
        return pd.DataFrame({"path": [f"r{key[0]}"], "content": [made]})

    return t(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name").groupBy("n_regionkey").applyInPandas(build, "path string, content binary")


@query("SELECT o_orderstatus, count(*) > 10 AS holds FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1")
def check_with_variable(spark, d):
    """A check whose SQL names the moment of the snapshot."""
    sql = catalogs.substituted("SELECT o_orderstatus, CAST(count(*) AS STRING) AS actual FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '{{ taken_at }}' GROUP BY 1", taken_at="1995-01-01 00:00:00")
    return sqlpass.run(spark, sql, {"orders": t(spark, d, "orders")}).select("o_orderstatus", verify.holds(F.lit("> 10"), F.col("actual")).alias("holds"))


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS n_regionkey FROM nation")
def csv_round_trip(spark, d):
    """K1, K5: a result as CSV, nulls as empty fields, read back."""
    folder = jobs.folder(spark, "csv")
    n = t(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("n_regionkey"))
    sqlpass.write_csv(n, folder)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string, n_regionkey int").csv(folder)


@query("SELECT n_nationkey, 'CREATE TABLE ' || n_name || ' (a int);' || chr(10) AS definition FROM nation")
def table_definitions(spark, d):
    """The objects of one table out of a dump."""
    n = t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("-- Dump\n--\n-- Name: wanted; Type: TABLE\n--\nCREATE TABLE "), "n_name", F.lit(" (a int);\n--\n-- Name: other; Type: TABLE\n--\nCREATE TABLE o ();\n")).alias("ddl"))
    own = restores.table_definition(F.col("ddl"), "wanted")
    return n.select("n_nationkey", F.regexp_replace(own, r"(?m)^--.*\n", "").alias("definition"))


@query("SELECT user_id, count(*) AS n, (SELECT max(event_id) FROM events y WHERE y.user_id = e.user_id AND y.event_id % 5 = 0) AS base_id FROM events e GROUP BY 1")
def drill_point(spark, d):
    """Each log's newest base before its last point."""
    e = t(spark, d, "events")
    points = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), (F.max("event_id") + 1).alias("at"))
    bases = e.filter("event_id % 5 = 0").select("user_id", F.col("event_id").alias("ended"), F.col("event_id").alias("base_id"))
    return logs.as_of(points, bases, ["user_id"], "at", "ended", ["base_id"], strict=True).select("user_id", "n", "base_id")


@query("SELECT side, count(*) AS rows, CAST(sum(o_custkey) AS BIGINT) AS customers FROM (SELECT 'left' AS side, o_custkey FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 10 <> 0 UNION ALL SELECT 'right', o_custkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 6 <> 0) GROUP BY 1")
def trailer_against_index(spark, d):
    """Entries that a pack's trailer or the index has more often than the other."""
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey")
    trailer, index = o.unionByName(o.filter("o_orderkey % 6 = 0")), o.unionByName(o.filter("o_orderkey % 10 = 0"))
    return delta.exact_difference(trailer, index).groupBy("side").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_custkey").alias("customers"))


@query("""SELECT n_nationkey, problem FROM (SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'c' || n_nationkey || ': either sql or command' WHEN 2 THEN 'c' || n_nationkey || ': sql without an expectation' WHEN 3 THEN 'c' || n_nationkey || ': unknown variable other' WHEN 4 THEN 'a check has no name' ELSE 'c' || n_nationkey || ': a command with an expectation' END AS problem FROM nation) WHERE problem IS NOT NULL UNION ALL SELECT n_nationkey, 'c' || n_nationkey || ': a command with an expectation' FROM nation WHERE n_nationkey % 6 = 1""")
def checks_validated(spark, d):
    """users' checks that cannot be run; a list of checks is written by hand, so it is looked at on the driver."""
    def check(n):
        whole = {"name": f"c{n}", "sql": "SELECT 1", "expect": "> 0"}
        broken = ({}, {"command": "x"}, {"expect": ""}, {"sql": "SELECT '{{ other }}'"}, {"name": " "}, {"sql": "", "command": "x"})
        return whole | broken[n % 6]

    keys = sorted(r[0] for r in t(spark, d, "nation").select("n_nationkey").collect())
    return spark.createDataFrame([(n, p) for n in keys for p in catalogs.validate_checks([check(n)])], "n_nationkey int, problem string")
