"""Readers of what applications and databases keep, over files and texts made of the tables at hand."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import restores
from tidemark.plans.registry import catalog
from tidemark.session import checkpointed
from tidemark.session import table as t
from tidemark.sources import applications, files, tables
from tidemark.streaming import followers, jobs

CATALOG, query = catalog()


def _script(spark, d):
    """A role script with a role a nation, each a member of its region's."""
    n = t(spark, d, "nation")
    name = F.lower("n_name")
    region = F.concat(F.lit("\"r "), F.col("n_regionkey").cast("string"), F.lit('"'))
    even = F.col("n_nationkey") % 2 == 0
    lines = F.concat_ws("\n", F.concat(F.lit("-- role "), name), F.concat(F.lit("CREATE ROLE "), name, F.lit(";")), F.concat(F.lit("ALTER ROLE "), name, F.lit(" WITH NOSUPERUSER LOGIN;")), F.concat(F.lit("ALTER ROLE "), name, F.lit(" IN DATABASE shop SET work_mem TO '1MB';")), F.when(even, F.concat(F.lit("COMMENT ON ROLE "), name, F.lit(" IS 'x';"))), F.when(F.col("n_nationkey") < 5, F.concat(F.lit("CREATE ROLE "), region.substr(F.lit(1), F.length(region)), F.lit(";"))), F.concat(F.lit("GRANT "), region, F.lit(" TO "), name, F.lit(" WITH INHERIT TRUE GRANTED BY postgres;")))
    return n.select(F.concat(lines, F.lit("\n")).alias("script"))


@query("SELECT lower(n_name) AS role, 2 + CAST(n_nationkey % 2 = 0 AS INTEGER) AS statements FROM nation UNION ALL SELECT 'r ' || n_regionkey, 1 FROM nation WHERE n_nationkey < 5")
def roles_read(spark, d):
    """Roles of a script with their statements, settings in one database left out."""
    roles, _ = applications.role_script(_script(spark, d))
    return roles.select("role", F.size("statements").alias("statements"))


@query("SELECT 'member' AS what, 'r ' || n_regionkey AS role, lower(n_name) AS member FROM nation WHERE n_nationkey % 3 = 0 AND n_regionkey < 2 UNION ALL SELECT 'missing', 'nobody', NULL")
def roles_chosen(spark, d):
    """Memberships between chosen roles, and chosen roles that a script lacks."""
    roles, members = applications.role_script(_script(spark, d))
    n = t(spark, d, "nation")
    names = n.filter("n_nationkey % 3 = 0").select(F.lower("n_name").alias("role")).unionByName(spark.createDataFrame([("r 0",), ("r 1",), ("nobody",)], "role string"))
    _, kept, missing = applications.chosen_roles(roles, members, names)
    return kept.select(F.lit("member").alias("what"), "role", "member").unionByName(missing.select(F.lit("missing").alias("what"), "role", F.lit(None).cast("string").alias("member")))


@query("""SELECT n_nationkey, k AS key, CASE k WHEN 'NAME' THEN n_name WHEN 'QUOTED' THEN 'a "' || n_name || '"' || chr(10) || 'b' WHEN 'LITERAL' THEN '${NAME}' WHEN 'URL' THEN 'db://' || n_name || '/' ELSE '' END AS value, CASE WHEN k = 'LOST' THEN 'NOWHERE' END AS unresolved
FROM nation, (VALUES ('NAME'), ('QUOTED'), ('LITERAL'), ('URL'), ('LOST')) x(k) WHERE n_nationkey % 5 <> 4""")
def settings_read(spark, d):
    """Settings of an application; a file that does not read has none."""
    name = F.col("n_name")
    text = F.concat(F.lit("# settings\n\nexport NAME="), name, F.lit(' # the name\nQUOTED="a \\"${NAME}\\"\nb"\nLITERAL=\'${NAME}\'\nURL = db://${NAME}/\nLOST=${NOWHERE}\n'), F.when(F.col("n_nationkey") % 5 == 4, "OPEN='x\n").otherwise(""))
    files = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("path"), text.alias("text"))
    return applications.read_settings(files).filter("problem IS NULL").select(F.col("path").cast("int").alias("n_nationkey"), "key", "value", "unresolved")


@query("SELECT 'm_' || n_nationkey AS migration FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 3 <> 1")
def migrations_pending(spark, d):
    """Migrations whose files are there and that were not run; every fourth lies deeper and is none."""
    n = F.col("n_nationkey")
    rows = t(spark, d, "nation")
    paths = rows.select(F.concat(F.lit("database/migrations/"), F.when(n % 4 == 0, "old/").otherwise(""), F.lit("m_"), n.cast("string"), F.lit(".php")).alias("path"))
    return applications.pending_migrations(paths, rows.filter(n % 3 == 1).select(F.concat(F.lit("m_"), n.cast("string")).alias("migration")))


@query("SELECT p_partkey, 'wp_postmeta' AS table_name, '20/it''s ' || p_name AS file FROM part WHERE p_partkey % 3 = 0")
def attachments(spark, d):
    """Files that the rows of a dump name by their marker; other tables and markers name none."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    row = F.concat(F.lit("("), key, F.lit(","), key, F.lit(",'"), F.when(F.col("p_partkey") % 3 == 0, "_wp_attached_file").otherwise("_other"), F.lit("','20/it\\'s "), name, F.lit("')"))
    create = "CREATE TABLE `{}` (\n  `meta_id` bigint NOT NULL,\n  `post_id` bigint,\n  `meta_key` varchar(255),\n  `{}` longtext,\n  PRIMARY KEY (`meta_id`)\n) ENGINE=InnoDB;\n"
    text = F.concat(F.lit(create.format("wp_postmeta", "meta_value") + create.format("wp_plain", "body")), F.lit("INSERT INTO `wp_postmeta` VALUES "), row, F.lit(",(0,NULL,NULL,'(a;''b)');\nINSERT INTO `wp_plain` VALUES "), row, F.lit(";\n"))
    dumps = t(spark, d, "part").select(key.alias("path"), text.alias("text"))
    return applications.attached_files(dumps).select(F.col("path").cast("int").alias("p_partkey"), "table_name", "file")


@query("SELECT path FROM (SELECT DISTINCT path FROM files) WHERE NOT (path LIKE 'media/%' OR path LIKE '%.log')")
def attachments_absent(spark, d):
    """Attachments that are named and not stored."""
    named = t(spark, d, "files").select(F.col("path").alias("file")).distinct()
    stored = named.filter("file LIKE 'media/%' OR file LIKE '%.log'").select(F.concat(F.lit("wp-content/uploads/"), "file").alias("path"))
    return applications.absent_attachments(named, stored).select(F.col("file").alias("path"))


def _database(spark, d) -> str:
    """A database file with the customers, some row ids missing, and an empty table."""
    import sqlite3

    path = f"{tables.local_path(jobs.folder(spark, 'sqlite'))}/shop.db"
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL, c_mktsegment VARCHAR(10))")
        db.execute('CREATE TABLE "no rows" (a INTEGER)')
        db.executemany("INSERT INTO customer VALUES (?, ?, ?, ?)", ((r[0], r[1], float(r[2]), r[3]) for r in rows.toLocalIterator()))
    db.close()
    copy = path + ".copy"
    tables.copied_file(path, copy)
    return copy


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def sqlite_read(spark, d):
    """A table of a database file, read in parts by row id from a consistent copy."""
    spark.dataSource.register(tables.SqliteDataSource)
    return spark.read.format("sqlite").option("path", _database(spark, d)).option("table", "customer").option("parts", "3").load().withColumn("c_custkey", F.col("c_custkey").cast(t(spark, d, "customer").schema["c_custkey"].dataType))


@query("SELECT 'customer' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'no rows', 0")
def sqlite_table_counts(spark, d):
    """Rows of every table of a database file."""
    return tables.sqlite_counts(spark, _database(spark, d))


@query("SELECT path, path = 'media' OR path LIKE 'media/%' OR path = 'archive' OR path = 'archive/old' OR path LIKE 'archive/old/%' AS could FROM (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, n), '/') AS path FROM files, range(1, 5) r(n) WHERE path <> '')")
def prefixes_that_could_match(spark, d):
    """directories below which something could match."""
    parts = F.split("path", "/")
    rows = t(spark, d, "files").filter("path <> ''").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    return rows.select("path", restores.could_hold(F.col("path"), ["media/**/x", "archive/old/*.log"]).alias("could"))


def _stored(spark, d, name) -> tuple[str, DataFrame]:
    """A folder with an object for each nation, in a folder for each region."""
    place = jobs.folder(spark, name)
    n = t(spark, d, "nation")
    objects = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string")).alias("key"), F.encode("n_name", "utf-8").alias("content"))
    return place, objects


@query("SELECT 'r' || n_regionkey || '/n' || n_nationkey AS path, CAST(length(n_name) AS BIGINT) AS size, 'file' AS kind FROM nation UNION ALL SELECT DISTINCT 'r' || n_regionkey, NULL, 'folder' FROM nation")
def files_listed(spark, d):
    """Everything below a folder, listed level by level."""
    place, objects = _stored(spark, d, "listed")
    files.put(objects, place).write.format("noop").mode("overwrite").save()
    return files.listed(spark, place).select("path", "size", "kind")


@query("""SELECT 'r' || n_regionkey || '/n' || n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'deleted' ELSE 'kept' END AS state, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS content FROM nation UNION ALL SELECT '../out', 'refused', NULL UNION ALL SELECT 'r9/none', 'missing', NULL""")
def objects_kept(spark, d):
    """Objects put, put again, deleted and read."""
    place, objects = _stored(spark, d, "objects")
    more = objects.unionByName(spark.createDataFrame([("../out", b"x")], "key string, content binary"))
    first = checkpointed(files.put(more, place))
    again = checkpointed(files.put(objects.withColumn("content", F.encode(F.lit("another"), "utf-8")), place))  # what is there stays
    written = first.filter("outcome = 'written'").join(again.filter("outcome = 'there'"), "key", "left_semi").select("key")
    gone = checkpointed(files.delete(written.filter(F.regexp_extract("key", r"(\d+)$", 1).cast("int") % 3 == 0).unionByName(spark.createDataFrame([("r9/none",)], "key string")), place))
    state = F.when(F.col("outcome") == "written", "kept").otherwise("refused")
    told = first.join(gone, "key", "left_anti").select("key", state.alias("state")).unionByName(gone.select("key", F.col("outcome").alias("state")))
    return files.get(told, place).join(told, "key").select("key", "state", F.decode("content", "utf-8").alias("content"))


@query("SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'u' END AS kind, count(*) AS entries, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def stream_resumed(spark, d):
    """A query that ends and is started again with its checkpoint, after its log has grown, tells of each entry once."""
    spark.dataSource.register(followers.LogDataSource)
    logs = tables.local_path(jobs.folder(spark, "resumed-log"))
    out, kept = (jobs.folder(spark, f"resumed-{n}") for n in ("out", "state"))
    rows = [r[0] for r in t(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").toLocalIterator()]  # the log of this example
    half = len(rows) // 2
    for part in (rows[:half], [], rows[half:]):
        with open(f"{logs}/log", "a", encoding="utf-8") as f:
            f.writelines(json.dumps({"ts": k, "op": "d" if k % 3 == 0 else "u"}) + "\n" for k in part)
        stream = spark.readStream.format("followed_log").option("kind", "lines").option("path", logs).load()
        stream.writeStream.format("parquet").option("checkpointLocation", kept).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).groupBy("kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("detail").alias("keys"))


@query("SELECT a AS low, b AS high, n FROM (SELECT min(c_custkey) AS a, max(c_custkey) AS b, count(*) AS n, k FROM (SELECT c_custkey, ((c_custkey - (SELECT min(c_custkey) FROM customer) + 1) * 4 - 1) // (SELECT max(c_custkey) - min(c_custkey) + 1 FROM customer) AS k FROM customer) GROUP BY k)")
def key_ranges(spark, d):
    """The ranges of a key that a table is read in over JDBC, and what each holds."""
    c = t(spark, d, "customer").select("c_custkey")
    low, high = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    parts = [c.filter(p.replace('"', "`")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("high"), F.count(F.lit(1)).alias("n")) for p in tables.range_predicates("c_custkey", low, high, 4)]
    return reduce(DataFrame.unionByName, parts)
