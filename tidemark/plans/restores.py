"""Restores, replays, exports and definitions over the tables at hand."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import catalogs, chunks, logs, profile, restores, verify
from tidemark.plans.registry import catalog
from tidemark.session import table as t
from tidemark.streaming import jobs

CATALOG, query = catalog()


@query("SELECT c_custkey, sha256(repeat(c_name, 3)) AS digest, CAST(0 AS BIGINT) AS missing FROM customer")
def read_files(spark, d):
    """Files put together from their chunks, checked by digest."""
    c = t(spark, d, "customer").select("c_custkey", F.repeat("c_name", F.lit(3)).alias("body"))
    refs = chunks.fixed_chunks(c, ["c_custkey"], "body", 16)
    piece = F.substring(F.col("body"), F.col("offset").cast("int") + 1, F.lit(16))
    stored = refs.join(c, "c_custkey").select("id", piece.alias("body"))
    out = restores.assembled(refs, stored, ["c_custkey"], "seq")
    return out.select("c_custkey", F.sha2("body", 256).alias("digest"), "missing")


@query("SELECT count(*) FILTER (o_orderkey % 9 <> 0) AS kept, count(*) FILTER (o_orderkey % 9 = 0) AS lost FROM orders")
def salvage(spark, d):
    """What verifies is kept, the rest is listed."""
    o = t(spark, d, "orders").select("o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("want"), F.sha2(F.when(F.col("o_orderkey") % 9 == 0, "damaged").otherwise(F.col("o_orderkey").cast("string")), 256).alias("got"))
    good, bad = restores.salvaged(o, F.col("want") == F.col("got"))
    return good.agg(F.count(F.lit(1)).alias("kept")).crossJoin(F.broadcast(bad.agg(F.count(F.lit(1)).alias("lost"))))  # one row each


@query("""WITH c AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, e.event_id % 8 AS page, arg_max(e.event_type, e.event_id) AS event_type FROM events e JOIN c USING (user_id) WHERE e.event_id <= c.last GROUP BY 1, 2""")
def pages_applied(spark, d):
    """Last image of each page up to the last commit."""
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 8).alias("page"), "event_type", (F.col("event_type") == "purchase").alias("commit"))
    return restores.pages_applied(e, ["user_id"], "page", "event_id", "commit", "event_type")


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), h AS (SELECT * FROM s WHERE k % 50 <> 30), x AS (SELECT user_id, max(CASE WHEN k < 30 THEN k * 10 + 10 END) AS f, max(k * 10 + 10) AS a FROM h GROUP BY 1)
SELECT user_id, CAST(v AS BIGINT) AS target, CASE WHEN v > a THEN 'past_end' WHEN v > coalesce(f, -1) THEN 'gap' END AS refusal FROM x, (VALUES (200), (400), (100000)) y(v)""")
def replay_refusals(spark, d):
    """Replays that are refused, for a gap or the end of the log."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    s = t(spark, d, "events").select("user_id", k.cast("long").alias("k")).filter("k % 50 <> 30").select("user_id", F.lit(1).alias("file"), (F.col("k") * 10).alias("a"), (F.col("k") * 10 + 10).alias("b"), F.lit(False).alias("rotates"))
    runs = logs.stream_runs(s, ["user_id"], "file", "a", "b", "rotates")
    targets = s.select("user_id").distinct().select("user_id", F.explode(F.array(*[F.lit(v).cast("long") for v in (200, 400, 100_000)])).alias("target"))
    return restores.replay_refusals(runs, targets, ["user_id"], "a", "b")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def unsent_queue(spark, d):
    """A bounded queue of each surface, the oldest dropped."""
    return restores.newest_queue(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20).select("event_id")


@query("""WITH b AS (SELECT surface_id, timeline, min(epoch_us(started_at)) AS begins FROM bases GROUP BY 1, 2), r AS (SELECT DISTINCT surface_id, timeline AS from_timeline, epoch_us(started_at) AS seg FROM bases) SELECT surface_id, from_timeline, seg, greatest(from_timeline, coalesce((SELECT max(timeline) FROM b WHERE b.surface_id = r.surface_id AND b.timeline >= from_timeline AND b.begins <= seg), from_timeline)) AS timeline FROM r""")
def timeline_resolution(spark, d):
    """The timeline on which a segment is found."""
    us = F.unix_micros(F.col("started_at").cast("timestamp"))
    b = t(spark, d, "bases").select("surface_id", "timeline", us.alias("at"))
    branches = b.groupBy("surface_id", "timeline").agg(F.min("at").alias("begins"))
    return restores.timelines(b.select("surface_id", F.col("timeline").alias("from_timeline"), F.col("at").alias("seg")).distinct(), branches, ["surface_id"])


_NAMED = "n AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN printf('%08X.history', CAST(event_id AS BIGINT)) ELSE upper(printf('%08x%08x%08x', CAST(event_id % 3 + 1 AS BIGINT), event_id // 256, event_id % 256)) END AS name FROM events)"


@query(f"WITH {_NAMED} SELECT event_id, name FROM n WHERE event_id % 50 = 0 OR event_id BETWEEN 300 AND 700")
def segment_range(spark, d):
    """Segments within a range whatever their timeline, and all history files."""
    n = F.col("event_id")
    name = F.when(n % 50 == 0, F.concat(F.lpad(F.hex(n), 8, "0"), F.lit(".history"))).otherwise(text.segment_name(n % 3 + 1, n))
    rows = t(spark, d, "events").select("event_id", name.alias("name"))
    return restores.segments_between(rows, "name", "00000001000000010000002C", "0000000100000002000000BC")


@query("""SELECT event_id, upper(printf('%08x%08x%08x', CAST(1 AS BIGINT), n // 256, n % 256)) AS name FROM (SELECT event_id, unnest(generate_series(event_id, event_id + event_id % 3)) AS n FROM events)""")
def segment_range_names(spark, d):
    """Names of the segments between two positions; an end on a boundary belongs to the one before."""
    size = 16 << 20
    start, end = F.col("event_id") * size, (F.col("event_id") + F.col("event_id") % 3 + 1) * size
    numbers = F.sequence(F.floor(start / size).cast("long"), F.floor((end - 1) / size).cast("long"))
    return t(spark, d, "events").select("event_id", F.explode(numbers).alias("n")).select("event_id", text.segment_name(F.lit(1), F.col("n")).alias("name"))


@query("SELECT n_nationkey, 'sha256:' || sha256(n_name || ':' || n_regionkey || CASE WHEN n_nationkey % 2 = 0 THEN ':extra' ELSE '' END) AS certificate FROM nation")
def certificates(spark, d):
    """Digests of records with optional parts."""
    return t(spark, d, "nation").select("n_nationkey", restores.certificate([F.col("n_name"), F.col("n_regionkey")], [F.when(F.col("n_nationkey") % 2 == 0, "extra")]).alias("certificate"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'raw<>stored' WHEN p_partkey % 7 = 0 THEN 'stored<>recorded' END AS problem FROM part")
def digest_contract(spark, d):
    """V6: the first pair of digests that differ."""
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select(k, F.when(k % 5 == 0, "X").otherwise("ab").alias("raw"), F.lit("AB").alias("stored"), F.when(k % 7 == 0, "y").otherwise("aB").alias("recorded"))
    return rows.select("p_partkey", restores.digests_agree("raw", "stored", "recorded").alias("problem"))


_LINES = "(VALUES (1, 'SET search_path = x'), (2, 'SET odd = 1'), (3, 'COPY cron.job (a) FROM stdin;'), (4, 'row'), (5, '\\.'), (6, 'COMMENT ON EXTENSION a'), (7, 'CREATE TABLE t'))"


@query(f"SELECT n_nationkey, n, line FROM nation, {_LINES} v(n, line) WHERE n IN (1, 7)")
def dump_lines(spark, d):
    """Lines of a dump without cron rows, comments on extensions and unknown settings."""
    lines = [(1, "SET search_path = x"), (2, "SET odd = 1"), (3, "COPY cron.job (a) FROM stdin;"), (4, "row"), (5, "\\."), (6, "COMMENT ON EXTENSION a"), (7, "CREATE TABLE t")]
    rows = t(spark, d, "nation").select("n_nationkey", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(x).alias("line")) for n, x in lines])).alias("l")).select("n_nationkey", "l.*")
    return restores.kept_lines(rows, ["n_nationkey"], "n", "line", ["search_path"])


@query("SELECT n_nationkey, 'CREATE TABLE ' || n_name || ' ();' || chr(10) AS script, 's.' || n_name AS shown FROM nation")
def definitions(spark, d):
    """Scripts without owners, policies and meta-commands; paths as they are shown."""
    script = F.concat(F.lit("\\connect x\nCREATE TABLE "), "n_name", F.lit(" ();\nALTER TABLE "), "n_name", F.lit(" OWNER TO me;\nCREATE POLICY p ON x;\n"))
    return t(spark, d, "nation").select("n_nationkey", restores.without_owners(script).alias("script"), restores.shown_path(F.concat(F.lit("data/s/"), "n_name", F.lit(".copy"))).alias("shown"))


@query("SELECT event_id, event_id % 2 = 0 AND event_id % 3 <> 0 AS same FROM events")
def same_objects(spark, d):
    """whether two listings name one object."""
    n = F.col("event_id")
    a = F.struct(F.lit("u").alias("uri"), n.alias("size"), F.col("ts").alias("modified"))
    b = F.struct(F.lit("u").alias("uri"), F.when(n % 2 == 0, n).otherwise(-n).alias("size"), F.when(n % 3 == 0, None).otherwise(F.col("ts")).alias("modified"))
    return t(spark, d, "events").select("event_id", a.alias("a"), b.alias("b")).select("event_id", catalogs.same_object("a", "b").alias("same"))


@query("SELECT table_name, row_count, true AS passed FROM (SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def export_round_trip(spark, d):
    """K2, K3, K7, V2: tables exported with a manifest, read back and verified against it."""
    folder = jobs.folder(spark, "export")
    restores.export_tables({n: t(spark, d, n) for n in ("nation", "region", "supplier")}, folder)
    manifest, tables = restores.read_export(spark, folder)
    checked = verify.manifest_assertions(manifest.select("table_name", "row_count"), profile.row_counts(tables), ["table_name"])
    return checked.select("table_name", F.col("actual").cast("long").alias("row_count"), "passed")


@query("""SELECT table_name, string_agg(column_name || ' ' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE data_type END, ', ' ORDER BY ordinal_position) AS columns, max(CASE WHEN ordinal_position = 1 THEN column_name END) AS key
FROM information_schema.columns WHERE table_name IN ('region', 'nation') GROUP BY 1""")
def catalog_description(spark, d):
    """Columns of each table in order, and its key."""
    rows = profile.column_rows({n: t(spark, d, n) for n in ("region", "nation")}, {"region": ["r_regionkey"], "nation": ["n_nationkey"]})
    df = spark.createDataFrame(rows, "table_name string, place int, name string, type string, not_null boolean, primary_key boolean")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "name", "type").alias("c")))), lambda x: x["c"])
    return df.groupBy("table_name").agg(F.array_join(listed, ", ").alias("columns"), F.max(F.when(F.col("primary_key"), F.col("name"))).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'missing' WHEN c_custkey % 3 = 0 THEN 'disabled' WHEN c_custkey % 5 = 1 THEN 'partial' ELSE 'valid' END AS state FROM customer WHERE c_custkey % 10 <> 0")
def trigger_status(spark, d):
    """Each table with the state of its capture trigger; tables that are left out are not told."""
    c, k = t(spark, d, "customer").select("c_custkey"), F.col("c_custkey")
    events = F.when(k % 5 == 1, F.array(*map(F.lit, ("INSERT", "UPDATE")))).otherwise(F.array(*map(F.lit, ("INSERT", "UPDATE", "DELETE", "TRUNCATE"))))
    triggers = c.filter(k % 4 != 0).select("c_custkey", (k % 3 != 0).alias("enabled"), events.alias("events"))
    return restores.capture_states(c, triggers, c.filter(k % 10 == 0), "c_custkey")


@query("SELECT event_id FROM events WHERE event_id IN (SELECT event_id * 5 FROM events WHERE event_type = 'purchase') OR (user_id = 1 AND event_type = 'error')")
def export_selection(spark, d):
    """rows chosen by id, or else by what they hold."""
    e = t(spark, d, "events")
    chosen = e.filter("event_type = 'purchase'").select((F.col("event_id") * 5).alias("event_id"))
    return restores.export_rows(e, "event_id", chosen, user_id=1, event_type="error").select("event_id")
