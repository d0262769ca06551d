"""Chunks, packs and references; text functions; scans of dumps; ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import ids, lsn, text
from tidemark.functions.ids import hex_id
from tidemark.operators import chunks, verify
from tidemark.plans.registry import catalog
from tidemark.session import table as t
from tidemark.sources import dumps, sqlpass

CATALOG, query = catalog()

_CHUNKS = "c AS (SELECT event_id, CAST(i AS INTEGER) AS seq, substr(s, CAST(i * 16 + 1 AS BIGINT), 16) AS piece FROM (SELECT event_id, repeat(event_type || user_id % 7, 6) AS s FROM events), range(0, 100) r(i) WHERE i * 16 < length(s))"


def _refs(spark, d):
    e = t(spark, d, "events").select("event_id", F.repeat(F.concat("event_type", (F.col("user_id") % 7).cast("string")), F.lit(6)).alias("s"))
    return chunks.fixed_chunks(e, ["event_id"], "s", 16)


@query(f'WITH {_CHUNKS} SELECT event_id, seq, CAST(seq * 16 AS BIGINT) AS "offset", length(piece) AS length, sha256(piece) AS id FROM c')
def chunk_fixed(spark, d):
    """Fixed-size chunks."""
    return _refs(spark, d)


@query(f"WITH {_CHUNKS} SELECT DISTINCT sha256(piece) AS id, length(piece) AS length FROM c WHERE sha256(piece) NOT LIKE '%0'")
def chunk_dedup(spark, d):
    """Chunks to store, each once and none that is known."""
    refs = _refs(spark, d)
    return chunks.new_chunks(refs, refs.filter("id LIKE '%0'").select("id").distinct())


@query(f"WITH {_CHUNKS}, n AS (SELECT event_id, length(piece) AS l, sha256(piece) AS id, row_number() OVER (PARTITION BY sha256(piece) ORDER BY event_id, seq) AS k FROM c) SELECT event_id, CAST(sum(CASE WHEN k = 1 AND id NOT LIKE '%0' THEN l ELSE 0 END) AS BIGINT) AS new_bytes FROM n GROUP BY 1")
def chunk_new_bytes(spark, d):
    """Bytes that each file adds."""
    refs = _refs(spark, d)
    return chunks.new_bytes(refs, refs.filter("id LIKE '%0'").select("id").distinct(), ["event_id"], ["event_id", "seq"])


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, 0 AS outside, sha256(text) AS id FROM documents WHERE text <> ''")
def chunk_defined(spark, d):
    """Content-defined chunks cover every byte of every file once and keep their bounds; a file of one chunk has its id."""
    texts = t(spark, d, "documents").select("doc_id", "text")
    c = chunks.defined_chunks(texts, ["doc_id"], "text", 64, 256, 1024)
    last = F.col("seq") == F.max("seq").over(Window.partitionBy("doc_id"))
    wrong = ((F.col("length") < 64) & ~last) | (F.col("length") > 1024)
    found = c.withColumn("wrong", wrong).groupBy("doc_id").agg(F.sum("length").alias("bytes"), F.count(F.when(F.col("wrong"), 1)).cast("int").alias("outside"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    joined = found.join(texts, "doc_id")
    return joined.select("doc_id", "bytes", "outside", F.when(F.col("n") == 1, F.col("id")).otherwise(F.sha2("text", 256)).alias("id"))


_BLOBS = r"b AS (SELECT DISTINCT lower(trim(pack_id, E' \n\t\r')) AS pack_id, pack_offset, length FROM blobs WHERE trim(pack_id, E' \n\t\r') <> '' AND length > 0 AND pack_offset IS NOT NULL)"


@query(f"""WITH {_BLOBS}, m AS (SELECT *, max(pack_offset + length) OVER (PARTITION BY pack_id ORDER BY pack_offset, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM b),
r AS (SELECT *, sum(CASE WHEN far IS NULL OR pack_offset - far > 1048576 THEN 1 ELSE 0 END) OVER (PARTITION BY pack_id ORDER BY pack_offset, length ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT pack_id, min(pack_offset) AS start, max(pack_offset + length) AS "end", count(*) AS blobs FROM r GROUP BY pack_id, run""")
def read_ranges(spark, d):
    """Reads of each pack, merged across small gaps."""
    b = t(spark, d, "blobs").select(hex_id(F.col("pack_id")).alias("pack_id"), "pack_offset", "length").filter("pack_id IS NOT NULL")
    return chunks.merged_ranges(b, ["pack_id"], "pack_offset", "length")


@query("""WITH RECURSIVE b AS (SELECT epoch_id, length, row_number() OVER (PARTITION BY epoch_id ORDER BY indexed_at NULLS FIRST, id NULLS FIRST, length) AS n FROM (SELECT DISTINCT epoch_id, id, length, indexed_at FROM blobs WHERE length > 0)),
p AS (SELECT epoch_id, n, length AS held, 0 AS pack, length FROM b WHERE n = 1 UNION ALL
  SELECT b.epoch_id, b.n, CASE WHEN p.held >= 33554432 THEN b.length ELSE p.held + b.length END, CASE WHEN p.held >= 33554432 THEN p.pack + 1 ELSE p.pack END, b.length FROM p JOIN b ON b.epoch_id = p.epoch_id AND b.n = p.n + 1)
SELECT epoch_id, CAST(pack AS BIGINT) AS pack, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS blobs FROM p GROUP BY 1, 2""")
def packs_in_order(spark, d):
    """Packs closed in order once they hold the target."""
    b = t(spark, d, "blobs").filter("length > 0").select("epoch_id", "id", "length", "indexed_at").distinct()
    return chunks.sequential_packs(b, ["epoch_id"], ["indexed_at", "id", "length"], "length", 33_554_432).groupBy("epoch_id", "pack").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("blobs"))


_INDEX = r"""i AS (SELECT lower(trim(id, E' \n\t\r')) AS id, min(type) AS type, arg_max(coalesce(lower(trim(pack_id, E' \n\t\r')), ''), (indexed_at, coalesce(lower(trim(pack_id, E' \n\t\r')), ''))) AS pack_id FROM blobs GROUP BY 1),
p AS (SELECT DISTINCT lower(trim(id, E' \n\t\r')) AS pack_id FROM packs),
r AS (SELECT DISTINCT epoch_id, path, lower(trim(unnest(blobs), E' \n\t\r')) AS id FROM files)"""


@query(f"""WITH {_INDEX} SELECT r.epoch_id, r.path, r.id, CASE WHEN i.id IS NULL THEN 'not_indexed' WHEN i.type <> 0 THEN 'wrong_kind' ELSE 'pack_missing' END AS problem FROM r LEFT JOIN i ON i.id = r.id LEFT JOIN p ON p.pack_id = i.pack_id
WHERE r.id <> '' AND (i.id IS NULL OR i.type <> 0 OR p.pack_id IS NULL)""")
def check_references(spark, d):
    """Chunk references that are not indexed, of the wrong kind, or in no pack."""
    refs = t(spark, d, "files").select("epoch_id", "path", F.explode("blobs").alias("b")).select("epoch_id", "path", hex_id(F.col("b")).alias("id")).filter("id IS NOT NULL").distinct()
    blobs = t(spark, d, "blobs").select(hex_id(F.col("id")).alias("id"), "type", F.coalesce(hex_id(F.col("pack_id")), F.lit("")).alias("pack_id"), "indexed_at")
    return chunks.reference_problems(refs, blobs, t(spark, d, "packs").select(hex_id(F.col("id")).alias("id")), ["epoch_id", "path"])


@query(r"SELECT lower(trim(id, E' \n\t\r')) AS id, arg_max(pack_offset, (indexed_at, coalesce(lower(trim(pack_id, E' \n\t\r')), ''), pack_offset)) AS pack_offset FROM blobs GROUP BY 1")
def index_last_wins(spark, d):
    """The last entry of each chunk."""
    b = t(spark, d, "blobs").select(hex_id(F.col("id")).alias("id"), "pack_offset", F.struct("indexed_at", F.coalesce(hex_id(F.col("pack_id")), F.lit("")), "pack_offset").alias("o"))
    return chunks.last_run_wins(b, ["id"], F.col("o")).select("id", "pack_offset")


@query(r"""WITH f AS (SELECT epoch_id, path, max(size) AS size, max(mtime_ns) AS m, max(ctime_ns) AS c, max(dev) AS dev, max(ino) AS ino, max(list_sort(list_filter(coalesce(blobs, []), lambda x: x IS NOT NULL))) AS blobs FROM files GROUP BY 1, 2),
k AS (SELECT DISTINCT lower(trim(id, E' \n\t\r')) AS id FROM blobs)
SELECT epoch_id, path FROM f WHERE ino % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM (SELECT lower(trim(unnest(f.blobs), E' \n\t\r')) AS id) u WHERE u.id NOT IN (SELECT id FROM k WHERE id IS NOT NULL))""")
def files_unchanged(spark, d):
    """Files that need no reading; every fifth had its time changed."""
    known = F.array_sort(F.filter(F.coalesce("blobs", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    f = t(spark, d, "files").groupBy("epoch_id", "path").agg(*[F.max(c).alias(c) for c in ("size", "mtime_ns", "ctime_ns", "dev", "ino")], F.max(known).alias("blobs"))
    f = f.withColumn("blobs", F.transform("blobs", hex_id))
    now = f.withColumn("mtime_ns", F.when(F.col("ino") % 5 == 0, F.col("mtime_ns") + 1).otherwise(F.col("mtime_ns")))
    return chunks.unchanged(now, f, ["epoch_id", "path"], t(spark, d, "blobs").select(hex_id(F.col("id")).alias("id")).distinct())


# Text functions, over texts made of the tables.
#: Commands that match one rule each, in their order, then some that match none.
COMMANDS = (
    """psql -c 'ALTER TABLE t DROP  Column c'""", """psql -c "truncate \\"t\\" cascade\"""", """psql -c "DELETE FROM shop.t\"""", "(dropdb shop)", "terraform -chdir=a destroy", "tofu apply -auto-approve -destroy",
    "npx prisma migrate reset", "prisma db push --accept --force-reset", "supabase db reset --linked", "bundle exec rake db:schema:load", "python manage.py flush",
    "select * from dropped", "delete from t where id = 1", "mydropdb x", "terraform apply", "prisma migrate deploy", "rails db:migrate", "Prisma Migrate Reset", "manage.py flushed",
)


def _literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_MATCHED = "CASE " + " ".join(f"WHEN regexp_matches(c, {_literal(p)}) THEN {_literal(n)}" for n, p in text.DESTRUCTIVE) + " END"


@query(f"SELECT event_id, {_MATCHED} AS rule FROM (SELECT event_id, CASE event_id % {len(COMMANDS)} " + " ".join(f"WHEN {i} THEN {_literal(c)}" for i, c in enumerate(COMMANDS)) + " END AS c FROM events)")
def destructive_scan(spark, d):
    """the first rule that a command matches."""
    command = F.get(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS)).cast("int"))
    return t(spark, d, "events").select("event_id", text.first_rule(command).alias("rule"))


@query("""SELECT n_nationkey, ['db', n_name || '.x', 't"q'] AS parts, '"' || n_name || '"' AS identifier, '''' || n_name || '''''s''' AS literal FROM nation""")
def identifiers(spark, d):
    """Parts of quoted names, and quoting."""
    name = F.concat(F.lit('db."'), "n_name", F.lit('.x"."t""q"'))
    return t(spark, d, "nation").select("n_nationkey", text.identifier_parts(name).alias("parts"), text.quoted_identifier(F.col("n_name")).alias("identifier"), text.quoted_literal(F.concat("n_name", F.lit("'s"))).alias("literal"))


@query("SELECT n_nationkey, n_name || '\\' || chr(39) || chr(10) AS back, length(n_name) + 6 AS escaped_length FROM nation")
def mysql_strings(spark, d):
    """Escaping and back."""
    value = F.concat("n_name", F.lit("\\'\n"))
    escaped = text.mysql_escaped(value)
    return t(spark, d, "nation").select("n_nationkey", text.mysql_unescaped(escaped).alias("back"), F.length(escaped).cast("long").alias("escaped_length"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1024 WHEN 2 THEN p_size * 1048576 ELSE CAST(p_size AS BIGINT) * 1073741824 END AS bytes FROM part""")
def sizes(spark, d):
    """C11: sizes with binary units."""
    unit = F.get(F.array(*map(F.lit, ("", "kB", "MB", " GB"))), (F.col("p_partkey") % 4).cast("int"))
    return t(spark, d, "part").select("p_partkey", text.parsed_size(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query("""SELECT s_suppkey, 'postgres://u:***@h/' || s_name AS url, 'password=*** host=h' AS pair, 'h' || s_suppkey || CASE s_suppkey % 2 WHEN 0 THEN '.example.net' ELSE '.example.net.evil.org' END AS host, CASE s_suppkey % 2 WHEN 0 THEN 'example' END AS provider FROM supplier""")
def hosts(spark, d):
    """Passwords out of texts, providers of hosts by suffix."""
    host = F.concat(F.lit("h"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ".example.net").otherwise(".example.net.evil.org"))
    url = text.redacted(F.concat(F.lit("postgres://u:s3cret@h/"), "s_name"))
    return t(spark, d, "supplier").select("s_suppkey", url.alias("url"), text.redacted(F.lit("password=abc host=h")).alias("pair"), host.alias("host"), text.provider(host, {"example.net": "example"}).alias("provider"))


@query("""SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) * 4294967296 + event_id % 1000 AS packed, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, event_id % 1000 AS ordinal FROM events""")
def packed_times(spark, d):
    """Times packed with an ordinal, and back."""
    e = t(spark, d, "events").select("event_id", text.pack_time(F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id") % 1000).alias("packed"))
    seconds, ordinal = text.unpack_time(F.col("packed"))
    return e.select("event_id", "packed", seconds.alias("seconds"), ordinal.alias("ordinal"))


@query("""SELECT event_id, upper(printf('%08x%08x%08x', CAST(3 AS BIGINT), event_id // 256, event_id % 256)) AS name, event_id AS number FROM events""")
def segment_names(spark, d):
    """Names of segments and their numbers."""
    name = text.segment_name(F.lit(3), F.col("event_id"))
    return t(spark, d, "events").select("event_id", name.alias("name"), text.segment_number(name).alias("number"))


@query(r"""SELECT DISTINCT base_id, upper(printf('%x', CAST(p // 4294967296 AS BIGINT))) || '/' || upper(printf('%x', CAST(p % 4294967296 AS BIGINT))) AS start_lsn, CAST(p AS DECIMAL(20, 0)) AS position FROM
(SELECT base_id, CAST('0x' || split_part(trim(start_lsn, E' \n\t\r'), '/', 1) AS HUGEINT) * 4294967296 + CAST('0x' || split_part(trim(start_lsn, E' \n\t\r'), '/', 2) AS HUGEINT) AS p FROM bases WHERE regexp_matches(start_lsn, '^\s*[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}\s*$'))""")
def positions(spark, d):
    """Log positions read, written and as numbers."""
    b = t(spark, d, "bases").select("base_id", lsn.biased(F.col("start_lsn")).alias("p")).filter("p IS NOT NULL").distinct()
    return b.select("base_id", lsn.shown(F.col("p")).alias("start_lsn"), lsn.as_decimal(F.col("p")).alias("position"))


@query("SELECT epoch_id, gb, floor(greatest(gb - 5, 0) * 0.09 * 100 + 0.5) / 100 AS usd FROM (SELECT epoch_id, CAST(count(DISTINCT run_id) AS DOUBLE) * sum(bytes) / 1e9 AS gb FROM (SELECT DISTINCT epoch_id, id, bytes, run_id FROM packs WHERE bytes IS NOT NULL) GROUP BY 1)")
def egress_price(spark, d):
    """The size of each epoch's packs, and what reading it at each run moves out of a provider and costs."""
    packs = t(spark, d, "packs").filter("bytes IS NOT NULL").select("epoch_id", "id", "bytes", "run_id").distinct()
    sizes = packs.groupBy("epoch_id").agg(F.sum("bytes").alias("bytes"), F.count_distinct("run_id").cast("double").alias("runs"))
    gb, usd = text.egress(F.col("bytes"), F.col("runs"), 5.0, 0.09)
    return sizes.select("epoch_id", gb.alias("gb"), usd.alias("usd"))


@query("""SELECT event_id, CASE WHEN h > 0 AND m = 0 AND s = 0 THEN h || 'h' WHEN h > 0 AND s = 0 THEN h || 'h' || m || 'm' WHEN h > 0 THEN h || 'h' || m || 'm' || s || 's' WHEN m > 0 AND s = 0 THEN m || 'm' WHEN m > 0 THEN m || 'm' || s || 's' ELSE s || 's' END AS short, CAST((event_id + 999) // 1000 AS BIGINT) AS ms
FROM (SELECT event_id, event_id * 20 // 3600 AS h, event_id * 20 // 60 % 60 AS m, event_id * 20 % 60 AS s FROM events)""")
def durations(spark, d):
    """Durations shortened, times rounded up."""
    n = F.col("event_id") * 20
    part = lambda c, unit: F.concat(c.cast("long").cast("string"), F.lit(unit))
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    long = F.when(h > 0, F.concat(part(h, "h"), part(m, "m"), part(s, "s"))).when(m > 0, F.concat(part(m, "m"), part(s, "s"))).otherwise(part(s, "s"))
    return t(spark, d, "events").select("event_id", text.shortened_duration(long).alias("short"), F.ceil(F.col("event_id") / 1000).alias("ms"))


@query("SELECT event_id, NOT (event_id % 3 = 0) AS known, event_id % 4 <> 0 AS valid FROM events")
def strict_objects(spark, d):
    """Objects with no unknown keys; notes that are valid."""
    json = F.when(F.col("event_id") % 3 == 0, '{"k": 1, "x": 2}').otherwise('{"k": 1}')
    note = F.when(F.col("event_id") % 4 == 0, "a\nb").otherwise("fine")
    return t(spark, d, "events").select("event_id", text.known_keys_only(json, ["k"]).alias("known"), text.valid_note(F.lit("owner"), note).alias("valid"))


@query("SELECT surface_id, array_to_string(list_slice(l, 1, 5), ', ') || CASE WHEN len(l) > 5 THEN ' and ' || (len(l) - 5) || ' more' ELSE '' END AS names FROM (SELECT surface_id, list_sort(list(DISTINCT epoch_id)) AS l FROM objects GROUP BY 1)")
def first_names(spark, d):
    """The first names and how many more."""
    return t(spark, d, "objects").groupBy("surface_id").agg(verify.first_names(F.collect_set("epoch_id")).alias("names"))


@query("SELECT event_id, strftime(ts, 'snap-%Y%m%d-%H%M%S') AS id, date_trunc('second', ts) AS taken FROM events")
def snapshot_ids(spark, d):
    """Times out of names."""
    name = F.date_format("ts", "'snap-'yyyyMMdd-HHmmss")
    return t(spark, d, "events").select("event_id", name.alias("id"), F.to_timestamp(F.regexp_extract(name, r"^snap-(\d{8}-\d{6})$", 1), "yyyyMMdd-HHmmss").cast("timestamp_ntz").alias("taken"))


@query("SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN contains(right(text, 60), chr(10)) THEN '...' || substr(right(text, 60), strpos(right(text, 60), chr(10)) + 1) ELSE '...' || right(text, 60) END AS tail FROM documents")
def tails(spark, d):
    """The last lines of a long text."""
    return t(spark, d, "documents").select("doc_id", text.last_lines(F.col("text"), 60).alias("tail"))


# Dumps made of the tables: one per region, its nations as a COPY block or as INSERT statements.
def _dumps(spark, d):
    n = t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.concat_ws("\t", "n_nationkey", "n_name"))).alias("rows"))
    copy = F.concat(F.lit("-- PostgreSQL database dump\n\nCOPY public.nation (k, n) FROM stdin;\n"), F.array_join("rows", "\n"), F.lit("\n\\.\n\nCOPY public.empty (k) FROM stdin;\n\\.\n"))
    insert = F.concat(F.lit("-- MySQL dump 10.13  Distrib 8.4.11\nINSERT INTO `nation` VALUES "), F.array_join(F.transform("rows", lambda r: F.concat(F.lit("(1,'"), F.replace(r, F.lit("\t"), F.lit(");(")), F.lit("')"))), ","), F.lit(";\n-- Dump completed on 2026-01-01\n"))
    return n.select(F.concat(F.lit("region-"), F.col("n_regionkey").cast("string")).alias("path"), copy.alias("copy"), insert.alias("insert"))


@query("SELECT 'region-' || n_regionkey AS path, 'plain' AS kind, 'public' AS schema_name, 'nation' AS table_name, count(*) AS rows FROM nation GROUP BY 1 UNION ALL SELECT DISTINCT 'region-' || n_regionkey, 'plain', 'public', 'empty', CAST(0 AS BIGINT) FROM nation")
def dump_copy_counts(spark, d):
    """Rows per table of plain dumps."""
    return dumps.table_counts(_dumps(spark, d).select("path", F.encode("copy", "utf-8").alias("content"))).select("path", "kind", "schema_name", "table_name", "rows")


@query("SELECT 'region-' || n_regionkey AS path, 'nation' AS table_name, count(*) AS rows FROM nation GROUP BY 1")
def dump_insert_counts(spark, d):
    """Rows per table of INSERT dumps, with brackets and semicolons inside of quotes."""
    return dumps.table_counts(_dumps(spark, d).select("path", F.encode("insert", "utf-8").alias("content"))).select("path", "table_name", "rows")


_CUT = "CASE WHEN n_nationkey % 5 = 3 THEN 'the dump ends within the rows of db' || n_regionkey || ':public.t' WHEN n_nationkey % 5 = 4 THEN 'unknown dumps are not counted' END"


@query(f"""SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 2 THEN 'mysql' WHEN n_nationkey % 5 < 2 THEN 'cluster' END AS kind, CASE WHEN n_nationkey % 5 = 2 THEN n_name END AS database, CASE WHEN n_nationkey % 5 = 2 THEN '8.4.' || n_nationkey WHEN n_nationkey % 5 < 2 THEN '16.' || n_nationkey END AS server,
  CASE WHEN n_nationkey % 5 < 2 THEN ['pg_cron', 'x-y'] WHEN n_nationkey % 5 = 2 THEN [] END AS extensions, CASE WHEN n_nationkey % 5 < 3 THEN n_nationkey % 5 < 2 END AS creates_database, CASE WHEN n_nationkey % 5 < 2 THEN n_nationkey WHEN n_nationkey % 5 = 2 THEN 0 END AS cron_jobs,
  CASE WHEN n_nationkey % 5 < 2 THEN 2 WHEN n_nationkey % 5 = 2 THEN 1 END AS tables, CASE WHEN n_nationkey % 5 < 2 THEN n_regionkey + 3 WHEN n_nationkey % 5 = 2 THEN n_nationkey END AS rows, {_CUT} AS problem FROM nation""")
def dump_facts(spark, d):
    """Kind, databases, versions, extensions and scheduled jobs of dumps of a server, cut ones and others."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    lines = lambda c: F.repeat(F.lit("1\tx\n"), c.cast("int"))
    block = lambda db, table, c: F.concat(F.lit("\\connect "), db, F.lit("\nCOPY "), F.lit(table), F.lit(" (a, b) FROM stdin;\n"), lines(c))
    end = F.lit("\\.\n")
    facts = F.concat(F.lit("--\n-- PostgreSQL database cluster dump\n--\n-- Dumped from database version 16."), n.cast("string"), F.lit('\nCREATE DATABASE x;\nCREATE EXTENSION IF NOT EXISTS pg_cron WITH SCHEMA x;\nCREATE EXTENSION "x-y";\n'))
    cluster = F.concat(facts, block(F.concat(F.lit("db"), r), "public.t", F.col("n_regionkey")), end, block(F.lit("-reuse-previous=on \"two\""), "t", F.lit(3)), end, block(F.lit("two"), "cron.job", n), end, block(F.lit("two"), "cron.job_run_details", F.lit(9)), end)
    cut = F.concat(facts, block(F.concat(F.lit("db"), r), "public.t", F.lit(2)))
    mysql = F.concat(F.lit("-- MySQL dump 10\n-- Host: h    Database: "), F.col("n_name"), F.lit("\n-- Server version\t8.4."), n.cast("string"), F.lit("\nINSERT INTO `t` VALUES (0,'\n);(')"), F.repeat(F.lit(",(1,'a\\')')"), (n - 1).cast("int")), F.lit(";\n-- Dump completed on 2026-01-01\n"))
    content = F.when(n % 5 == 4, F.lit("words\n")).when(n % 5 == 3, cut).when(n % 5 == 2, mysql).otherwise(cluster)
    files = t(spark, d, "nation").select(n.cast("string").alias("path"), F.encode(content, "utf-8").alias("content"))
    return dumps.dump_facts(files).withColumn("n_nationkey", F.col("path").cast("int")).drop("path")


@query("SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def sqlpass_join(spark, d):
    """X1, pass-through: a user's read-only SQL over the snapshot."""
    return sqlpass.run(spark, "SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1", {n: t(spark, d, n) for n in ("nation", "region")})


_WINDOWED = "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders"


@query(_WINDOWED)
def sqlpass_window(spark, d):
    """X1, pass-through: a window function of the user's."""
    return sqlpass.run(spark, _WINDOWED, {"orders": t(spark, d, "orders")})


_ROLLUP = "SELECT n_regionkey, n_nationkey, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)"


@query(_ROLLUP)
def sqlpass_rollup(spark, d):
    """X1, pass-through: a rollup of the user's."""
    return sqlpass.run(spark, _ROLLUP, {n: t(spark, d, n) for n in ("customer", "nation")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey < 500")
def row_predicate(spark, d):
    """Rows of one table by a user's predicate; none is an error."""
    return sqlpass.matching(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_mktsegment = 'BUILDING' AND c_custkey < 500").select("c_custkey", "c_name")


_ENTRY = """array_to_string(list_transform(regexp_extract_all(hex(encode(path)), '..'), lambda h: CASE WHEN CAST('0x' || h AS INTEGER) BETWEEN 33 AND 126 AND h NOT IN ('25', '2F', '5C', '3A', '2A', '3F', '22', '3C', '3E', '7C') THEN chr(CAST('0x' || h AS INTEGER)) ELSE '%' || h END), '')"""


@query(f"SELECT path, {_ENTRY} AS name, path AS back FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL)")
def entry_names(spark, d):
    """Names of archive entries, and back."""
    rows = t(spark, d, "files").select("path").filter("path IS NOT NULL").distinct().withColumn("name", ids.entry_name(F.col("path")))
    return rows.withColumn("back", ids.percent_decoded(F.col("name")))


@query("SELECT surface_id, count(DISTINCT epoch_id) || CASE WHEN count(DISTINCT epoch_id) = 1 THEN ' epoch' ELSE ' epochs' END || ', ' || count(DISTINCT reason) || CASE WHEN count(DISTINCT reason) = 1 THEN ' entry' ELSE ' entries' END AS words FROM epochs GROUP BY 1")
def counts_in_words(spark, d):
    """Counts with their nouns."""
    grouped = t(spark, d, "epochs").groupBy("surface_id").agg(F.count_distinct("epoch_id").alias("e"), F.count_distinct("reason").alias("r"))
    return grouped.select("surface_id", F.concat(text.counted(F.col("e"), "epoch"), F.lit(", "), text.counted(F.col("r"), "entry", "entries")).alias("words"))


@query("SELECT epoch_id, path, CASE WHEN ino % 5 = 0 THEN 'gone' ELSE 'changed' END AS problem FROM (SELECT epoch_id, path, max(ino) AS ino, max(size) AS size FROM files GROUP BY 1, 2) WHERE ino % 5 = 0 OR (ino % 7 = 0 AND size IS NOT NULL)")
def unsteady_files(spark, d):
    """Files that changed or went while they were read."""
    f = t(spark, d, "files").groupBy("epoch_id", "path").agg(*[F.max(c).alias(c) for c in ("ino", "size", "mtime_ns", "ctime_ns")])
    again = f.filter("ino % 5 <> 0").withColumn("size", F.when(F.col("ino") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return chunks.unsteady(f, again, ["epoch_id", "path"])


@query(f"""WITH {_CHUNKS}, f AS (SELECT event_id, max(seq) AS last, sum(length(piece)) AS size FROM c GROUP BY 1)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'write' WHEN 1 THEN 'delete' WHEN 2 THEN 'rewrite' WHEN 3 THEN 'truncate' END AS action, CAST(CASE event_id % 5 WHEN 2 THEN 16 WHEN 3 THEN size - length(piece) ELSE 0 END AS BIGINT) AS start, CAST(CASE event_id % 5 WHEN 0 THEN size WHEN 2 THEN size - 16 ELSE 0 END AS BIGINT) AS bytes
FROM f JOIN (SELECT event_id, seq, piece FROM c) p USING (event_id) WHERE seq = last AND event_id % 5 < 4""")
def files_rewritten(spark, d):
    """What brings files that are there to the wanted contents, from the first chunk that differs on."""
    refs, n = _refs(spark, d), F.col("event_id") % 5
    last = F.max("seq").over(Window.partitionBy("event_id"))
    wanted = refs.withColumn("last", last).filter((n != 1) & ((n != 3) | (F.col("seq") < F.col("last"))))
    present = refs.filter(n != 0).withColumn("id", F.when((n == 2) & (F.col("seq") == 1), "other").otherwise(F.col("id")))
    return chunks.rewrites(wanted, present, ["event_id"])


@query("SELECT 'nation' AS table_name, count(*) AS rows, CAST(count(n_nationkey) + count(n_name) + count(n_regionkey) AS BIGINT) AS cells FROM nation UNION ALL SELECT 'documents', count(*), CAST(count(doc_id) + count(text) + count(lang) + count(source) + count(n_chars) + count(surface_id) + count(created_at) + count(received_at) AS BIGINT) FROM documents")
def every_row_read(spark, d):
    """V4: every row and column of tables is read."""
    return verify.read_every_row({n: t(spark, d, n) for n in ("nation", "documents")})
