"""Readers of archives, settings, roles, attachments, mail and database files, and the operators beside them."""

import io
import os
import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import catalogs, changelog, chunks, mail, restores
from tidemark.sources import applications, archives, files, tables


def got(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# archives


def test_checksums():
    assert archives.crc64(b"123456789") == 0x995DC9BBDF1939FA
    rng = random.Random(1)
    data = rng.randbytes(20_000)
    slow = 0
    for i in range(0, len(data), 700):
        slow = archives.crc64(data[i : i + 700], slow)
    assert archives.crc64(data) == slow and archives.crc64(data[5_000:], archives.crc64(data[:5_000])) == slow


def test_archives_in_turns_views_ends_and_damage(spark):
    docs = [archives.document(n=i, name=f"d{i}", ok=i % 2 == 0) for i in range(8)]
    whole = archives.write_archive({"a": docs, "b": docs[:3], "none": []}, "db", ("v",))
    flipped = bytearray(whole)
    flipped[whole.index(docs[5]) + 8] ^= 1
    files = [("whole", whole), ("flipped", bytes(flipped)), ("cut", whole[: whole.index(docs[4]) + 9]), ("open", archives.write_archive({"a": docs}, "db", cut=("a",))), ("none", b""), ("null", None), ("text", b"hello world"), ("long", whole[:4] + struct.pack("<i", 1 << 30))]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = {(r.path, r.namespace): r for r in archives.archive_namespaces(df).collect()}
    assert [tuple(rows["whole", n])[2:7] for n in ("db.a", "db.b", "db.none", "db.v")] == [(False, 8, sum(map(len, docs)), True, True), (False, 3, sum(map(len, docs[:3])), True, True), (False, 0, 0, True, None), (True, 0, 0, True, None)]
    assert rows["flipped", "db.a"].sound is False and rows["flipped", "db.b"].sound is True
    assert rows["open", "db.a"].ended is False and rows["open", "db.a"].sound is None
    assert {p for p, n in rows if n is None} == {"cut", "none", "null", "text", "long"}
    assert archives.archive_namespaces(df.limit(0)).count() == 0


def test_document_fields_pass_over_other_kinds():
    body = b"\x03sub\0" + archives.document(x=1) + b"\x01d\0" + b"\0" * 8 + b"\x10i\0" + struct.pack("<i", -5) + b"\x05b\0" + struct.pack("<i", 3) + b"\0abc" + archives.document(last="é")[4:-1]
    doc = struct.pack("<i", len(body) + 5) + body + b"\0"
    found = archives.document_fields(doc)
    assert found["i"] == -5 and found["last"] == "é" and found["sub"] is None
    with pytest.raises(ValueError):
        list(archives.read_archive(io.BytesIO(b"").read))


# settings


def test_settings():
    values, lost = applications.settings('A=1\n# no\n\nexport B = "x\\n\\"${A}\\"\ny" # tail\nC=\'${A}\'\nD=${A}-${Z}\nE=a#b #c\nF=\nD.x=${D}')
    assert values == {"A": "1", "B": 'x\n"1"\ny', "C": "${A}", "D": "1-", "E": "a#b", "F": "", "D.x": "1-"} and lost == {"D": "Z"}
    for bad in ("just words", "1A=2", "A='x", 'A="x\ny'):
        with pytest.raises(ValueError):
            applications.settings(bad)


def test_settings_files_and_migrations(spark):
    files = spark.createDataFrame([("a", "K=v\nK=w"), ("b", None), ("c", "?"), ("d", "")], "path string, text string").withColumn("key", F.lit(1))
    assert got(applications.read_settings(files), "path", "key", "value", "problem") == [("a", "K", "w", None), ("c", None, None, "line 1 is not KEY=value")]
    paths = spark.createDataFrame([("database/migrations/a.php",), ("database/migrations/x/b.php",), ("database/migrations/c.txt",), ("database/migrations/d.php",), (None,), ("database/migrations/d.php",)], "path string")
    assert got(applications.pending_migrations(paths, spark.createDataFrame([("a",), (None,)], "migration string"))) == [("d",)]
    assert applications.pending_migrations(paths.limit(0), spark.createDataFrame([], "migration string")).count() == 0


# roles


def test_roles(spark):
    script = 'SET x = y;\nCREATE ROLE app;\nCREATE ROLE "odd ""name";\nALTER ROLE app WITH LOGIN;\nALTER ROLE app IN DATABASE d SET a = b;\nCOMMENT ON ROLE app IS \'c\';\nALTER ROLE ghost WITH LOGIN;\nGRANT "odd ""name" TO app GRANTED BY postgres;\nGRANT app TO other;\n'
    roles, members = applications.role_script(spark.createDataFrame([(script,), (None,), ("",)], "script string"))
    assert got(roles) == [("app", ["CREATE ROLE app;", "ALTER ROLE app WITH LOGIN;", "COMMENT ON ROLE app IS 'c';"]), ('odd "name', ['CREATE ROLE "odd ""name";'])]
    assert got(members) == [("app", "other"), ('odd "name', "app")]
    names = spark.createDataFrame([("app",), ('odd "name',), ("lost",)], "role string")
    kept, both, missing = applications.chosen_roles(roles, members, names)
    assert (kept.count(), got(both), got(missing)) == (2, [('odd "name', "app")], [("lost",)])


def test_role_findings(spark):
    roles = spark.createDataFrame([("su", True, True, True, False), ("w", False, True, False, False), ("m", False, True, True, True), ("clean", False, False, False, False)], "role string, super boolean, create_role boolean, create_db boolean, bypass boolean")
    t = spark.createDataFrame([("su", "a", True, True), *[("w", f"t{i}", True, i == 0) for i in range(5)], ("w", "t0", True, True), ("m", "x", False, True)], "role string, table_name string, writes boolean, hidden boolean")
    rows = got(catalogs.role_findings(roles, t))
    assert rows == [
        ("m", "role", "m writes to no table but can create roles and create databases; a read-only role is enough"),
        ("su", "role", "connects as su, a superuser; a read-only role is enough"),
        ("w", "role", "w can write to 5 table(s) (t0, t1, t2 and 2 more) and create roles; a read-only role is enough"),
        ("w", "row_security", "row-level security hides rows of 1 table(s) (t0) from w"),
    ]


# attachments


def test_attachments_of_a_dump(spark):
    create = "CREATE TABLE `m` (\n  `meta_id` bigint,\n  `meta_key` text,\n  `meta_value` text,\n  KEY `k` (`meta_key`)\n) ENGINE=x;\n"
    insert = "INSERT INTO `m` VALUES (1,'_wp_attached_file','a\\'b''c.png'),(2,'_other','x'),(3,'_wp_attached_file',NULL),(4,'_wp_attached_file','(d, e).jpg');\nINSERT INTO `n` VALUES (1,'_wp_attached_file','z');\n"
    dumps = spark.createDataFrame([("ok", create + insert), ("bad", create + "INSERT INTO `m` VALUES (1,'k');\n"), ("null", None)], "path string, text string")
    assert got(applications.attached_files(dumps), "path", "file", "problem") == sorted([("bad", None, "m: a row of 2 values"), ("ok", "(d, e).jpg", None), ("ok", "a'b'c.png", None)], key=repr)
    named = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "file string")
    stored = spark.createDataFrame([("wp-content/uploads/a",), ("other/b",), (None,)], "path string")
    assert got(applications.absent_attachments(named, stored)) == [("b",)]


# database files


def test_key_ranges_and_predicates():
    for low, high, parts in ((0, 9, 3), (5, 5, 8), (-7, 100, 7), (1, 3, 10)):
        ranges = tables.key_ranges(low, high, parts)
        assert [x for a, b in ranges for x in range(a, b + 1)] == list(range(low, high + 1)) and len(ranges) <= parts
    assert tables.key_ranges(None, None, 4) == []
    assert tables.range_predicates('a"b', 1, 4, 2) == ['("a""b" BETWEEN 1 AND 2 OR "a""b" IS NULL)', '"a""b" BETWEEN 3 AND 4']
    assert tables.range_predicates("k", None, None, 2, "mysql") == ["`k` IS NULL"]


def test_sqlite_tables(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "odd ""t" ("a b" INTEGER, s VARCHAR(3), f REAL, n NUMERIC, b BLOB)')
        db.executemany('INSERT INTO "odd ""t" VALUES (?, ?, ?, ?, ?)', [(i, f"s{i}", i / 2, i, bytes([i])) for i in range(50)] + [(None, None, None, None, None), ("text", 5, "x", "y", "z")])
        db.execute("CREATE TABLE empty (a INT)")
        db.execute("CREATE TABLE keyed (k TEXT PRIMARY KEY) WITHOUT ROWID")
        db.execute("INSERT INTO keyed VALUES ('q')")
        db.execute('CREATE VIEW v AS SELECT "a b" AS a FROM "odd ""t" WHERE "a b" < 3')
    db.close()
    spark.dataSource.register(tables.SqliteDataSource)
    read = lambda t: spark.read.format("sqlite").option("path", path).option("table", t).option("parts", "3").load()
    odd = read('odd "t')
    assert dict(odd.dtypes) == {"a b": "bigint", "s": "string", "f": "double", "n": "string", "b": "binary"}
    assert odd.count() == 52 and odd.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in odd.filter("s IN ('s7', '5')").orderBy("s").collect()] == [(None, "5", None, "y", b"z"), (7, "s7", 3.5, "7", b"\x07")]
    assert read("empty").count() == 0 and got(read("keyed")) == [("q",)] and read("v").count() == 3
    assert got(tables.sqlite_counts(spark, path)) == [("empty", 0), ("keyed", 1), ('odd "t', 52)]
    tables.copied_file(path, path + "2")
    assert tables.sqlite_tables(path + "2") == ["empty", "keyed", 'odd "t']
    with pytest.raises(Exception):  # noqa: B017
        read("none").count()


# mail


def test_folders_and_messages(spark):
    f = spark.createDataFrame([("m", "In", None, False), ("m", "Spam", "\\Junk", False), ("g", "All", None, True), ("g", "Label", None, None), ("g", "Bin", "\\Trash", False)], "mailbox string, folder string, use string, all_mail boolean")
    assert got(mail.chosen_folders(f)) == [("g", "All"), ("m", "In")]
    assert got(mail.chosen_folders(f, include=["Spam", "Label"])) == [("g", "Label"), ("m", "Spam")]
    assert got(mail.chosen_folders(f, exclude=["All"])) == [("g", "Label"), ("m", "In")]
    m = spark.createDataFrame([("m", "In", 1, 5, 10, "a"), ("m", "In", 2, 5, 20, "a"), ("m", "Old", 9, 3, 1, None)], "mailbox string, folder string, uid int, uid_validity int, size long, digest string")
    assert got(mail.folder_stats(m)) == [("m", "In", 2, 30, 5, 2), ("m", "Old", 1, 1, 3, 9)]
    before = spark.createDataFrame([("m", "In", 5, 1), ("m", "Old", 2, 99)], "mailbox string, folder string, uid_validity int, highest_uid int")
    assert got(mail.new_messages(m, before), "folder", "uid") == [("In", 2), ("Old", 9)]
    assert got(mail.stored_bodies(m.filter("digest IS NOT NULL"))) == [("m", "a", 20, 2)]
    restored = spark.createDataFrame([("m", "In", "a"), ("m", "In", "x")], "mailbox string, folder string, digest string")
    assert got(mail.compared_messages(m, restored)) == [("m", "In", 2, 0, 1, False), ("m", "Old", 1, 1, 0, True)]


# operators


def test_live_versions(spark):
    v = [("a", "1", 10, False, False, 3), ("a", "2", 20, False, False, 2), ("a", "m", 30, True, True, 1), ("b", "m", 5, True, True, 1), ("c", "1", 7, False, True, 1), ("c", "2", 7, False, False, 2), ("d", "1", 9, False, True, 1), ("d", "m", 5, True, False, 2)]
    df = spark.createDataFrame(v, "key string, version string, at int, marker boolean, latest boolean, place int")
    assert got(restores.live_versions(df, ["key"], "version", "at", "marker", "latest", "place")) == [("a", "2", True), ("b", None, False), ("c", "1", False), ("d", "1", False)]


def test_copies_segments_exports_and_turns(spark):
    listed = spark.createDataFrame([("first", "e1"), ("first", "e2"), ("c1", "e1"), ("c2", "e3"), (None, "e1"), ("c1", None)], "store string, epoch string")
    assert got(restores.lacking_copies(listed, "epoch", "store", "first")) == [("c1", "e2"), ("c2", "e1"), ("c2", "e2")]
    assert restores.lacking_copies(listed.filter("store = 'first'"), "epoch", "store", "first").count() == 0
    names = ["00000001000000000000000A", "00000002000000000000000B", "00000001000000000000000F", "00000002.history", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert got(restores.segments_between(df, "name", names[0], "00000001000000000000000B")) == sorted([(names[0],), (names[1],), (names[3],)])
    e = spark.createDataFrame([(i, i % 3, None if i == 4 else "x") for i in range(8)], "id int, g int, t string")
    chosen = spark.createDataFrame([(2,), (2,), (None,), (77,)], "id int")
    assert got(restores.export_rows(e, "id", chosen, g=1, t="x"), "id") == [(1,), (2,), (7,)]
    assert restores.export_rows(e, "id").count() == 8 and got(restores.export_rows(e, "id", t="x", g=0), "id") == [(0,), (3,), (6,)] and got(restores.export_rows(e, "id", chosen), "id") == [(2,)]
    o = spark.createDataFrame([("a.pack",), ("b.idx",), ("c.snap",), ("d",), (None,)], "key string")
    assert got(restores.deletion_turns(o, "key", [[".pack"], [".idx"], [".snap"]])) == sorted([("a.pack", 1), ("b.idx", 2), ("c.snap", 4), ("d", 3), (None, 3)], key=repr)
    ids = spark.createDataFrame([(i * i,) for i in range(95)], "id long")
    sizes = got(restores.batches_by_id(ids, "id", 10).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a")))
    assert sizes == sorted([(b, 10 if b < 9 else 5, (b * 10) ** 2) for b in range(10)], key=repr)


def test_parts_in_order(spark):
    rows = [("z", 1, "a", 0), ("z", 2, "a", 1), ("z", 3, "b", 0), ("z", 4, "b", 2), ("z", 5, "a", 0), ("y", 1, "a", 1), ("y", 2, "é", None), ("y", 3, "f", 0)]
    df = spark.createDataFrame(rows, "archive string, place int, name string, part int")
    assert got(restores.parts_in_order(df, ["archive"], "place", "name", "part")) == [("y", 2), ("z", 2)]


def test_triggers_and_prefixes(spark):
    full = ["INSERT", "UPDATE", "DELETE", "TRUNCATE"]
    t = spark.createDataFrame([("ok", True, full), ("off", False, full), ("part", True, ["INSERT"]), ("two", False, full), ("two", True, full), ("null", True, None)], "table_name string, enabled boolean, events array<string>")
    every = spark.createDataFrame([(n,) for n in ("ok", "off", "part", "two", "null", "none", "skip")], "table_name string")
    assert got(restores.capture_states(every, t, spark.createDataFrame([("skip",)], "table_name string"))) == [("none", "missing"), ("null", "partial"), ("off", "disabled"), ("ok", "valid"), ("part", "partial"), ("two", "valid")]
    p = spark.createDataFrame([("a",), ("a/b",), ("a/c",), ("a/b/c/d",), ("x",), ("",), (None,)], "p string")
    could = lambda *g: {r.p for r in p.filter(restores.could_hold(F.col("p"), g)).collect()}
    assert could("a/b/*.x") == {"a", "a/b", "a/b/c/d", ""} and could("/x/y") == {"x", ""} and could("*.log") == could() == {"a", "a/b", "a/c", "a/b/c/d", "x", "", None}


def test_what_all_consumers_have_seen(spark):
    changes = spark.range(1, 12).toDF("xid")
    seen = lambda *s: [r.xid for r in changelog.collectable(changes, spark.createDataFrame([(x,) for x in s], "snapshot string")).orderBy("xid").collect()]
    assert seen("3:8:3,5", "2:10:4") == [1, 2, 6, 7] and seen("5:9:3") == list(range(1, 9))
    assert seen("3:8:", "unreadable") == [] and len(seen()) == 11


@pytest.mark.parametrize(
    ("command", "rule"),
    [
        ("psql -c 'DROP TABLE sessions'", "SQL DROP"), ('psql -c "DROP materialized  VIEW v"', "SQL DROP"), ("drop role x", "SQL DROP"), ('TRUNCATE "users"', "SQL TRUNCATE"), ("truncate table orders", "SQL TRUNCATE"),
        ('psql -c "DELETE FROM users"', "SQL DELETE without WHERE"), ("delete from t ;", "SQL DELETE without WHERE"), ("delete from t where a", None), ("dropdb shop", "dropdb"), ("x;dropdb shop", "dropdb"), ("mydropdb shop", None),
        ("terraform destroy", "terraform destroy"), ("tofu -chdir=x destroy", "terraform destroy"), ("terraform apply -destroy", "terraform destroy"), ("terraform apply", None), ("prisma migrate reset", "prisma migrate reset"),
        ("prisma db push --force-reset", "prisma db push --force-reset"), ("prisma db push", None), ("supabase db reset", "supabase db reset"), ("rails db:drop", "rails db:drop / db:reset"), ("rake x db:schema:load", "rails db:drop / db:reset"),
        ("rails db:migrate", None), ("manage.py flush", "django flush"), ("manage.py migrate", None), ("select * from drop_log", None), ("", None), (None, None),
    ],
)
def test_destructive_rules(spark, command, rule):
    assert spark.createDataFrame([(command,)], "c string").select(text.first_rule(F.col("c"))).first()[0] == rule


def test_stored_damage(spark):
    a = [
        ("r1", 1, "failed", "Restore", None, False, "pack 1 is missing", None), ("r1", 0, "failed", "RepositoryRead", None, False, "x is missing", None), ("r2", 0, "failed", "RepositoryIntegrity", None, False, " all ", None),
        ("r3", 0, "failed", "X", "check", False, "table not found", None), ("r3", 1, "failed", "X", "data", False, "not found", ""), ("r4", 0, "passed", "X", None, False, "not found", None), ("r5", 0, "failed", "X", None, True, "not found", None),
        ("r6", 0, "failed", "X", None, False, "Not Found", "No such object y"), ("r7", 0, "failed", "X", None, False, "Is Missing", "NOT FOUND"),
    ]
    df = spark.createDataFrame(a, "report string, place int, status string, name string, kind string, passed boolean, actual string, message string")
    assert got(catalogs.stored_damage(df, ["report"], "place")) == [("r1", "pack 1 is missing"), ("r2", "all"), ("r6", "Not Found")]


def test_fingerprints_are_those_of_a_rolling_window():
    rng = random.Random(3)
    data = rng.randbytes(400)
    degree = chunks.POLYNOMIAL.bit_length() - 1

    def rest(v):
        while v.bit_length() > degree:
            v ^= chunks.POLYNOMIAL << (v.bit_length() - degree - 1)
        return v

    slow = [rest(int.from_bytes(data[max(0, i + 1 - chunks.WINDOW) : i + 1], "big")) for i in range(len(data))]
    assert chunks.fingerprints(data).tolist() == slow


def test_cuts_do_not_depend_on_blocks(monkeypatch):
    data = random.Random(5).randbytes(50_000)
    whole = chunks.cut_points(data, 64, 512, 4096)
    monkeypatch.setattr(chunks, "BLOCK", 1000)
    assert chunks.cut_points(data, 64, 512, 4096) == whole
    lengths = [b - a for a, b in zip([0, *whole], whole, strict=False)]
    assert sum(lengths) == len(data) and max(lengths) <= 4096 and min(lengths[:-1]) >= 64
    assert chunks.cut_points(data, 64, 512, 4096, 0x2982FD2F72D9F5) != whole


def test_files_are_listed_level_by_level(spark, tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "a/b/c/deep.txt").write_text("deep")
    (tmp_path / "top").write_bytes(b"")
    (tmp_path / "link").symlink_to("a")
    os.mkfifo(tmp_path / "pipe")
    (tmp_path / "empty").mkdir()
    found = got(files.listed(spark, str(tmp_path)), "path", "kind", "size", "target")
    assert found == [("a", "folder", None, None), ("a/b", "folder", None, None), ("a/b/c", "folder", None, None), ("a/b/c/deep.txt", "file", 4, None), ("empty", "folder", None, None), ("link", "link", None, "a"), ("top", "file", 0, None)]
    assert got(files.by_prefix(files.listed(spark, f"file://{tmp_path}"), "a/b"), "path") == [("a/b/c/deep.txt",)]


def test_objects_are_put_whole_read_and_deleted(spark, tmp_path):
    df = spark.createDataFrame([("x/y", b"1"), ("z", None), ("../up", b"2"), ("/abs", b"2"), ("a//b", b""), (None, b"")], "key string, content binary")
    assert {r.key: r.outcome for r in files.put(df, str(tmp_path)).collect() if r.outcome == "written"} == {"x/y": "written", "z": "written"}
    assert not list(tmp_path.parent.glob("up")) and not list(tmp_path.rglob("*.part"))
    other = df.withColumn("content", F.lit(b"other")).filter("key = 'x/y'")
    assert files.put(other, str(tmp_path)).first().outcome == "there" and (tmp_path / "x/y").read_bytes() == b"1"
    assert files.put(other, str(tmp_path), replace=True).first().outcome == "written"
    assert got(files.get(df, str(tmp_path)).filter("content IS NOT NULL")) == [("x/y", bytearray(b"other")), ("z", bytearray(b""))]
    twice = spark.createDataFrame([("z",), ("none",)], "key string")
    assert got(files.delete(twice, str(tmp_path))) == [("none", "missing"), ("z", "deleted")]
    assert files.delete(twice, str(tmp_path)).filter("outcome = 'missing'").count() == 2


def test_descendants_of_long_chains_and_cycles(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)] + [("12", "3"), ("q", "r"), (None, "0")], "parent string, child string")
    assert sorted(int(r.name) for r in changelog.descendants(edges, spark.createDataFrame([("2",), (None,)], "name string")).collect()) == list(range(2, 13))
    with pytest.raises(ValueError):
        changelog.descendants(edges, spark.createDataFrame([("0",)], "name string"), depth=3)
    assert changelog.descendants(edges, spark.createDataFrame([], "name string")).count() == 0


def test_entry_names_come_back(spark):
    from tidemark.functions import ids
    from tidemark.sources.binary import entry_name

    texts = ["a b", "é/ü", "100%", 'x\\y:*?"<>|', "", "plain-name_1.txt", "\n", "€"]
    df = spark.createDataFrame([(x,) for x in texts] + [(None,)], "t string").withColumn("n", ids.entry_name(F.col("t")))
    assert [(r.t, r.n) for r in df.filter("t IS NOT NULL").collect()] == [(x, entry_name(x)) for x in texts]
    assert [r[0] for r in df.select(ids.percent_decoded(F.col("n"))).collect()][: len(texts)] == texts


def test_rows_before_and_running_sums_in_buckets(spark):
    from pyspark.sql import Window

    from tidemark.operators import logs

    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice(["a", "b", None]), i, rng.randint(0, 60), rng.randint(0, 3)) for i in range(300)], "g string, i int, at int, v int")
    w = Window.partitionBy("g").orderBy("at", "i")
    plain = got(df.select("i", F.lag("v").over(w), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cut = F.floor(F.col("at") / 7)
    rows = logs.with_before(df, ["g"], ["at", "i"], F.col("v"), cut)
    assert got(logs.running_sum(rows, ["g"], ["at", "i"], F.col("v"), "s", cut), "i", "_before", "s") == plain


def test_rewrites_and_unsteady_files(spark):
    make = lambda rows: spark.createDataFrame([(f, i, 10 * i, n, x) for f, i, n, x in rows], "file string, seq int, offset long, length long, id string")
    want = make([("same", 0, 10, "a"), ("late", 0, 10, "a"), ("late", 1, 4, "b"), ("new", 0, 3, "n"), ("short", 0, 10, "a"), ("long", 0, 10, "a"), ("long", 1, 10, "b")])
    have = make([("same", 0, 10, "a"), ("late", 0, 10, "a"), ("late", 1, 4, "x"), ("old", 0, 3, "n"), ("short", 0, 10, "a"), ("short", 1, 5, "z"), ("long", 0, 10, "a")])
    assert got(chunks.rewrites(want, have, ["file"])) == [("late", "rewrite", 10, 4), ("long", "rewrite", 10, 10), ("new", "write", 0, 3), ("old", "delete", 0, 0), ("short", "truncate", 10, 0)]
    a = spark.createDataFrame([("x", 1, 1, 1), ("y", 1, 1, None), ("z", 1, 1, 1)], "path string, size int, mtime_ns int, ctime_ns int")
    b = spark.createDataFrame([("x", 1, 1, 1), ("y", 1, 1, 2), ("q", 1, 1, 1)], "path string, size int, mtime_ns int, ctime_ns int")
    assert got(chunks.unsteady(a, b, ["path"])) == [("y", "changed"), ("z", "gone")]


def test_pack_numbers_are_those_of_a_loop():
    import numpy as np

    rng = random.Random(9)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 5, 10, 25]) for _ in range(rng.randint(0, 30))]
        held, number, want = 0, 0, []
        for size in sizes:
            if held >= 10:
                held, number = 0, number + 1
            held += size
            want.append(number)
        found, h, n, at = [], 0, 0, 0
        while at < len(sizes):  # in batches
            stop = at + rng.randint(1, 9)
            out, h, n = chunks._pack_numbers(np.array(sizes[at:stop], np.int64), h, n, 10)
            found += out.tolist()
            at = stop
        assert found == want and (not sizes or (h, n) == (held, number))
