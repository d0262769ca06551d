"""Worked cases with fixed expected values."""

import datetime as dt
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import text
from tidemark.operators import catalogs, changelog, chunks, delta, history, logs, profile, retention, verify
from tidemark.sources import binary, dumps, sqlpass

UTC = "timestamp_ntz"


def at(text_):
    return dt.datetime.fromisoformat(text_)


# Expectations and checks


@pytest.mark.parametrize("bad", ["> broken", ">=", "", "< a"])
def test_expectations_that_do_not_read(bad):
    with pytest.raises(ValueError):
        verify.parse_expectation(bad)


def test_nan_and_suffixed_numbers_are_text(spark):
    df = spark.createDataFrame([("NaN", "NaN"), ("!= nan", "NaN"), ("< inf", "3"), ("3", "3d"), ("> 1", "3f"), ("= 3", "3.0"), ("t", "true")], "e string, a string")
    assert [r[0] for r in df.select(verify.holds(F.col("e"), F.col("a"))).collect()] == [False, True, True, False, False, True, True]


def test_check_validation():
    good = [{"name": "a", "sql": "select {{ taken_at }}", "expect": "> 0"}, {"name": "b", "command": "true"}]
    assert catalogs.validate_checks(good) == []
    bad = [{"sql": "x", "expect": "1"}, {"name": "a", "sql": "x", "command": "y", "expect": "1"}, {"name": "a", "sql": "x"}, {"name": "c", "command": "x", "expect": "1"}, {"name": "d", "sql": "x", "expect": "> z"}, {"name": "e", "sql": "{{ other }} {{ taken_at", "expect": "1"}]
    assert len(catalogs.validate_checks(bad)) == 9
    assert catalogs.substituted("at {{taken_at}}", taken_at="T") == "at T"
    with pytest.raises(ValueError):
        catalogs.substituted("{{x}}", taken_at="T")


def test_tri_state(spark):
    df = spark.createDataFrame([(True, False), (False, None), (True, True)], "p boolean, n boolean")
    assert [r[0] for r in df.select(verify.result(F.col("p"), F.col("n"))).collect()] == ["passed", "failed", "not_run"]


# Erasures


def test_erasure_visibility(spark):
    start = at("2026-10-18T10:00:00")
    cases = [(99, -60, False), (105, 0, False), (103, -1, True), (110, 60, True), (5, 10_800, True)]
    df = spark.createDataFrame([(x, start + dt.timedelta(seconds=s), start) for x, s, _ in cases], "xid long, at timestamp, start timestamp")
    snap = changelog.parse_snapshot(F.lit("100:110:103,107"))
    assert [r[0] for r in df.select(changelog.replays(F.col("xid"), F.col("at"), snap, F.col("start"))).collect()] == [c[2] for c in cases]
    without = spark.createDataFrame([(1, start - dt.timedelta(hours=2), start), (1, start - dt.timedelta(minutes=30), start)], "xid long, at timestamp, start timestamp")
    assert [r[0] for r in without.select(changelog.replays(F.col("xid"), F.col("at"), changelog.parse_snapshot(F.lit("bad")), F.col("start"))).collect()] == [False, True]


# Histories: hourly snapshots b, c, d, e; d opens a new epoch with a complete list


def test_version_history(spark):
    snaps = spark.createDataFrame([("s", 1, True, "e1"), ("s", 2, False, "e1"), ("s", 3, True, "e2"), ("s", 4, False, "e2")], "series string, ord int, complete boolean, epoch string")
    ev = [(1, "same", "present", "x"), (3, "same", "present", "x"), (1, "nginx", "present", "1"), (2, "nginx", "changed", "2"), (3, "nginx", "present", "2"), (4, "nginx", "changed", "3"), (1, "gone", "present", "b"), (1, "back", "present", "a"), (2, "back", "deleted", None), (4, "back", "added", "a")]
    events = spark.createDataFrame([("s", *e) for e in ev], "series string, ord int, path string, event string, sha string")
    found = history.version_islands(events, snaps, ["series"], "path", ["sha"], "epoch")
    got = {(r.path, r.version): (r.first, r.last, r.snapshots, r.epochs, r.current) for r in found.collect()}
    assert got == {("same", 1): (1, 4, 4, 2, True), ("nginx", 1): (1, 1, 1, 1, False), ("nginx", 2): (2, 3, 2, 2, False), ("nginx", 3): (4, 4, 1, 1, True), ("gone", 1): (1, 2, 2, 1, False), ("back", 1): (1, 1, 1, 1, False), ("back", 2): (4, 4, 1, 1, True)}
    assert [(r.path, r.last) for r in history.deleted_only(found, ["series"], "path").collect()] == [("gone", 2)]
    assert sorted(r.path for r in history.state_as_of(events, snaps, ["series"], "path", 2).collect()) == ["gone", "nginx", "same"]


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("a/*.log", "a/x.log", True), ("a/*.log", "a/b/x.log", False), ("a/**/x", "a/b/c/x", True), ("a/**/x", "a/x", True), ("etc", "srv/etc/passwd", True), ("/etc/x", "etc/x/y", True), ("p?", "pq", True), ("p?", "p/", False), ("[ab]c", "bc", True), ("[!ab]c", "bc", False), ("a.c", "abc", False), ("x/**", "x/y", True)],
)
def test_globs(spark, glob, path, hit):
    import re

    assert bool(re.search(history.glob_pattern(glob), path)) is hit


# Retention


def test_retention_tiers(spark):
    cases = [("2026-09-01 02:00", "monthly"), ("2026-09-01 08:00", "base"), ("2026-09-06 02:00", "base"), ("2026-09-07 02:00", "weekly"), ("2026-09-07 09:00", "base"), ("2026-10-01 02:00", "monthly")]
    df = spark.createDataFrame([("x", at(c.replace(" ", "T"))) for c, _ in cases], f"e string, at {UTC}")
    found = retention.tiers(df, ["e"], "at", 7, weekly=4, monthly=12)
    assert [(r.at.strftime("%Y-%m-%d %H:%M"), r.tier) for r in found.orderBy("at").collect()] == cases


def test_a_longer_base_still_takes_the_slot(spark):
    df = spark.createDataFrame([("x", at("2026-09-07T02:00")), ("x", at("2026-09-08T02:00"))], f"e string, at {UTC}")
    assert [r.tier for r in retention.tiers(df, ["e"], "at", 60, weekly=4).collect()] == ["base", "base"]
    hourly = spark.createDataFrame([("x", at("2026-09-10T00:30") + dt.timedelta(hours=h)) for h in range(72)], f"e string, at {UTC}")
    got = retention.tiers(hourly, ["e"], "at", 2, daily=14).groupBy("tier").count().collect()
    assert {r["tier"]: r["count"] for r in got} == {"daily": 3, "base": 69}


def test_months_overflow(spark):
    df = spark.createDataFrame([(at("2028-01-31T10:00"),)], f"at {UTC}")
    assert df.select(cal.plus_months(F.col("at"), 1).alias("x")).first().x == at("2028-03-02T10:00")
    dates = retention.epoch_dates(F.col("at"), cal.plus_months(F.col("at"), 1), F.lit(0))
    assert df.select(dates["opening_retain_until"].alias("x")).first().x == at("2028-03-05T10:00")


def test_keep_newest_and_the_passed_drill(spark):
    data = [("a", d, p) for d, p in enumerate([None, True, None, False, None])] + [("b", d, p) for d, p in enumerate([True, None, True])]
    df = spark.createDataFrame(data, "e string, at int, passed boolean")
    got = {(r.e, r.at) for r in retention.keep_newest(df, ["e"], "at", "passed", 2).filter("kept").collect()}
    assert got == {("a", 4), ("a", 3), ("a", 1), ("b", 2), ("b", 1)}


# Calendars


def test_longest_gaps():
    hours = {"at 02:00": 24, "0 3 * * 1-5": 72, "0 */6 * * *": 6, "0 0 1 * *": 744}
    assert {s: cal.Cron(s).longest_gap().total_seconds() / 3600 for s in hours} == hours


@pytest.mark.parametrize("bad", ["*/30 * * * *", "* * * * *", "0 25 * * *", "at 25:00", "0 0 31 2 *", "1 2 3", "a * * * *"])
def test_schedules_that_are_refused(bad):
    with pytest.raises(ValueError):
        cal.Cron(bad)


def test_day_of_month_or_of_week():
    assert cal.Cron("0 0 13 * 5").next(at("2026-10-17T00:00")) == at("2026-10-23T00:00")


def test_intervals():
    assert [cal.parse_interval(x).total_seconds() / 3600 for x in ("", "daily", "7d", "90m", " 12h ")] == [24, 24, 168, 1.5, 12]
    for bad in ("1m", "59m", "0d", "-2h", "106751992d", "x"):
        with pytest.raises(ValueError):
            cal.parse_interval(bad)


def test_blackouts(spark):
    w = cal.parse_blackout("22:00-02:00, 12:00-12:30")
    times = ["22:00", "23:30", "01:59", "12:10", "21:59", "02:00", "12:30"]
    df = spark.createDataFrame([(at(f"2026-10-17T{x}"),) for x in times], f"at {UTC}")
    got = df.select(cal.in_blackout(F.col("at"), w).alias("i"), cal.blackout_end(F.col("at"), w).alias("e")).collect()
    assert [r.i for r in got] == [True] * 4 + [False] * 3
    assert got[1].e == at("2026-10-18T02:00") and got[4].e is None
    touching = cal.parse_blackout("01:00-02:00,02:00-03:00")
    assert df.limit(1).select(cal.blackout_end(F.lit("2026-10-17 01:30:00").cast("timestamp"), touching).alias("e")).first().e == at("2026-10-17T03:00")
    for bad in ("22:00", "25:00-26:00", "10:00-10:00"):
        with pytest.raises(ValueError):
            cal.parse_blackout(bad)


# Logs


SEGMENTS = [(2, 100, 200, False), (2, 200, 200, False), (2, 200, 300, True), (3, 4, 90, False), (3, 120, 150, False)]


def _segments(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "s string, file int, a long, b long, rotates boolean")


def test_stream_runs(spark):
    runs = logs.stream_runs(_segments(spark, SEGMENTS), ["s"], "file", "a", "b", "rotates").orderBy("file", "a", "b").collect()
    assert [r.run for r in runs] == [1, 1, 1, 1, 2] and [r.gap for r in runs] == [False] * 4 + [True]
    cut = logs.stream_runs(_segments(spark, [(*s[:3], False) for s in SEGMENTS]), ["s"], "file", "a", "b", "rotates").orderBy("file", "a", "b").collect()
    assert [r.gap for r in cut] == [False, False, False, True, True]


def test_first_gap(spark):
    look = lambda rows, f, p: [(r.file, r.a, r.in_run, r.is_gap) for r in logs.first_gap(_segments(spark, rows), ["s"], "file", "a", "b", "rotates", f, p).orderBy("file", "a", "b").collect()]
    assert [r[2] for r in look(SEGMENTS, 2, 150)] == [True, True, True, True, False] and look(SEGMENTS, 2, 150)[-1][3]
    assert not any(r[2] for r in look(SEGMENTS, 2, 50))
    assert look(SEGMENTS[:4], 3, 4) == [(3, 4, True, False)]


def test_recovery_window(spark):
    segs = spark.createDataFrame([("t", 2), ("t", 3), ("t", 5), ("t", None), ("t", 2)], "tl string, seg int")
    bases = spark.createDataFrame([("t", "b", 2, 2), ("t", "late", 5, 6), ("u", "none", 1, 1)], "tl string, base_id string, first_seg int, end_seg int")
    reach = logs.recovery_window(bases, segs, ["tl"])
    assert {r.base_id: (r.reach, r.usable) for r in reach.collect()} == {"b": (3, True), "late": (5, False), "none": (None, False)}
    assert [(r.base_id, r.window_end) for r in logs.windows(reach, bases, ["tl"]).collect()] == [("b", 3)]
    assert [(r.first_missing, r.last_missing) for r in logs.missing_numbers(segs, ["tl"], "seg").collect()] == [(4, 4)]


def test_as_of_matches_a_loop(spark):
    import random

    rng = random.Random(2)
    left = [(rng.choice("ab"), i, rng.choice([None, *range(20)])) for i in range(80)]
    right = [(rng.choice("abc"), rng.choice([None, *range(20)]), f"v{i}") for i in range(30)]
    l, r = spark.createDataFrame(left, "g string, i int, at int"), spark.createDataFrame(right, "g string, t int, v string")  # noqa: E741
    for strict, bucket in ((False, None), (True, None), (False, F.floor(F.col("at_") / 4)), (True, F.floor(F.col("at_") / 4))):
        got = {x.i: x.v for x in logs.as_of(l, r, ["g"], "at", "t", ["v"], strict, bucket).collect()}
        for g, i, a in left:
            fit = [(t, v) for h, t, v in right if h == g and t is not None and a is not None and (t < a if strict else t <= a)]
            assert got[i] == (max(fit)[1] if fit else None)


def test_transactions(spark):
    ev = [("gtid", False), ("begin", False), ("map", False), ("rows", False), ("xid", True), ("gtid", False), ("create", True)]
    df = spark.createDataFrame([("l", i, k, c) for i, (k, c) in enumerate(ev)], "log string, n int, k string, closes boolean")
    assert [r.tx for r in logs.transactions(df, ["log"], ["n"], F.col("closes")).orderBy("n").collect()] == [1] * 5 + [2] * 2


def test_count_band(spark):
    points = spark.createDataFrame([("quiet", 400, 400), ("busy", 1000, 1010), ("gone", 5, 5)], "t string, before long, after long")
    for got, wrong in ((("quiet", 400), ("busy", 1004)), {"gone"}), ((("quiet", 500), ("busy", 1011), ("gone", 5)), {"quiet", "busy"}):
        found = logs.count_band(points, spark.createDataFrame(list(got), "t string, counted long"), ["t"]).filter("NOT holds").collect()
        assert {r.t for r in found} == wrong


# Dumps and binary formats


PLAIN = """--
-- PostgreSQL database dump
--
COPY public.users (id, name) FROM stdin;
1\ta
2\tb
\\.

COPY "Sales"."Order Items" (a) FROM stdin;
\\.

INSERT INTO public.notes VALUES (1, 'x;y');
COPY cron.job_run_details (a) FROM stdin;
1
\\.
"""


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_plain_dumps(spark, pack):
    df = spark.createDataFrame([("d", bytearray(pack(PLAIN.encode())))], "path string, content binary")
    got = {(r.schema_name, r.table_name): r.rows for r in dumps.table_counts(df).collect()}
    assert got == {("public", "users"): 2, ("Sales", "Order Items"): 0, ("public", "notes"): 1}


MYSQL = b"""-- MySQL dump 10.13  Distrib 8.4.11, for Linux
-- Host: localhost    Database: shop
-- Server version\t8.4.11
INSERT INTO `users` VALUES (1,'a),(b'),(2,'it\\'s; (x)');
INSERT INTO `orders` VALUES (1),(2),(3);
DELIMITER ;;
CREATE PROCEDURE p() BEGIN INSERT INTO `users` VALUES (9); END ;;
DELIMITER ;
INSERT INTO `we ``ird` VALUES ("x(y");
-- Dump completed on 2026-01-01
"""


def test_mysql_dumps():
    assert dict(dumps.mysql_counts(MYSQL)) == {("", "users"): 2, ("", "orders"): 3, ("", "we `ird"): 1}
    assert dumps.mysql_facts(MYSQL) == {"database": "shop", "server": "8.4.11", "whole": "yes"}
    with pytest.raises(ValueError):
        dumps.mysql_counts(MYSQL.rsplit(b"\n", 2)[0])
    two = b"-- MySQL dump\nUSE `shop`;\nINSERT INTO `users` VALUES (1);\nUSE `crm`;\nINSERT INTO `users` VALUES (1),(2);\n-- Dump completed\n"
    assert dict(dumps.mysql_counts(two)) == {("shop", "users"): 1, ("crm", "users"): 2}


def test_dumps_that_are_cut_empty_or_none(spark):
    df = spark.createDataFrame([("cut", bytearray(PLAIN[:80].encode())), ("empty", bytearray(b"")), ("null", None), ("custom", bytearray(b"PGDMP\x01"))], "path string, content binary")
    got = {r.path: r.problem for r in dumps.table_counts(df).collect()}
    assert all(got.values()) and "ends within" in got["cut"]
    assert dumps.table_counts(df.limit(0)).count() == 0


def test_dump_source(spark, tmp_path):
    (tmp_path / "a.sql").write_text(PLAIN)
    (tmp_path / "b.sql.part").write_text("x")
    (tmp_path / ".hidden").write_text("x")
    spark.dataSource.register(binary.DumpDataSource)
    got = spark.read.format("dump").option("path", str(tmp_path)).load()
    assert got.groupBy().sum("rows").first()[0] == 3
    assert [r.path.rsplit("/", 1)[1] for r in dumps.read_dumps(spark, str(tmp_path)).collect()] == ["a.sql"]
    assert dumps.newest_object(spark, str(tmp_path), "*.sql").count() == 1


def test_copy_streams(spark):
    data = binary.copy_stream([[b"1", None], [b"22", b""]])
    assert binary.copy_tuples(data) == (2, 2)
    for bad in (data[:-2], data[:25], b"x" * 30, data[:19] + b"\x00\x01\xff\xff\xff\xf0"):
        with pytest.raises((ValueError, Exception)):
            binary.copy_tuples(bad)
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(data[:-2])), ("c", None)], "path string, content binary")
    assert {r.path: r.tuples for r in binary.copied_tuples(df).collect()} == {"a": 2, "b": None, "c": None}


def test_other_binary_formats():
    head = binary.event_header(bytes.fromhex("01000000" "02" "03000000" "20000000" "40000000" "0000"))
    assert head == {"timestamp": 1, "type": 2, "server_id": 3, "length": 32, "next_position": 64, "flags": 0}
    assert binary.page_checksum(bytes(range(16)), True) != binary.page_checksum(bytes(range(16)), False)
    assert len(list(binary.bson_documents(b"\x05\0\0\0\0" * 3))) == 3
    with pytest.raises(ValueError):
        list(binary.bson_documents(b"\x05\0\0\0\0\x09"))
    for name in ("a b/c%", "café", "x"):
        assert binary.entry_text(binary.entry_name(name)) == name and "/" not in binary.entry_name(name)


# Chunks


def test_defined_chunks_realign():
    import random

    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    pieces = lambda b: [b[x:y] for x, y in zip([0, *chunks.cut_points(b, 256, 1024, 8192)], chunks.cut_points(b, 256, 1024, 8192), strict=False)]
    a, b = pieces(data), pieces(data[:1000] + b"!" + data[1000:])
    assert b"".join(a) == data and all(256 <= len(x) <= 8192 for x in a[:-1])
    assert len(set(b) - set(a)) <= 2
    one = bytearray(data)
    one[100_000] ^= 1
    assert len(set(pieces(bytes(one))) - set(a)) <= 2
    assert chunks.cut_points(b"", 1, 2, 4) == [] and chunks.cut_points(b"abc", 8, 16, 32) == [3]


def test_chunks_of_null_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "abcde")], "path string, body string")
    assert [tuple(r)[:4] for r in chunks.fixed_chunks(df, ["path"], "body", 2).orderBy("seq").collect()] == [("c", 0, 0, 2), ("c", 1, 2, 2), ("c", 2, 4, 1)]
    assert [tuple(r)[:4] for r in chunks.defined_chunks(df, ["path"], "body", 1, 2, 4).limit(1).collect()][0][0] == "c"


def test_ranges_may_nest(spark):
    df = spark.createDataFrame([("p", 0, 100), ("p", 10, 5), ("p", 105, 5), ("p", 300, 10), ("p", None, 1)], "pack string, o long, n long")
    assert [(r.start, r.end, r.blobs) for r in chunks.merged_ranges(df, ["pack"], "o", "n", gap=20).orderBy("start").collect()] == [(0, 110, 3), (300, 310, 1)]


def test_packs_in_order(spark):
    df = spark.createDataFrame([("e", i, s) for i, s in enumerate([6, 6, 3, 20, 1, None])], "g string, i int, n long")
    assert [r.pack for r in chunks.sequential_packs(df, ["g"], ["i"], "n", 10).orderBy("i").collect()] == [0, 0, 1, 1, 2, 2]


# Digests, text, pass-through


def test_table_changes_digest_value():
    lines = "tables|snap-a|1|0\npublic.orders|200|230|\npublic.old|5|0|gone\n"
    assert hashlib.sha256(lines.encode()).hexdigest() == "da46e103999a40ea5018e7310512c131b0c02984ac08e557fd769dff1bff3bf6"


def test_percent_escapes(spark):
    from tidemark.functions.digest import percent_escaped

    df = spark.createDataFrame([("a b",), ("100%",), ("café",), ("\x7f",), ("plain/x",), ("",)], "t string")
    assert [r[0] for r in df.select(percent_escaped(F.col("t"))).collect()] == ["a%20b", "100%25", "caf%C3%A9", "%7F", "plain/x", ""]


def test_rounding_and_egress(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (0.285,), (-1.5,)], "x double")
    assert [r[0] for r in df.select(text.round_cents(F.col("x"))).collect()] == [1.0, 2.68, 0.28, -1.5]


def test_providers_by_suffix_only(spark):
    df = spark.createDataFrame([("db.example.net",), ("example.net.evil.org",), ("EXAMPLE.NET",), ("notexample.net",), (None,)], "h string")
    assert [r[0] for r in df.select(text.provider(F.col("h"), {"example.net": "e"})).collect()] == ["e", None, "e", None, None]


def test_pass_through_reads_only(spark):
    with pytest.raises(ValueError):
        sqlpass.run(spark, "DROP TABLE x", {})
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert sqlpass.first_value(spark, "-- x\nSELECT max(a) FROM v", {"v": df}) == "1"
    with pytest.raises(ValueError):
        sqlpass.first_value(spark, "SELECT a FROM v WHERE a = 9", {"v": df})
    with pytest.raises(ValueError):
        sqlpass.matching(df, "a = 9")


def test_csv_of_nulls(spark, tmp_path):
    sqlpass.write_csv(spark.createDataFrame([(1, None), (2, "x")], "a int, b string").coalesce(1), str(tmp_path / "o"))
    assert "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv")) == "a,b\n1,\n2,x\n"


def test_json_shape(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": "y"}'), (3, "broken"), (4, None)], "i int, j string")
    got = {r.field: (r["count"], r.type, r.not_null) for r in profile.json_shape(df, "j", "i").collect()}
    assert got["b"] == (1, "STRING", False) and got["a"][:2] == (2, "mixed")


def test_upserts_and_empty_states(spark):
    t, s = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(2, "z"), (3, "n")], "k int, v string")
    assert sorted(map(tuple, delta.upsert(t, s, ["k"], False).collect())) == [(1, "a"), (2, None), (3, "n")]
    assert sorted(map(tuple, delta.upsert(t, s, ["k"], True).collect())) == [(1, "a"), (2, "z"), (3, "n")]
    assert delta.added(t.limit(0), s, ["k"]).count() == 2 and delta.deleted(t, s.limit(0), ["k"]).count() == 2
    with pytest.raises(ValueError):
        delta.upsert(t, s, [], True)
