"""The general problems against brute force, with nulls, empty tables, ties, repeated rows, hot keys and clashing names."""

import random
from collections import defaultdict
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from tidemark.functions import ids, lsn
from tidemark.operators import copydiff, intervals, orphans, snapdiff

T0 = 1_700_000_000


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# p1


def test_compare_copies_matches_a_loop(spark):
    rng = random.Random(1)
    make = lambda: [(rng.choice(["a", "b", None, "c"]), rng.randint(0, 30), rng.choice([None, 1, 2]), rng.choice([None, "x", "y"]), rng.randint(0, 3)) for _ in range(300)]
    a, b = make(), make()
    names = "g string, k int, size int, tag string, at int"
    out = copydiff.compare_copies(spark.createDataFrame(a, names), spark.createDataFrame(b, names), ["g", "k"], ["size", "tag"], ["at"])

    def newest(side):
        key = lambda r: (r[4], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")
        best = {}
        for r in side:
            if r[:2] not in best or key(r) > key(best[r[:2]]):
                best[r[:2]] = r
        return best

    x, y = newest(a), newest(b)
    want = {}
    for k in x.keys() | y.keys():
        fields = [f for f, i in (("size", 2), ("tag", 3)) if k in x and k in y and x[k][i] != y[k][i]]
        if k not in x or k not in y or fields:
            want[k] = (k not in x, k not in y, fields)
    got = {(r.g, r.k): (r.missing_left, r.missing_right, [c.field for c in r.changes]) for r in out.collect()}
    assert got == want


def test_compare_copies_on_empty_sides_and_clashing_names(spark):
    names = "side int, l int, r string, ord int, k0 int"
    full, none = spark.createDataFrame([(1, 2, "x", 3, 4), (1, 2, "x", 3, 4)], names), spark.createDataFrame([], names)
    assert rows(copydiff.compare_copies(full, none, ["side", "l"], ["r"], ["ord"]), "side", "l", "missing_right") == [(1, 2, True)]
    assert rows(copydiff.compare_copies(none, none, ["side"], ["r"]), "side") == []
    assert rows(copydiff.compare_copies(full, full, ["side", "l"], ["r", "k0"]), "side") == []


def test_store_differences_by_hand(spark):
    ts = lambda n: f"2026-01-{n:02d} 00:00:00"
    e = "e1"
    o = [
        ("first", e, f"s/{e}/a", 1, ts(1), ts(10)), ("first", e, f"s/{e}/a", 2, ts(1), ts(11)), ("first", e, f"s/{e}/b%20c", 5, ts(1), ts(11)),
        ("first", e, f"s/{e}/young", 5, ts(20), ts(25)), ("first", e, f"s/{e}/nosize", None, ts(1), ts(11)), ("first", e, "elsewhere", 1, ts(1), ts(11)), ("first", e, None, 1, ts(1), ts(11)),
        ("copy", e, f"x%2F{e}%2Fa", 3, ts(2), ts(12)), ("copy", e, f"/x/{e}/only", 3, ts(2), ts(12)), ("copy", e, f"x/{e}/nosize", 9, ts(2), ts(12)), ("copy", e, f"x/{e}/a", 3, ts(2), ts(12)),
        ("first", "e2", "s/e2/z", 1, ts(20), ts(21)), ("other", e, f"x/{e}/q", 3, ts(2), ts(12)),
    ]
    objects = spark.createDataFrame(o, "store string, epoch_id string, key string, size long, modified string, listed_at string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("modified", "listed_at")})
    c = [("copy", e, False, ts(3)), ("copy", e, None, ts(9)), ("copy", e, True, ts(1)), ("copy", "e2", True, ts(1)), ("copy", "e3", True, ts(2)), (None, e, True, ts(2))]
    results = spark.createDataFrame(c, "name string, epoch_id string, behind boolean, finished_at string").withColumn("finished_at", F.col("finished_at").cast("timestamp_ntz"))
    got = rows(copydiff.store_differences(objects, results), "store", "epoch_id", "name", "diff")
    assert got == sorted([
        ("copy", "e1", "a", "size"), ("copy", "e1", "b c", "missing_in_copy"), ("copy", "e1", "only", "missing_in_first"), ("copy", "e1", "-", "behind"),
        ("copy", "e2", "z", "missing_in_copy"), ("copy", "e3", "-", "behind"),
    ], key=repr)
    assert rows(copydiff.store_differences(objects.limit(0), results), "store", "diff") == [("copy", "behind"), ("copy", "behind")]
    assert rows(copydiff.store_differences(objects, results.limit(0)), "store") == []


# p3


def brute_periods(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("segment", [3, 1000])
def test_periods_and_gaps_match_a_sweep(spark, segment):
    rng = random.Random(segment)
    data = []
    for g in ["a", None, "b", "hot"]:
        for _ in range(400 if g == "hot" else 12):
            s = rng.randint(-(1 << 63), (1 << 63) - 1) if g == "b" else rng.randint(0, 3000)
            data.append((g, s, min(s + rng.randint(-1, 9), (1 << 63) - 1)))
    data += [("a", None, 5), ("a", 5, None), ("hot", 0, 1)] + data[:20]
    df = spark.createDataFrame(data, "g string, s long, e long").repartition(7)
    periods = intervals.continuous_periods(df, ["g"], "s", "e", segment_rows=segment)
    by = defaultdict(set)
    for g, s, e in data:
        if s is not None and e is not None and e > s:
            by[g].add((s, e))
    want = {g: brute_periods(v) for g, v in by.items()}
    got = defaultdict(list)
    for g, s, e in rows(intervals.period_rows(periods, ["g"]), "g", "period_start", "period_end"):
        got[g].append((s, e))
    assert {g: sorted(v) for g, v in got.items()} == want
    gaps = sorted(((g, a[1], b[0]) for g, v in want.items() for a, b in zip(v, v[1:], strict=False)), key=repr)
    assert rows(intervals.gaps(periods, ["g"]), "g", "gap_start", "gap_end") == gaps


def test_an_entity_far_beyond_one_round_of_cuts(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STEPS", 4)
    rng = random.Random(8)
    data = [("hot", s, s + rng.randint(1, 5)) for s in (rng.randint(0, 4000) for _ in range(900))] + [(None, 3, 9)]
    df = spark.createDataFrame(data, "g string, s long, e long").repartition(5)
    periods = intervals.continuous_periods(df, ["g"], "s", "e", segment_rows=10)
    got = [r[1:] for r in rows(intervals.period_rows(periods, ["g"]), "g", "period_start", "period_end") if r[0] == "hot"]
    assert sorted(got) == brute_periods([d[1:] for d in data if d[0] == "hot"])
    sizes = [r[0] for r in periods.selectExpr("size(starts)").collect()]
    assert len(sizes) > 60 and max(sizes) <= 40


def test_the_tree_takes_few_lists_a_slot_at_any_number_of_tasks():
    for leaves in (1, 8, 16, 17, 256, 10_000, 100_000):
        below = leaves
        for slots in intervals.tree_slots(leaves):
            assert -(-below // slots) <= intervals.FAN_IN and slots * intervals.FAN_IN >= below
            below = slots
        assert below == 1


def test_ten_thousand_lists_in_one_slot():
    import numpy as np

    rng = random.Random(5)
    lists = [[(s := rng.randint(0, 10**6), s + rng.randint(1, 200))] for _ in range(10_000)]
    s, e = intervals._reduced([tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for x in lists])[0]
    assert list(zip(s.tolist(), e.tolist(), strict=True)) == brute_periods([y for x in lists for y in x])


def test_merge_lists_is_the_merge_of_its_lists():
    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))] for _ in range(2))
        as_lists = lambda x: tuple(np.array(c, np.int64) for c in (zip(*brute_periods(x), strict=True) if x else ((), ())))
        s, e = intervals.merge_lists(as_lists(a), as_lists(b))
        assert list(zip(s.tolist(), e.tolist(), strict=True)) == brute_periods(a + b)


def test_positions_of_the_whole_range(spark):
    texts = [("0/0",), (" FFFFFFFF/FFFFFFFF\n",), ("0000000a/0000000b",), ("1A/F00",), ("x/1",), ("",), (None,), ("123",), ("80000000/0",)]
    df = spark.createDataFrame(texts, "t string").select(lsn.biased(F.col("t")).alias("p"))
    shown = [r[0] for r in df.select(lsn.shown(F.col("p"))).collect()]
    assert shown == ["0/0", "FFFFFFFF/FFFFFFFF", "A/B", "1A/F00", None, None, None, None, "80000000/0"]
    assert [str(r[0]) for r in df.select(lsn.as_decimal(F.col("p"))).collect()][1] == str((1 << 64) - 1)


def test_base_gaps_by_hand(spark):
    b = [("s", 1, "0/10", "0/20"), ("s", 1, "0/20", "0/30"), ("s", 1, "0/31", "0/40"), ("s", 1, "0/12", "0/18"), ("s", 2, "0/50", "0/60"), ("s", 1, "0/90", "0/80"), ("s", 1, None, "0/80"), ("s", 1, "FFFFFFFF/0", "FFFFFFFF/FFFFFFFF")]
    df = spark.createDataFrame(b, "surface_id string, timeline long, start_lsn string, end_lsn string")
    assert rows(intervals.base_gaps(df), "*") == [("s", 1, "0/30", "0/31"), ("s", 1, "0/40", "FFFFFFFF/0")]
    assert rows(intervals.base_gaps(df.limit(0)), "*") == []


# p4


def brute_changes(entries, loose=("mode",)):
    """entries: (series, snap, at, key, fields dict, recorded)"""
    taken, best = {}, {}
    for series, snap, at, key, fields, rec in entries:
        if key is None or snap is None:
            continue
        taken.setdefault((series, snap), []).append((at, rec))
        order = (rec, [(fields[f] is not None, fields[f]) for f in fields])
        if (series, snap, key) not in best or order > best[series, snap, key][0]:
            best[series, snap, key] = (order, fields)
    by = defaultdict(list)
    for (series, snap), v in taken.items():
        ats = [a for a, _ in v if a is not None]
        by[series].append((max(ats) if ats else min(r for _, r in v), snap))
    out = []
    for series, snaps in by.items():
        snaps.sort()
        for (_, a), (_, b) in zip(snaps, snaps[1:], strict=False):
            x = {k: f for (s, n, k), (_, f) in best.items() if (s, n) == (series, a)}
            y = {k: f for (s, n, k), (_, f) in best.items() if (s, n) == (series, b)}
            for k in x.keys() | y.keys():
                if k not in x or k not in y:
                    out.append((b, k, "added" if k not in x else "removed", None))
                elif which := [f for f in x[k] if x[k][f] != y[k][f] and not (f in loose and (x[k][f] is None or y[k][f] is None))]:
                    out.append((b, k, "changed", tuple(which)))
    return sorted(out, key=repr)


def test_snapshot_changes_match_a_loop(spark):
    rng = random.Random(5)
    data = []
    for s in ["s1", "s2", None]:
        for n in range(6):
            at = None if rng.random() < 0.2 else 10 * n + 5
            for k in range(25):
                if rng.random() < 0.7:
                    for _ in range(rng.choice([1, 1, 2])):
                        data.append((s, f"{s}-{n}", at if rng.random() < 0.9 else None, rng.choice([f"p{k}", f"é{k}", f"p{k}"]), rng.choice("fd"), rng.choice([None, 1, 2]), 10 * n + rng.randint(0, 3)))
    data += data[:40] + [("s1", "s1-0", 5, None, "f", 1, 3), ("s1", None, 5, "x", "f", 1, 3)]
    names = "ser string, snap string, at int, key string, kind string, mode int, rec int"
    df = spark.createDataFrame(data, names).repartition(5)
    got = snapdiff.snapshot_changes(df, ["ser"], "snap", "at", F.col("key"), {"kind": F.col("kind"), "mode": F.col("mode")}, "rec", ["mode"])
    got = sorted(((r.snapshot, r.key, r.change, tuple(r.fields) if r.fields else None) for r in got.collect()), key=repr)
    assert got == brute_changes([(r[0], r[1], r[2], r[3], {"kind": r[4], "mode": r[5]}, r[6]) for r in data])


def test_entry_changes_by_hand(spark):
    e = [
        ("a", "s", "r", 1, "/x%20y", "f", "AB", 0o100644, None, 1), ("b", "s", "r", 2, "x y", "f", "ab", 0o644, None, 2), ("c", "s", "r", None, "x y", "f", "-", None, None, 3),
        ("a", "s", "r", 1, "gone+", "d", "", 0o755, None, 1), ("b", "s", "r", 2, "gone+", "d", None, 0o700, None, 2), ("c", "s", "r", 3, "new%zz", "l", None, None, "../t", 3),
    ]
    df = spark.createDataFrame(e, "snapshot_id string, surface_id string, root string, created_at int, path string, type string, value string, mode int, target string, recorded_at int").withColumn("ord", F.lit(9)).withColumn("next", F.lit("z"))
    got = sorted((r.snapshot_id, r.path, r.change, tuple(r.fields or ())) for r in snapdiff.entry_changes(df).collect())
    assert got == [("b", "gone+", "changed", ("mode",)), ("c", "gone+", "removed", ()), ("c", "new%zz", "added", ()), ("c", "x y", "changed", ("value",))]
    assert snapdiff.entry_changes(df.limit(0)).count() == 0


# p5


def brute_orphans(refs, parents, deleted):
    norm = lambda x: (x or "").strip(" \t\n\r ").lower() or None
    known = defaultdict(list)
    for i, at, gone in parents:
        if norm(i):
            known[norm(i)].append((at, gone))
    out = set()
    for row, i, at in refs:
        key = norm(i)
        if key is None:
            continue
        if key not in known:
            out.add((row, key, "missing"))
        elif deleted and all(g for _, g in known[key]):
            out.add((row, key, "deleted"))
        else:
            times = [a for a, _ in known[key] if a is not None]
            if at is not None and times and min(times) > at:
                out.add((row, key, "late"))
    return sorted(out)


@pytest.mark.parametrize("hot", [50_000, 5])
def test_orphans_match_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(orphans, "HOT_ROWS", hot)
    rng = random.Random(hot)
    spelt = lambda x: rng.choice([x, x.upper(), f" {x}\t", x])
    pool = [f"{n:04x}" for n in range(60)] + ["zz-1", "a" * 300, "00", "ab00"]
    parents = [(spelt(i), rng.choice([None, T0 + rng.randint(0, 50)]), rng.random() < 0.5) for i in pool if rng.random() < 0.8 for _ in range(rng.choice([1, 2]))] + [(None, T0, True), ("", T0, False)]
    refs = [(f"r{n}", spelt("0007") if n % 3 == 0 else rng.choice([spelt(rng.choice(pool)), None, "", "  "]), rng.choice([None, T0 + rng.randint(0, 50)])) for n in range(600)]
    refs += refs[:50]
    p = spark.createDataFrame(parents, "id string, at long, gone boolean").select("id", F.timestamp_seconds("at").alias("at"), F.when(F.col("gone"), F.lit("2026-01-01").cast("timestamp")).alias("deleted_at"))
    r = spark.createDataFrame(refs, "row string, ref string, seen long").select("row", "ref", F.timestamp_seconds("seen").alias("seen"), F.lit(1).alias("salt"), F.lit(2).alias("kind"))
    for deleted in (None, "deleted_at"):
        got = orphans.orphan_references(r, "ref", "seen", ["row"], p, "id", "at", deleted)
        assert rows(got, "row", "missing_id", "reason") == sorted(brute_orphans(refs, parents, deleted), key=repr)
    assert orphans.orphan_references(r, "ref", "seen", ["row"], p.limit(0), "id", "at").filter("reason = 'missing'").count() == len({(a, (b or "").strip()) for a, b, _ in refs if (b or "").strip()})
    assert orphans.orphan_references(r.limit(0), "ref", "seen", ["row"], p, "id", "at").count() == 0


def test_any_number_of_hot_keys_is_salted(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 1)
    refs = spark.range(40_000).selectExpr("concat('r', id) AS row", "format_string('%04x', id % 9) AS ref", "current_timestamp() AS seen")
    child = refs.select(orphans._range_key(F.col("ref")).alias("key"))
    assert len(orphans._hot_keys(child, 8)) == 9
    parents = spark.createDataFrame([("0003",)], "id string").withColumn("at", F.lit("2020-01-01").cast("timestamp"))
    assert orphans.orphan_references(refs, "ref", "seen", ["row"], parents, "id", "at").groupBy("reason").count().collect()[0][1] == 40_000 - len(range(3, 40_000, 9))


def test_keys_are_read_from_buffers():
    import numpy as np
    import pyarrow as pa

    values = [b"ab\x01", b"", b"\x00\x00c", b"long" * 9]
    column = pa.array([b"before", *values, b"after"], pa.binary()).slice(1, 4)
    assert orphans._fixed(column).tolist() == np.array(values, "S").tolist()
    assert len(orphans._fixed(pa.array([], pa.binary()))) == 0


def test_percent_decoding(spark):
    texts = ["a%20b", "100%", "%C3%A9%2f", "a+b", "%zz%41", "", "plain"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(ids.percent_decoded(F.col("t"))).collect()] == [unquote(x) for x in texts]


def test_packed_hex_keeps_its_order_and_comes_back(spark):
    texts = ["", "00", "ab00", "zz", "abc", "0f" * 40]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", ids.packed_hex(F.col("t")).alias("p"))
    assert all(r.t == r.back for r in df.select("t", ids.unpacked_hex(F.col("p")).alias("back")).collect())
