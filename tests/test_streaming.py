"""Streaming jobs over small folders of files, and the settings that jobs read."""

import pytest
from pyspark.sql import functions as F

from tidemark.session import checkpointed, spread
from tidemark.streaming import jobs


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_pushes_are_accepted_repeated_or_refused(spark, tmp_path):
    same, other = "a" * 64, "b" * 64
    rows = [[("s1", same, 1), ("s2", other, 2)], [("s1", same, 4), ("s2", same, 5), ("s3", None, 6), ("s4", same, 8), ("s4", other, 7)]]
    out = jobs.drained(jobs.pushes(stream_of(spark, tmp_path, rows, "name string, digest string, at int"), "name", "digest", "at"), "t")
    got = sorted((r.name, r.outcome) for r in out.collect())
    assert {(r.digest, r.outcome) for r in out.filter("name = 's4'").collect()} == {(other, "accepted"), (same, "refused")}
    assert len(got) == 7 and got[:2] == [("s1", "accepted"), ("s1", "repeated")] and ("s2", "refused") in got


def test_positions_and_gaps(spark, tmp_path):
    rows = [[("l", 0, 10), ("l", 10, 20), ("m", 0, 3)], [("l", 25, 30)]]
    out = jobs.drained(jobs.positions(stream_of(spark, tmp_path, rows, "log string, a long, b long"), "log", "a", "b"), "t", "update", ["log"])
    assert [tuple(r) for r in out.collect()] == [("l", 30, 1), ("m", 3, 0)]


def test_keys_that_later_batches_do_not_tell_of_are_kept(spark, tmp_path):
    rows = [[("a", 0, 1)], [("b", 5, 9)], [("c", 2, 4), ("a", 1, 7)]]
    out = jobs.drained(jobs.positions(stream_of(spark, tmp_path, rows, "log string, a long, b long"), "log", "a", "b"), "t", "update", ["log"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", 7, 0), ("b", 9, 0), ("c", 4, 0)]
    with pytest.raises(ValueError):
        jobs.drained(stream_of(spark, tmp_path, rows, "log string, a long, b long"), "t", "update")


def test_heartbeats_count_failures_since_the_last_success(spark, tmp_path):
    rows = [[("s", "2026-01-01 00:00:00", True), ("s", "2026-01-01 01:00:00", False), ("s", "2026-01-01 02:00:00", False)]]
    stream = stream_of(spark, tmp_path, rows, "surface string, at string, ok boolean").withColumn("at", F.col("at").cast("timestamp"))
    r = jobs.drained(jobs.heartbeats(stream, "surface", "at", "ok"), "t", "update", ["surface"]).first()
    assert (r.attempts, r.failures) == (3, 2) and r.last_attempt - r.last_success == 2 * 3600 * 10**6


def test_a_failing_copy_drops_only_itself(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    failures = []
    (tmp_path / "file").write_text("x")
    jobs.fan_out([str(tmp_path / "first"), str(tmp_path / "file"), str(tmp_path / "second")], failures)(df, 0)
    assert [f[0] for f in failures] == [str(tmp_path / "file")]
    assert spark.read.parquet(str(tmp_path / "second/batch=0")).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        jobs.fan_out([str(tmp_path / "file")], [])(df, 0)


def test_shipping_a_batch_twice_counts_once(spark, tmp_path):
    ship = jobs.shipping(str(tmp_path / "s"))
    df = spark.createDataFrame([(1,), (2,)], "a int")
    ship(df, 0), ship(df, 0), ship(df, 1)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4


def test_compaction_reads_back(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "many"))
    jobs.compacted(spark, str(tmp_path / "many"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1 and spark.read.parquet(str(tmp_path / "one")).count() == 100


def test_checkpoints_go_to_the_shared_folder(spark):
    df = checkpointed(spark.range(5))
    assert df.count() == 5 and spark.conf.get("spark.checkpoint.dir") in spark.sparkContext._jsc.sc().getCheckpointDir().get()


def test_only_small_inputs_are_dealt_out(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    large = spark.range(10**9)
    assert spread(large) is large
