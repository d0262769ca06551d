"""Queries of the problems of training data, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.ids import hex_id
from tidemark.llm import leakage, packing, tokens, truncation
from tidemark.session import table as t

DEFAULT_TARGET = 33_554_432


def _packs(spark, d):
    blobs, epochs = t(spark, d, "blobs"), t(spark, d, "epochs")
    target = epochs.filter("epoch_id IS NOT NULL").groupBy("epoch_id").agg(F.max(F.when(F.col("pack_target_bytes") > 0, F.col("pack_target_bytes"))).alias("target"))
    items = blobs.select("epoch_id", "type", hex_id(F.col("id")).alias("blob_id"), "length").filter("length > 0").join(target, "epoch_id", "left")
    return packing.pack_items(items, ["epoch_id", "type"], "blob_id", "length", F.coalesce("target", F.lit(DEFAULT_TARGET)))


def p2_packs(spark, d):
    """Pack number of every blob of an epoch, data and trees apart; blobs beyond the target in pieces."""
    return _packs(spark, d)


def p2_unused(spark, d):
    """Packs, packed bytes and unused bytes of each epoch and type."""
    packs = _packs(spark, d).groupBy("epoch_id", "type", "pack_no").agg(F.sum("length").alias("bytes"), F.max("capacity").alias("capacity"))
    return packs.groupBy("epoch_id", "type").agg(F.count(F.lit(1)).alias("packs"), F.sum("bytes").alias("bytes"), F.sum(F.col("capacity") - F.col("bytes")).alias("unused_bytes"))


def p6_ids(spark, d):
    return tokens.encode_texts(t(spark, d, "documents"), ["doc_id"], "text")


def p6_token_counts(spark, d):
    """Documents and tokens per source."""
    ids = tokens.encode_texts(t(spark, d, "documents"), ["source"], "text")
    return ids.groupBy(F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.size("ids").cast("long")).alias("tokens"))


def _leaks(spark, d, edits):
    return leakage.leaked_passages(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "item_id", edits=edits)


def p7_found(spark, d):
    return _leaks(spark, d, 0).select("doc_id", "item_id")


def p7_leaked_items(spark, d):
    """Items that leaked, with the documents that carry a passage word for word or with at most two edits."""
    exact = F.count(F.when(F.col("edits") == 0, 1)).alias("exact_documents")
    return _leaks(spark, d, 2).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), exact)


def p8_found(spark, d):
    return truncation.cut_texts(t(spark, d, "documents")).filter("cut").select(F.col("doc").alias("doc_id"))


def p8_by_source(spark, d):
    """Documents with text, cut ones and their share per source."""
    cut = F.count(F.when(F.col("cut"), 1))
    return truncation.cut_texts(t(spark, d, "documents")).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), cut.alias("cut_documents"), (cut / F.count(F.lit(1))).alias("share"))


QUERIES = {f.__name__: f for f in (p2_packs, p2_unused, p6_ids, p6_token_counts, p7_found, p7_leaked_items, p8_found, p8_by_source)}
ORACLES: dict[str, str] = {}
