"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Every (key, shard) pair has a pseudo-random score that depends on nothing else; a row goes to the shard with the
smallest weighted score. Adding a shard adds one score per key, so a row either stays or moves to the new shard.

Slots number the rows of a shard from 0 without gaps. Rows are dealt into `slot_buckets` buckets by key hash; the
counts of (shard, bucket), at most shards * slot_buckets of them, give each bucket its first slot, so that no task
orders a whole shard.

Edge cases: a null key hashes to a constant (all null keys share a shard); a null text has size 1 and crc 0; repeated
rows get neighbouring slots; an empty table gives an empty result; other columns are kept unless they clash with the
names added here, which win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight for u in (0, 1) drawn by the hash of (key, shard); the smallest wins."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0-based) of a key; shards of weight 0 get nothing."""
    scores = [F.struct(score(key, s, w).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights) if w > 0]
    return (scores[0] if len(scores) == 1 else F.least(*scores))["shard"]


def assign(rows: DataFrame, key: str, weights: list[float], grown: list[float] | None = None, tie: tuple[str, ...] = (), slot_buckets: int = 1024) -> DataFrame:
    """rows with shard, slot and, for grown weights, grown_shard. tie: columns that order rows of equal key."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(slot_buckets))
    placed = rows.withColumns({"shard": rendezvous(F.col(key), weights), "_bucket": bucket})
    if grown is not None:
        placed = placed.withColumn("grown_shard", rendezvous(F.col(key), grown))
    counts = rows.select(rendezvous(F.col(key), weights).alias("shard"), bucket.alias("_bucket")).groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(key, *tie)
    numbered = placed.withColumn("_row", F.row_number().over(inside))
    # at most len(weights) * slot_buckets rows of three numbers: safe to broadcast
    return numbered.join(F.broadcast(first), ["shard", "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_row") - 1).cast("long")).drop("_bucket", "_first", "_row")


def documents_to_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = assign(rows, "doc_id", [1.0] * shards, [1.0] * (shards + 1), ("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))
