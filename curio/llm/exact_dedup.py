"""Exact de-duplication through an extendible-hash index on shared files (DataFrame functions only).

1. Every row gets a 64-bit key of its text. Rows are pre-aggregated to one entry per key and
   distinct text, comparing whole texts: the grouping key holds the text itself, and copies
   collapse in the map tasks, so a text that a third of all rows share sends one row per task.
2. The directory starts at the smallest depth that could hold the keys and doubles while a bucket
   holds more than ``capacity`` keys. A bucket's local depth is the smallest one at which it fits,
   so sparse buckets are shared by several directory slots.
3. The index is written to the shared folder by the directory's buckets: owner tasks get ranges of the
   buckets' first keys, so no bucket is split. Different texts under one key are chained (``chain`` 0, 1, ...).
4. Each row finds its bucket through its slot of the directory and its entry within that bucket.

Edge cases: a null text counts as empty. Rows that share both id and text are copies too, exactly
one of them stays. A null id is smaller than any other. An empty table gives no rows. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Keys a bucket holds before it splits.
CAPACITY = 1024
#: Bits of the key that the directory may use.
MAX_DEPTH = 48


def prefix(key: str, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key."""
    return F.shiftrightunsigned(F.col(key), 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) for every used slot, and the global depth."""
    keys = written(entries.select("_h").distinct(), "op1-directory-keys")
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / capacity))) if n > capacity else 0
    while True:
        slots = keys.groupBy(prefix("_h", depth).alias("slot")).agg(F.count("*").alias("n"))
        most = slots.agg(F.max("n")).first()[0] or 0
        if most <= capacity or depth >= MAX_DEPTH:
            break
        depth += 1  # directory doubling
    slots = written(slots, "op1-slots")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    levels = levels.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {depth} - level)"))
    fits = (levels.groupBy("level", "bucket").agg(F.sum("n").alias("held"))
            .where((F.col("held") <= capacity) | (F.col("level") == depth)))
    best = (levels.join(fits, ["level", "bucket"]).groupBy("slot")
            .agg(F.min(F.struct("level", "bucket")).alias("b")))
    return best.select("slot", F.col("b.bucket").alias("bucket"), F.col("b.level").alias("local_depth")), depth


def build_index(keyed: DataFrame, texts: DataFrame, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """The written index (_h, _sha, chain, bucket, local_depth, _first, group_size, best), the written
    directory (slot, bucket, local_depth, _first) and its depth. ``_first`` is the bucket's first key and
    names it: buckets of different depths can bear the same number."""
    rows = (keyed.groupBy("_h", "_sha")
            .agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_u")).alias("best")))
    # whole texts are compared here: one group per key and different byte string
    distinct = texts.groupBy("_h", "_t").agg(F.count("*").alias("_n")).select("_h", F.unhex(F.sha2("_t", 256)).alias("_sha"))
    chained = distinct.withColumn("chain", F.row_number().over(Window.partitionBy("_h").orderBy("_sha")) - 1)
    slots, depth = directory(keyed, capacity)
    slots = written(slots.withColumn("_first", F.expr("shiftleft(bucket, 64 - local_depth)")), "op1-directory")
    index = (chained.join(rows, ["_h", "_sha"]).withColumn("slot", prefix("_h", depth))
             .join(slots, "slot").drop("slot"))
    return written(index.repartitionByRange("_first").sortWithinPartitions("_first", "_h", "chain"), "op1-index"), slots, depth


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, bucket, chain.

    Of equal texts the row with the largest id stays. ``key`` may be any function to a long:
    colliding keys are chained and never merged.
    """
    src = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    keyed = written(src.select("_id", F.monotonically_increasing_id().alias("_u"), key(F.col("_t")).alias("_h"),
                               F.unhex(F.sha2("_t", 256)).alias("_sha")), "op1-keys")
    index, slots, depth = build_index(keyed, src.select(key(F.col("_t")).alias("_h"), "_t"), capacity)
    routed = keyed.withColumn("slot", prefix("_h", depth)).join(slots.select("slot", "_first"), "slot")
    return (routed.join(index, ["_first", "_h", "_sha"])
            .select(F.col("_id").alias(id_col), F.col("best._id").alias("keep_id"), "group_size",
                    (F.col("_u") == F.col("best._u")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
                    "bucket", "local_depth", "chain"))
