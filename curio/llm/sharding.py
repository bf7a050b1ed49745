"""Reproducible shuffled sharding by a Feistel permutation (DataFrame functions only).

Rows get global row numbers in id order: a range partitioning sorts them, each partition numbers
its own rows, and the partitions' offsets come from one row per partition. A Feistel network over
Z_a x Z_b permutes the row numbers; a*b is the smallest product found that holds all n rows, and
the few positions at n or beyond are walked along their cycle until they fall below n. Row number r
goes to position p = perm(r): shard p mod S, slot p div S. Anyone can compute both from r, n and
the seed, shard counts differ by one at most, and slots are gapless.

Edge cases: a null text has no bytes and the checksum 0. Rows with equal ids are ordered by size,
checksum and place in the input, rows alike in all of them are interchangeable. A null id comes
first. An empty table gives no rows. Other columns of the input are kept out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

ROUNDS = 6
#: Candidate widths tried for the smallest domain.
WIDTHS = 1024
ROW_BITS = 33  # of monotonically_increasing_id: rows within a partition


def domain(n: int) -> tuple[int, int]:
    """(a, b) near the square root of n with a*b >= n as small as possible."""
    root = max(1, math.isqrt(max(1, n) - 1) + 1)
    return min(((a, -(-n // a)) for a in range(root, root + WIDTHS)), key=lambda x: (x[0] * x[1], x[0])) if n else (1, 1)


def round_value(v: Column, seed: int, i: int) -> Column:
    """32 bits of md5(seed:i:v): keyed, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), v.cast("string"))), 1, 8), 16, 10).cast("long")


def quotient(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    left, right = quotient(x, b), x % b
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + round_value(right, seed, i)) % a
        else:
            right = (right + round_value(left, seed, i)) % b
    return left * b + right


def permute(x: Column, n: int, seed: int) -> Column:
    """The position of row number ``x`` in a permutation of 0..n-1."""
    a, b = domain(n)
    first = feistel(x, a, b, seed)
    beyond = a * b - n  # so many positions lie beyond; a walk meets each of them once at most
    if not beyond:
        return first
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(beyond + 1)), first,
                       lambda p, _: F.when(p < n, p).otherwise(feistel(p, a, b, seed)))
    return F.when(first < n, first).otherwise(walk)


def row_numbers(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Adds the global row number (from 0) in the given order, without any one-task step over rows."""
    numbered = written(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie")
                       .sortWithinPartitions(*order, "_tie").drop("_tie")
                       .withColumn("_m", F.monotonically_increasing_id()), "op2-rows")
    part = F.shiftright("_m", ROW_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    offsets = sizes.select("_part", start.alias("_start"))  # one row per partition
    return (numbered.withColumn("_part", part).join(offsets, "_part")
            .withColumn(name, F.col("_start") + F.col("_m").bitwiseAND((1 << ROW_BITS) - 1))
            .drop("_m", "_part", "_start"))


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, seed: int = 2024,
               extra_bytes: int = 16, permutation: Callable[[Column, int, int], Column] = permute) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard, row) under the law ``rows``."""
    text = text_or_empty(text_col)
    src = df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + extra_bytes).cast("long").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = row_numbers(src, ["_id", "size", "text_crc32"])
    n = rows.count()
    placed = rows.withColumn("_p", permutation(F.col("row"), n, seed))
    return placed.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"),
                         (F.col("_p") % shards).cast("int").alias("shard"),
                         quotient(F.col("_p"), shards).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "row")
