"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Text bytes that one Python step handles at a time (an Arrow batch is cut into such pieces).
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores until no column of ``df`` is called so (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 byte strings; null gives an empty one."""
    return [b or b"" for b in col.cast(pa.large_binary()).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], text_col: str,
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        size = np.nan_to_num(np.asarray(pc.binary_length(b.column(text_col)).to_numpy(zero_copy_only=False),
                                        dtype=np.float64)).astype(np.int64)
        step = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield b.slice(i, j - i)


def shard_count(df: DataFrame, text_col: str, shard_bytes: int) -> int:
    """Number of shards so that an average one holds ``shard_bytes`` of text (one narrow pass)."""
    n = df.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0]
    return max(1, -(-int(n or 0) // shard_bytes))


#: Rows of one file that make up a shard.
SHARD_ROWS = 4096


def placed(df: DataFrame, *cols: Column, rows: int = SHARD_ROWS) -> DataFrame:
    """``cols`` with _shard (a run of ``rows`` rows of one file, wherever splits fall) and _row (its row in that file).

    The place in a Parquet file names a row for good, whatever the later scans' splits. Another
    frame than a plain scan is written to the shared folder first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        src = df.select(*cols, *place)
        src.schema  # noqa: B018 - resolves the file columns
    except AnalysisException:
        src = written(df.select(*cols), "rows").select("*", *place)
    return src.withColumn("_shard", F.xxhash64("_file", F.expr(f"_row div {rows}"))).drop("_file")


def by_shard(*parts: DataFrame) -> DataFrame:
    """The union of frames that begin with (_shard, _kind), one shard at a time and in order of kind within it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.repartition("_shard").sortWithinPartitions("_shard", "_kind")


def with_row_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a text column that names the row (its Parquet file and place in it)."""
    key = F.concat_ws(":", F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")).alias(name)
    try:
        out = df.select("*", key)
        out.schema  # noqa: B018 - resolves the file columns
        return out
    except AnalysisException:
        return written(df, "rows").select("*", key)
