"""Line de-duplication with overlapping three-line windows.

A window is three consecutive lines of one document (lines end at a newline; blank lines count). Each
window is hashed with its exact lines; hashes that occur more than once are found by one
aggregation that keeps the earliest place (document id, then line number). Every later window
covers its three lines; covered positions of a document are merged and removed.

Edge cases: a null text counts as empty (one empty line). A document of fewer than three lines has
no window and stays whole. Windows that repeat within one document or overlap themselves count like
any other, the first place stays and lines covered by a later one go. Rows sharing an id are kept
apart by their place in the input. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import text_or_empty, written

LINES = 3


@F.pandas_udf(StringType())
def without_lines(text: pd.Series, gone: pd.Series) -> pd.Series:
    """The texts without the lines at the positions in ``gone``."""
    out = []
    for t, g in zip(text, gone):
        if g is None:
            out.append(t)
            continue
        drop = set(g)
        out.append("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop))
    return pd.Series(out, dtype=object)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """(id, n_lines, n_removed, text): the text without the lines that later windows cover."""
    src = written(df.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_u"),
                            text_or_empty(text_col).alias("_t")), "op9-rows")
    split = src.select("_id", "_u", F.split("_t", "\n").alias("_l"))
    n = F.size("_l")
    parts = [F.slice("_l", i + 1, F.greatest(n - (lines - 1), F.lit(0))).alias(f"l{i}") for i in range(lines)]
    windows = (split.where(n >= lines).select("_id", "_u", F.posexplode(F.arrays_zip(*parts)).alias("_pos", "_w"))
               .select("_id", "_u", "_pos",
                       F.unhex(F.sha2(F.concat_ws("\n", *[F.col(f"_w.l{i}") for i in range(lines)]), 256)).alias("_h")))
    windows = written(windows, "op9-windows")
    place = F.struct("_id", "_u", "_pos")
    repeated = (windows.groupBy("_h").agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
                .where("_n > 1").select("_h", "_first"))
    later = windows.join(repeated, "_h").where((F.col("_u") != F.col("_first._u")) | (F.col("_pos") != F.col("_first._pos")))
    covered = (later.select("_u", F.explode(F.sequence(F.col("_pos"), F.col("_pos") + (lines - 1))).alias("_line"))
               .groupBy("_u").agg(F.collect_set("_line").alias("_gone")))
    whole = src.join(covered, "_u", "left")
    return whole.select(F.col("_id").alias(id_col), F.size(F.split("_t", "\n")).alias("n_lines"),
                        F.coalesce(F.size("_gone"), F.lit(0)).alias("n_removed"),
                        F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(without_lines("_t", "_gone")).alias(text_col))
