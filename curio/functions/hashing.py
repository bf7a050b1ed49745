"""Reproducible, partition-independent random order for samplers.

A row's draw key is ``md5(seed || ':' || id)``; ties (never in practice) break on ``id``.
Unlike ``rand()`` it does not depend on partitioning or task retries, so a lost executor
recomputes the same sample, and plain SQL gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, id_col="id") -> Column:
    """``seed`` may be a text column: rows of many draws then keep the keys of their own draw."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", s, idc.cast("string")))


def draw_order(seed, id_col="id") -> list[Column]:
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    return [draw_key(seed, idc), idc]


def sql_draw_key(seed, id_expr="id") -> str:
    """The same key in SQL text (oracle side)."""
    return f"md5(concat_ws(':', '{seed}', CAST({id_expr} AS VARCHAR)))"
