"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes in words are counted per (source, exact size). Targets share ``share`` times all words by weight and stop at
   ``most`` times a source's words; the excess goes to the others by weight.
2. Each source takes all its documents as often as the target holds them whole. The rest of the budget is fitted
   on the counts by size: a proportional part goes over the sizes from the largest, each taking whole documents and
   passing on what it could not spend; what then remains, ``reserve`` words and the last carry, is fitted by
   bounded-knapsack dynamic programming over the documents left (counts split into powers of two), to the sum
   nearest the budget.
3. Of the documents of one size, the needed number is taken in the order of a seeded hash of the id. Counts per
   piece of the hash tell which parts are taken whole; only the part at the edge is looked at closer, by more of the
   hash and then by place, so a source or a size with a third of all rows is never sorted in one task.

One task handles the sizes of one source (a row per distinct size) and one the table of sources (a row per source); both
are counts, not documents. The dynamic program's array is as long as the remaining budget, at most ``reserve`` words
plus the longest document, and half of that again.

Edge cases: a null text has size 0 and is taken for nothing; a null source is a source of its own, ordered last. Null
and repeated ids are rows of their own; which of several rows with one id is taken follows their place in the files.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, with_row_key, written

WORD = "[^\\x20\\x09-\\x0D]+"
RESERVE = 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words each source should give: ``share`` of all by weight, none above ``most`` times its own."""
    caps = [most * s for s in sizes]
    out: list[float | None] = [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        if not open_:
            break
        left = share * sum(sizes) - sum(t for t in out if t is not None)
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > caps[i]]
        for i in over or open_:
            out[i] = caps[i] if over else left * weights[i] / total
        if not over:
            break
    return [float(t) for t in out]


def fit_counts(sizes: Sequence[int], counts: Sequence[int], budget: int, reserve: int = RESERVE) -> list[int]:
    """How many documents of each size to take so that their words come as near ``budget`` as the method gets."""
    order = sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: -sizes[i])
    total = sum(sizes[i] * counts[i] for i in order)
    take = [0] * len(sizes)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return [c if s > 0 else 0 for s, c in zip(sizes, counts)]
    part, carry = max(0, budget - reserve), 0
    for i in order:  # carry counts in words times total
        carry += part * counts[i] * sizes[i]
        take[i] = min(counts[i], carry // (total * sizes[i]))
        carry -= take[i] * sizes[i] * total
    rest = budget - sum(take[i] * sizes[i] for i in order)
    for i, k in _knapsack([(i, sizes[i], counts[i] - take[i]) for i in order if counts[i] > take[i]], rest):
        take[i] += k
    return take


def _knapsack(items: list[tuple[int, int, int]], goal: int) -> Iterator[tuple[int, int]]:
    """(item, copies) of a choice from (item, size, copies at hand) whose sum is nearest ``goal`` (ties: below)."""
    if not items or goal <= 0:
        return
    # a nearest sum above the goal is over it by at most half of any size in it, and by no more than the goal itself (sum 0)
    top = goal + min(goal, max(s for _, s, _ in items) // 2)
    via = np.full(top + 1, -1, np.int32)  # the step that first reached a sum
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    steps: list[tuple[int, int, int]] = []
    for i, size, n in items:
        n, k = min(n, top // size), 1
        while n > 0 and not reach[goal]:
            k = min(k, n)
            w = k * size
            new = reach[:-w] & ~reach[w:]
            via[w:][new] = len(steps)
            reach[w:] |= new
            steps.append((i, k, w))
            n, k = n - k, k * 2
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        i, k, w = steps[via[at]]
        yield i, k
        at -= w


def _first_rows(rows: DataFrame, need: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """``rows`` with ``keep`` and ``extra``: 1 for the first ``need`` rows of each group ``by`` (in order of h, then place), else 0.

    Each step splits the groups by one more piece of the order. Counts tell which parts are taken whole or
    left; only the part at the edge goes on to the next step. A part's window holds 256 counts at most, but for the
    step by the whole hash, which meets one part in 2^24 of a group.
    """
    steps = [*(F.shiftrightunsigned("h", s) % 256 for s in (56, 48, 40)), F.col("h"),
             *(F.shiftrightunsigned(F.xxhash64("place"), s) % 256 for s in (56, 48)), F.col("place")]
    done = []
    for i, step in enumerate(steps):
        level = f"level{i}"
        rows = rows.withColumn(level, step)
        counts = rows.groupBy(*by, level).agg(F.count("*").alias("c")).join(need, by)
        upto = F.sum("c").over(Window.partitionBy(*by).orderBy(level))
        by = [*by, level]
        fate = (counts.withColumn("upto", upto)
                .select(*by, *keep, (F.col("need") - F.col("upto") + F.col("c")).alias("need"),
                        F.expr("CASE WHEN upto <= need THEN 1 WHEN upto - c >= need THEN 0 END").alias("extra")))
        split = written(rows.join(fate, by), "mix-split")
        done.append(split.where("extra IS NOT NULL").select("doc_id", "size", *keep, "extra"))
        rows = split.where("extra IS NULL").drop("extra", "need", *keep)
        need = fate.where("extra IS NULL").drop("extra")
        if rows.isEmpty():
            break
    return reduce(DataFrame.union, done)


def mix_sources(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source",
                weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0,
                reserve: int = RESERVE) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words taken of each document, in whole copies."""
    keyed = with_row_key(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("src"),
                                   text_or_empty(text_col).alias("text")), "place")
    rows = written(keyed.select("doc_id", F.coalesce(F.concat(F.lit("s"), "src"), F.lit("n")).alias("src"),
                                F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
                                F.xxhash64(F.lit(seed), "doc_id").alias("h"), "place"), "mix-sizes")
    lengths = written(rows.groupBy("src", "size").agg(F.count("*").alias("c")), "mix-lengths")
    weights, most = list(weights), int(most)

    def goals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(batches))
        t = t.assign(null=t["src"] == "n").sort_values(["null", "src"]).drop(columns="null")
        words = [int(s) for s in t["source_size"]]
        if words:
            yield t.assign(target=targets(words, [weights[i % len(weights)] for i in range(len(words))], share, most))

    # one row per source
    totals = lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("c")).cast("long").alias("source_size")).coalesce(1)
    goal = written(totals.mapInPandas(goals, "src string, source_size long, target double"), "mix-targets")

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        words, want = int(t["source_size"].iloc[0]), float(t["target"].iloc[0])
        whole = min(most, int(want // words)) if words else 0
        budget = round(want - whole * words) if whole < most else 0
        need = fit_counts([int(s) for s in t["size"]], [int(c) for c in t["c"]], budget, reserve)
        return t.assign(whole=whole, need=need)[["src", "size", "source_size", "target", "whole", "need"]]

    fitted = written(lengths.join(goal, "src").groupBy("src").applyInPandas(
        fit, "src string, size long, source_size long, target double, whole int, need long"), "mix-fit")

    out = _first_rows(rows, fitted, ["src", "size"], ["source_size", "target", "whole"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"))
