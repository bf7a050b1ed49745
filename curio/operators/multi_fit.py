"""Text classifiers of many runs at once: one table of terms, one grouped fit, one join or one scan to score all.

Every run has its own small training set (the rows its rounds have drawn) and its own weights. Terms are
hashed tokens. Weights are stored in fixed point and terms are counted in integers, so a score is a sum of
integers: it does not depend on partitioning, on retries or on what other runs stand in the same table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import NEG_WEIGHT, NUM_FEATURES, POS_WEIGHT, REG_PARAM

#: Feature number of a run's intercept, and the fixed point of stored weights.
INTERCEPT = -1
POINT = 1 << 30
STEPS = 300
#: Partitions, for each core, that the runs are dealt out to for their fits.
FITS_PER_CORE = 3


def terms(text: str | Column, num_features: int = NUM_FEATURES) -> Column:
    """Hashed tokens of a text, repeats included (null: none)."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), r"\W+"), lambda x: x != "")
    return F.transform(words, lambda x: F.pmod(F.xxhash64(x), F.lit(num_features)).cast("int"))


def fit_rows(y: np.ndarray, rows: list[np.ndarray], weighted: bool, reg: float = REG_PARAM,
             steps: int = STEPS) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, feature numbers, weights per occurrence) of logistic regression on tf-idf.

    The loss is the weighted mean log loss plus reg / 2 of the squared weights of standardised features. With one
    class in ``y`` the intercept alone answers that class.
    """
    n, n1 = len(y), int(y.sum())
    if n1 in (0, n):
        return (1.0 if n1 else -1.0), np.zeros(0, np.int64), np.zeros(0)
    size = [len(r) for r in rows]
    row = np.repeat(np.arange(n), size)
    feats, col = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    k = len(feats)
    cell, tf = np.unique(row * max(k, 1) + col, return_counts=True)
    row, col = cell // max(k, 1), cell % max(k, 1)
    idf = np.log((n + 1) / (np.bincount(col, minlength=k) + 1))
    each = np.where(y > 0, POS_WEIGHT, NEG_WEIGHT) if weighted else np.ones(n)
    each = each / each.sum()
    x = tf * idf[col]
    mean = np.bincount(col, each[row] * x, minlength=k)
    spread = np.sqrt(np.maximum(np.bincount(col, each[row] * x * x, minlength=k) - mean ** 2, 0))
    scale = np.divide(1.0, spread, out=np.zeros(k), where=spread > 1e-9)
    x = x * scale[col]
    # diagonal steps: a bound of the curvature of each weight from the rows' total size
    width = 1 + np.bincount(row, np.abs(x), minlength=n)
    curve = 0.25 * np.bincount(col, (each * width)[row] * np.abs(x), minlength=k) + reg
    curve0 = 0.25 * float((each * width).sum())
    prior = float(np.log(each[y > 0].sum() / each[y == 0].sum()))
    w, b = np.zeros(k), prior
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        z = vb + np.bincount(row, x * vw[col], minlength=n)
        g = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        nw = vw - (np.bincount(col, g[row] * x, minlength=k) + reg * vw) / curve
        nb = vb - g.sum() / curve0
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return float(b), feats, w * scale * idf


def fit_runs(train: DataFrame, run_col: str = "run_id", id_col: str = "id", text_col: str = "title",
             label_col: str = "label", weighted_col: str = "weighted") -> DataFrame:
    """(run, feature, weight): the classifiers of all runs.

    A group is one run's training set: at most what its rounds have drawn (rounds x sample size), whatever the size of
    the pool. Rows are taken in the order of their id, so a run's weights depend on its rows alone.
    """
    kind = train.schema[run_col].dataType.simpleString()
    rows = train.select(run_col, F.col(id_col).alias("_id"), terms(text_col).alias("_terms"), F.col(label_col).cast("double").alias("_y"),
                        F.col(weighted_col).alias("_weighted"))
    # few rows and much work: a number of partitions that is not joined again for the rows' size
    rows = rows.repartition(FITS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism, run_col)

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["_id", "_y"], kind="stable")
        bias, feats, w = fit_rows(t["_y"].to_numpy(), list(t["_terms"]), bool(t["_weighted"].iloc[0]))
        return pd.DataFrame({run_col: t[run_col].iloc[0], "feature": np.r_[INTERCEPT, feats].astype(np.int64),
                             "weight": np.round(np.r_[bias, w] * POINT).astype(np.int64)})

    return rows.groupBy(run_col).applyInPandas(fit, f"{run_col} {kind}, feature long, weight long")


def term_counts(rows: DataFrame, keys: list[str], text_col: str = "title") -> DataFrame:
    """(keys, feature, tf): the terms of each row."""
    return (rows.select(*keys, F.explode(terms(text_col)).alias("feature"))
            .groupBy(*keys, F.col("feature").cast("long").alias("feature")).agg(F.count("*").alias("tf")))


def predict_runs(rows: DataFrame, counts: DataFrame, models: DataFrame, on: list[str], keys: list[str],
                 out_col: str = "predicted_label", run_col: str = "run_id") -> DataFrame:
    """``rows`` (run and ``keys``) with the class that their run's model gives them.

    ``counts`` holds terms by ``on`` + ``keys`` (``on``: what terms and models are matched by beside the feature). All
    runs are scored by one join on the feature; a frequent term is a key that Spark can split.
    """
    hit = (counts.join(models, [*on, "feature"]).groupBy(run_col, *[k for k in keys if k != run_col])
           .agg(F.sum(F.col("tf") * F.col("weight")).alias("_s")))
    bias = models.where(F.col("feature") == INTERCEPT).select(run_col, F.col("weight").alias("_b"))
    by = [run_col, *[k for k in keys if k != run_col]]
    scored = rows.join(bias, run_col).join(hit, by, "left")
    return scored.withColumn(out_col, (F.col("_b") + F.coalesce("_s", F.lit(0)) > 0).cast("int")).drop("_b", "_s")


def weights(t: pa.Table, run_col: str = "run_id") -> dict[str, tuple[int, np.ndarray, np.ndarray]]:
    """(intercept, feature numbers ascending, weights) of each run, on the driver: bounded by the terms of the training sets."""
    names, run = np.unique(t[run_col].to_numpy(), return_inverse=True)
    feature, weight = t["feature"].to_numpy(), t["weight"].to_numpy()
    order = np.lexsort((feature, run))
    feature, weight, ends = feature[order], weight[order], np.searchsorted(run[order], np.arange(len(names) + 1))
    # the intercept's number is below all others
    return {str(r): (int(weight[a]), feature[a + 1:b].astype(np.int32), weight[a + 1:b]) for r, a, b in zip(names, ends, ends[1:])}


def flat_terms(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(terms of all rows, n + 1 places of the rows in them)."""
    return lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)


def judge(model: tuple[int, np.ndarray, np.ndarray], terms: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The class (0 or 1) that a run's weights give the ``rows``: the sums of integers that ``predict_runs`` takes by a join."""
    bias, features, weight = model
    size = (ends[1:] - ends[:-1])[rows]
    last = np.cumsum(size)
    total = np.zeros(len(rows), np.int64)
    if len(features) and len(rows) and last[-1]:
        term = terms[np.repeat(ends[rows] - (last - size), size) + np.arange(last[-1])]
        at = np.minimum(np.searchsorted(features, term), len(features) - 1)
        run = np.r_[0, np.cumsum(np.where(features[at] == term, weight[at], 0))]
        total = run[last] - run[last - size]
    return (bias + total > 0).astype(np.int64)
