"""Aggregations: cluster sizes and imbalance, label counts and class-ratio flags, corpus stats,
weighted classification metrics, nested JSON exports.

All of them aggregate the big table once (partial aggregation before the shuffle); any window
afterwards runs over the small aggregated table (one row per cluster or per class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def cluster_sizes(df: DataFrame, keys: list[str] | None = None, cluster_col: str = "label_cluster") -> DataFrame:
    keys = keys or []
    return (df.groupBy(*keys, cluster_col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(*keys, F.col(cluster_col).cast("int")))


def cluster_count(df: DataFrame, keys: list[str] | None = None, cluster_col: str = "label_cluster") -> DataFrame:
    keys = keys or []
    return df.groupBy(*keys).agg(F.countDistinct(cluster_col).alias("n_clusters"),
                                 F.count(F.lit(1)).alias("n_docs"))


def cluster_report(df: DataFrame, keys: list[str] | None = None, cluster_col: str = "label_cluster") -> DataFrame:
    """Size, percent of the corpus and a bar of one '#' per full 2 percent, per cluster."""
    keys = keys or []
    sizes = df.groupBy(*keys, cluster_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    pct = F.col("n") * 100.0 / total
    return (sizes.withColumn("pct", pct)
            .withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("pct") / 2).cast("int")))
            .withColumn("pct", F.round("pct", 6)))


def cluster_imbalance(df: DataFrame, keys: list[str] | None = None, cluster_col: str = "label_cluster") -> DataFrame:
    """min, max, max/min, sample std and mean of the cluster sizes (ratio NULL for an empty cluster)."""
    keys = keys or []
    sizes = df.groupBy(*keys, cluster_col).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"),
        F.round(F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")), 6).alias("ratio"),
        F.round(F.stddev_samp("n"), 6).alias("std_size"),
        F.round(F.avg("n"), 6).alias("mean_size"))


def _by_key(arr):
    return F.array_sort(arr, lambda l, r: F.when(l["k"] < r["k"], -1).when(l["k"] > r["k"], 1).otherwise(0))


def sizes_json(sizes: DataFrame, outer: str, inner: str, cluster_col: str = "label_cluster",
               count_col: str = "n") -> DataFrame:
    """{outer: {inner: {cluster: count}}} as one JSON string (keys sorted)."""
    lvl1 = sizes.groupBy(outer, inner).agg(F.map_from_entries(_by_key(F.collect_list(
        F.struct(F.col(cluster_col).cast("string").alias("k"), F.col(count_col).alias("v"))))).alias("m"))
    lvl2 = lvl1.groupBy(outer).agg(F.map_from_entries(_by_key(F.collect_list(
        F.struct(F.col(inner).alias("k"), F.col("m").alias("v"))))).alias("m"))
    return lvl2.agg(F.to_json(F.map_from_entries(_by_key(F.collect_list(
        F.struct(F.col(outer).alias("k"), F.col("m").alias("v")))))).alias("json"))


def label_counts(df: DataFrame, keys: list[str] | None = None, label_col: str = "label") -> DataFrame:
    keys = keys or []
    return df.groupBy(*keys, label_col).agg(F.count(F.lit(1)).alias("n"))


def class_ratio_flags(df: DataFrame, keys: list[str], label_col: str = "label") -> DataFrame:
    """needs_balance: positives exist and negatives / positives > 2.
    still_unbalanced (weighted loss): no positives, or negatives >= 2 x positives."""
    g = df.groupBy(*keys).agg(
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("n_pos"),
        F.sum(F.when(F.col(label_col) == 0, 1).otherwise(0)).alias("n_neg"))
    return (g.withColumn("needs_balance", (F.col("n_pos") > 0) & (F.col("n_neg") > 2 * F.col("n_pos")))
            .withColumn("still_unbalanced", (F.col("n_pos") == 0) | (F.col("n_neg") >= 2 * F.col("n_pos"))))


def corpus_stats(df: DataFrame, keys: list[str], text_col: str = "text", label_col: str = "label") -> DataFrame:
    """rows, positives, % positive, negatives, mean and exact median words."""
    wc = F.col("n_words") if "n_words" in df.columns else word_count(text_col)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("n_pos"),
        F.round(F.sum(F.when(F.col(label_col) == 1, 1).otherwise(0)) * 100.0 / F.count(F.lit(1)), 6).alias("pct_pos"),
        F.sum(F.when(F.col(label_col) == 1, 0).otherwise(1)).alias("n_neg"),
        F.round(F.avg(wc), 6).alias("mean_words"),
        F.round(F.percentile(wc, F.lit(0.5)), 6).alias("median_words"))


def classification_metrics(pred: DataFrame, keys: list[str] | None = None, label_col: str = "label",
                           pred_col: str = "prediction", count_col: str | None = None) -> DataFrame:
    """accuracy and support-weighted precision / recall / F1 over the classes seen in labels or
    predictions; an empty denominator counts as 0. A row stands for ``count_col`` rows, if given. One pass builds the confusion counts, the rest
    runs on at most (#groups x #classes^2) rows."""
    keys = keys or []
    conf = pred.groupBy(*keys, F.col(label_col).cast("int").alias("y"),
                        F.col(pred_col).cast("int").alias("p")).agg((F.sum(count_col) if count_col else F.count(F.lit(1))).alias("c"))
    by_true = conf.groupBy(*keys, F.col("y").alias("cls")).agg(
        F.sum("c").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(*keys, F.col("p").alias("cls")).agg(F.sum("c").alias("predicted"))
    per = by_true.join(by_pred, keys + ["cls"], "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    per = per.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1c", F.when(F.col("prec") + F.col("rec") > 0,
                      2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(0.0))
    n = F.sum("support")
    return per.groupBy(*keys).agg(
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("prec") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("rec") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1c") * F.col("support")) / n).alias("f1"),
        n.alias("n"))
