"""Samplers: exclude seen rows, per-arm top-n, stratified per-cluster limits, class balance.

Every draw orders by the hash key of ``functions.hashing`` (reproducible, partition-independent).
Per-group limits are written as ``row_number() <= literal`` so Spark plans a partial
``WindowGroupLimit`` before the shuffle: a cluster that holds a third of the pool sends only
``quota`` rows per map task, never the whole group. Cut-offs that depend on data use either a
window over the already-limited rows or the salted exact rank (``salted_rank``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import draw_key


def exclude_seen(pool: DataFrame, ledger: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of ``pool`` whose id is not in ``ledger`` (left anti join).

    Write this before any model inference: an anti join is not pushed below a Python UDF.
    Spark broadcasts the ledger only when its size statistics allow it (it holds at most
    rounds x sample-size ids per run); otherwise it shuffles both sides on the id.
    """
    return pool.join(ledger.select(id_col), id_col, "left_anti")


def sample_from_arm(df: DataFrame, arm: int, n: int, seed, cluster_col: str = "label_cluster",
                    id_col: str = "id") -> DataFrame:
    """``min(n, available)`` rows of one arm: filter pushed to the scan, then a top-n
    (``TakeOrderedAndProject``): each task keeps n rows, one merge of n x tasks rows."""
    return (df.filter(F.col(cluster_col) == F.lit(arm))
            .withColumn("_k", draw_key(seed, id_col))
            .orderBy("_k", id_col).limit(n).drop("_k"))


def _rank(df: DataFrame, partition: list[str], seed, id_col: str) -> DataFrame:
    """Rank for a per-group limit by a literal: Spark cuts each group to the limit map-side
    (partial WindowGroupLimit), so a hot group never travels whole."""
    w = Window.partitionBy(*partition).orderBy(draw_key(seed, id_col), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w))


SALT_HEX = 4   # leading hex digits of the draw key used as an order-preserving salt (65,536 buckets)


def salted_rank(df: DataFrame, partition: list[str], seed, id_col: str, out: str = "_rn",
                extra=None) -> DataFrame:
    """Exact ``row_number() over (partition by ... order by draw key, id)`` without sending a
    whole group to one task, for ranks whose cut-off depends on data.

    The draw key is a uniform hex hash, so its leading digits split every group into ordered
    buckets of even size. Rows are ranked inside (group, bucket), and each bucket adds the row
    count of the buckets before it (a running sum over the per-bucket counts: at most 65,536 rows
    per group). Deterministic: no sampled range bounds, no partition ids. ``extra`` maps the
    per-bucket count table to more columns (windows over it) that are joined to every row.
    """
    d = df.withColumn("_k", draw_key(seed, id_col)).withColumn(
        "_b", F.conv(F.substring("_k", 1, SALT_HEX), 16, 10).cast("int"))
    local = d.withColumn("_lr", F.row_number().over(
        Window.partitionBy(*partition, "_b").orderBy("_k", F.col(id_col))))
    counts = d.groupBy(*partition, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*partition).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    more = extra(counts) if extra else []
    offsets = counts.select(*[F.col(c).alias(f"_o_{c}") for c in partition], F.col("_b").alias("_o_b"),
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"), *more)
    cond = [local[c].eqNullSafe(offsets[f"_o_{c}"]) for c in partition] + [local["_b"] == offsets["_o_b"]]
    j = local.join(offsets, cond, "inner")
    return (j.withColumn(out, (F.col("_lr") + F.col("_off")).cast("int"))
            .drop("_k", "_b", "_lr", "_off", "_o_b", *[f"_o_{c}" for c in partition]))


def stratified_sample(df: DataFrame, per_cluster: int, seed, cluster_col: str = "label_cluster",
                      id_col: str = "id") -> DataFrame:
    """Up to ``per_cluster`` rows from every cluster."""
    return _rank(df, [cluster_col], seed, id_col).filter(F.col("_rn") <= per_cluster).drop("_rn")


def _posneg(df: DataFrame, quota: int, seed, group: list[str], pred_col: str, id_col: str,
            require_positive: bool = False) -> DataFrame:
    """Per group: ``int(quota/2)`` predicted positives, negatives fill up to ``quota``.

    One lineage: rank per (group, class) with a literal limit (partial WindowGroupLimit before the
    shuffle), then count the positives taken with a window over the already-limited rows (at most
    2 x quota per group). ``require_positive`` drops groups without any predicted positive."""
    if not group:
        raise ValueError("a per-group limit needs a group key")
    n_pos = int(quota / 2)
    d = df.filter(F.col(pred_col).isin(0, 1))
    ranked = _rank(d, group + [pred_col], seed, id_col).filter(F.col("_rn") <= F.lit(quota))
    pos_in_group = F.sum(F.when(F.col(pred_col) == 1, 1).otherwise(0)).over(Window.partitionBy(*group))
    j = ranked.withColumn("_pos_in", pos_in_group).withColumn("_pos_taken", F.least("_pos_in", F.lit(n_pos)))
    cap = F.when(F.col(pred_col) == 1, F.lit(n_pos)).otherwise(F.lit(quota) - F.col("_pos_taken"))
    keep = F.col("_rn") <= cap
    if require_positive:
        keep = keep & (F.col("_pos_in") > 0)
    return j.filter(keep).drop("_rn", "_pos_in", "_pos_taken")


def stratified_posneg_sample(df: DataFrame, per_cluster: int, seed, cluster_col: str = "label_cluster",
                             pred_col: str = "predicted_label", id_col: str = "id") -> DataFrame:
    """Random strategy with the classifier filter: half positives per cluster, negatives fill."""
    return _posneg(df, per_cluster, seed, [cluster_col], pred_col, id_col)


def arm_posneg_sample(df: DataFrame, arm: int, n: int, seed, cluster_col: str = "label_cluster",
                      pred_col: str = "predicted_label", id_col: str = "id") -> DataFrame:
    """Thompson strategy with the classifier filter, one arm. Empty when the arm has no
    predicted positive (the caller treats that as a dead arm)."""
    one = df.filter(F.col(cluster_col) == F.lit(arm))
    return _posneg(one, n, seed, [cluster_col], pred_col, id_col, require_positive=True)


def positive_stratified_sample(df: DataFrame, sample_size: int, n_arms: int, seed,
                               cluster_col: str = "label_cluster", pred_col: str = "predicted_label",
                               id_col: str = "id") -> DataFrame:
    """Predicted positives only, ``int(sample_size / n_arms)`` per cluster (all if fewer).
    The quota divides by the total arm count, not by the clusters left after the filter."""
    per = int(sample_size / n_arms)
    return stratified_sample(df.filter(F.col(pred_col) == 1), per, seed, cluster_col, id_col)


def balance_two_to_one(df: DataFrame, seed, group: list[str], label_col: str = "label",
                       id_col: str = "id") -> DataFrame:
    """Within each group, when negatives / positives > 2 keep every positive and 2 x positives
    negatives; otherwise leave the group untouched. The class totals per group come from the
    salted rank's per-bucket counts, so the input is read twice (count pass, rank pass)."""
    g = Window.partitionBy(*group)

    def totals(counts):
        return [F.sum(F.when(F.col(label_col) == 1, F.col("_c")).otherwise(0)).over(g).alias("_np"),
                F.sum(F.when(F.col(label_col) == 0, F.col("_c")).otherwise(0)).over(g).alias("_nn")]
    ranked = salted_rank(df, group + [label_col], seed, id_col, extra=totals)
    needs = (F.col("_np") > 0) & (F.col("_nn") > 2 * F.col("_np"))
    keep = (~needs) | (F.col(label_col) == 1) | (F.col("_rn") <= 2 * F.col("_np"))
    return ranked.filter(keep).drop("_rn", "_np", "_nn")


def shuffle_rank(df: DataFrame, seed, group: list[str], id_col: str = "id") -> DataFrame:
    """Position of each row in a reproducible shuffle of its group (``sample(frac=1)``)."""
    return salted_rank(df, group, seed, id_col, out="shuffle_pos")
