"""Flagship plans: the minimum slice and the full active-learning run over the driver's tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as LB
from ..operators import prepare as P
from ..operators import topics as TP
from ..session import checkpoint_dir, scratch_path
from ..sources import bind as B
from ..sources import io
from .loop import LoopConfig, Store, run_loop


def minimum_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .q_sample import minimum_slice as q
    return q(spark, sf_dir)


def labeled_splits(spark: SparkSession, sf_dir: str):
    """Pool = labeled documents of the train split, validation = labeled documents of the test split."""
    lp = B.labeled_pool(spark, sf_dir).drop("label_cluster", "predicted_label")
    test = F.col("doc_id") % B.TEST_SPLIT_MOD == 0
    return lp.filter(~test), lp.filter(test).select("title", "text", "label")


# the words that the stand-in labeler looks for in items without a stored label
ASK_KEYWORDS = {"news": ["attion", "eriner"], "ads": [B.TARGET_TOPIC]}
# answers that the label rules of each dataset read as positive and negative
ANSWERS = {"news": ("relevant", "not relevant"), "ads": ("relevant animal", "not a relevant animal")}


def loop_tables(spark: SparkSession, sf_dir: str, dataset: str = "news"):
    """(pool, validation, stored labels) of one dataset kind.

    The validation set is the labelled part of the test split; the pool is every other row, with
    or without a stored label. The ads rows take their label from the topic word in the title and
    store it only where a description is present."""
    if dataset == "news":
        lab = B.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
        _, validation = labeled_splits(spark, sf_dir)
        held = lab.filter(F.col("doc_id") % B.TEST_SPLIT_MOD == 0).select("doc_id")
        pool = B.news_pool(spark, sf_dir).select("id", "doc_id", "title", "text").join(held, "doc_id", "left_anti")
        return pool.drop("doc_id"), validation, lab.select(F.col("doc_id").cast("string").alias("id"), "label")
    if dataset == "ads":
        ads = B.ads_pool(spark, sf_dir)
        test = F.col("id").cast("long") % B.TEST_SPLIT_MOD == 0
        label = F.col("title").contains(B.TARGET_TOPIC).cast("int").alias("label")
        return (ads.filter(~test), ads.filter(test).withColumn("label", label),
                ads.filter(F.col("description").isNotNull()).select("id", label))
    raise ValueError(f"unknown dataset {dataset!r}")


def pool_fingerprint(pool: DataFrame) -> tuple[str, int]:
    """(content hash, rows) of a pool's usable rows, independent of their order: the assignment
    cache and the run's pool table are keyed by it, so a grown or changed pool is never mistaken
    for an older one. One narrow aggregate over the raw columns."""
    d = P.drop_null_title(pool)
    r = d.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(20,0)")).alias("h")).first()
    return hashlib.md5(f"{r['n']}:{r['h']}".encode()).hexdigest()[:16], r["n"]


def clustered_pool(spark: SparkSession, pool: DataFrame, store_root: str, method: str, k: int,
                   seed: int = 1, dataset: str = "news", fingerprint: tuple[str, int] | None = None) -> DataFrame:
    """Preprocess, cluster once (cached parquet partitioned by cluster), attach the arm id.
    The cache is keyed by dataset, method, k, seed and pool content."""
    version, rows = fingerprint or pool_fingerprint(pool)
    pre = P.feature_text(P.preprocess_pool(pool), dataset)
    assign = io.cluster_cache(spark, store_root, dataset, method, k,
                              lambda: TP.cluster(pre.select("id", "topic_text"), method, k, "topic_text", seed=seed),
                              version=f"{version}-seed{seed}", rows=rows)
    return pre.join(assign.select("id", F.col("label_cluster").cast("int").alias("label_cluster")), "id")


def active_learning(spark: SparkSession, sf_dir: str, method: str = "lda", k: int = 10, rounds: int = 10,
                    strategy: str = "thompson", balance: bool = True, filter_label: bool = False,
                    sample_size: int = 200, run_id: str = "run0", store_root: str | None = None,
                    dataset: str = "news", seed: int = 1) -> DataFrame:
    """Cluster the whole pool, then run the loop; sampled rows take their stored label or are put to
    the keyword labeler. Returns per-round results.
    Pass the same ``store_root`` again to resume a run (or extend it to more rounds): its pool,
    validation and label tables are read, not written again. ``seed`` sets the topic fit and the
    draws, so repeats of a configuration differ in both."""
    root = store_root or scratch_path(spark, "al")
    # one fit per (pool content, method, k, seed): runs that share all of them share the fit
    cache_root = f"{checkpoint_dir(spark)}/cluster-cache"
    pool, validation, stored = loop_tables(spark, sf_dir, dataset)
    version, rows = pool_fingerprint(pool)

    def pool_rows() -> DataFrame:
        cp = clustered_pool(spark, pool, cache_root, method, k, seed, dataset, (version, rows))
        return cp.select("id", "title", "clean_title", "label_cluster")
    # written once per run: every round reads these small tables instead of re-deriving them
    # from the raw documents; the pool is partitioned by arm so an arm filter prunes folders
    key = f"{dataset}-{method}-{k}-{seed}-{version}"
    cp = io.write_once(spark, f"{root}/pool/{key}", pool_rows, ["label_cluster"], rows)
    validation = io.write_once(spark, f"{root}/validation/{key}",
                               lambda v=validation: P.preprocess_pool(v).select("title", "clean_title", "label"))
    stored = io.write_once(spark, f"{root}/labels/{key}", lambda t=stored: t.select("id", "label"))
    n_arms = cp.select("label_cluster").distinct().count()
    cfg = LoopConfig(run_id=run_id, strategy=strategy, sample_size=sample_size, rounds=rounds,
                     balance=balance, filter_label=filter_label, seed=41 + seed)
    ask = LB.keyword_labeler(ASK_KEYWORDS[dataset], *ANSWERS[dataset])

    def labeler(sample: DataFrame) -> DataFrame:
        return LB.label_or_ask(sample, stored, dataset, ask)

    return run_loop(spark, cp, validation, labeler, cfg, Store(root), n_arms)
