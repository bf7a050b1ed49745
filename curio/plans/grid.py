"""Experiment grid: datasets x methods x balance x repeats (x classifier filter), one isolated run per config.

Each configuration gets its own ``run_id``, so runs share one set of logs without clobbering each other (no
state files to delete between runs), and all runs advance together (``lockstep``). Results of all runs are one table;
``summarize`` gives mean and sample std of the final metric per configuration.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import bind as B
from .lockstep import local, pool_fingerprints, run_lockstep

METHODS = ("lda", "kmeans", "fine")


def grid_configs(methods=METHODS, balance=(True, False), repeats: int = 3, filter_label=(False,),
                 datasets=("news",)) -> list[dict]:
    out = []
    for d, m, b, f, r in itertools.product(datasets, methods, balance, filter_label, range(1, repeats + 1)):
        out.append({"dataset": d, "method": m, "balance": b, "filter_label": f, "repeat": r,
                    "run_id": f"{d}_{m}_balance{b}_filter{f}_run{r}"})
    return out


def grid_root(spark: SparkSession, sf_dir: str, configs: list[dict], rounds: int, k: int,
              fingerprints: dict[str, tuple[str, int]] | None = None) -> str:
    """The grid's folder, named by the content of its pools and by its configurations."""
    found = fingerprints or pool_fingerprints(spark, sf_dir, configs)
    pools = [found[ds] for ds in sorted(found)]
    labels = [B.table(spark, sf_dir, t).agg(F.sum(F.xxhash64(*c).cast("decimal(38,0)"))).first()[0]
              for t, c in (("labels", ["doc_id", "toxic"]), ("part", ["p_partkey", "p_name"]))]
    key = json.dumps([pools, [str(x) for x in labels], configs, rounds, k], sort_keys=True)
    return f"{checkpoint_dir(spark)}/grid-{hashlib.md5(key.encode()).hexdigest()[:16]}"


def run_grid(spark: SparkSession, sf_dir: str, configs: list[dict], rounds: int = 10, k: int = 10,
             root: str | None = None, fingerprints: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """All configurations in lockstep: a round is one chain of plans for every run. Each repeat has its own
    seed, for the topic fit as for the draws; runs of one dataset, method and seed share the assignment.
    A grid of the same content and configurations that was cut short goes on, a finished one is read."""
    fingerprints = fingerprints or pool_fingerprints(spark, sf_dir, configs)
    root = root or grid_root(spark, sf_dir, configs, rounds, k, fingerprints)
    results = run_lockstep(spark, sf_dir, configs, root, rounds, k, fingerprints=fingerprints)
    cols = ("run_id", "dataset", "method", "balance", "filter_label", "repeat")
    names = local(spark, pa.table({x: pa.array([c[x] for c in configs], pa.int32() if x == "repeat" else None) for x in cols}))
    return results.join(names, "run_id")


def summarize(results: DataFrame, baseline: float = 0.5) -> DataFrame:
    keys = ["dataset", "method", "balance", "filter_label"]
    per_run = results.groupBy("run_id", *keys).agg(
        F.greatest(F.lit(baseline), F.coalesce(F.max(F.when(F.col("accepted"), F.col("metric"))), F.lit(baseline)))
        .alias("final_metric"))
    return per_run.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"),
                                      F.avg("final_metric").alias("mean_metric"),
                                      F.stddev_samp("final_metric").alias("std_metric"))
