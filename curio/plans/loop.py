"""The active-learning loop: one small chain of Spark jobs per round, state in append-only logs.

Per round: choose an arm from the reward log (one row reaches the driver), exclude the run's seen
ids, sample (optionally scoring the arm with the current classifier), label, mix in carried
positives, balance, train, evaluate on the validation table (one metric row reaches the driver),
then append the ledger, labeled rows, result and reward. Every input of a round is re-read from
parquet, so lineage never grows across rounds and a restarted driver resumes from the logs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bandit as BD
from ..operators import classify as C
from ..operators import sample as SM
from ..operators.stats import class_ratio_flags
from ..schemas import LABELED, LEDGER, RESULTS, REWARDS
from ..session import checkpoint_dir
from ..sources import io

Labeler = Callable[[DataFrame], DataFrame]   # sample rows -> same rows + ``label``


@dataclass
class LoopConfig:
    run_id: str = "run0"
    strategy: str = "thompson"          # "thompson" | "random"
    sample_size: int = 200
    rounds: int = 10
    balance: bool = False
    filter_label: bool = False
    baseline: float = 0.5
    metric: str = "f1"
    seed: int = 42
    feature_col: str = "title"
    decay: float = BD.DECAY
    extra: dict = field(default_factory=dict)


class Store:
    """Paths of a run's logs under one shared root (the checkpoint folder or a table location)."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # rows that identify one logical record of each log (re-appends after a restart are dropped)
    KEYS = {"ledger": ["run_id", "step", "id"], "labeled": ["run_id", "step", "id"],
            "results": ["run_id", "step"], "rewards": ["run_id", "step"]}

    def log(self, spark: SparkSession, name: str, schema, run_id: str, before: int | None = None) -> DataFrame:
        """A run's log, optionally only steps < ``before``, one row per logical record."""
        d = io.read_log(spark, self.path(name), schema).filter(F.col("run_id") == run_id)
        if before is not None:
            d = d.filter(F.col("step") < before)
        return d.dropDuplicates(self.KEYS.get(name, d.columns))


def posterior_for_run(spark: SparkSession, rewards: DataFrame, run_id: str, n_arms: int,
                      decay: float) -> DataFrame:
    """Beta parameters of every arm of one run (priors when nothing is logged yet)."""
    arms = spark.range(n_arms).select(F.lit(run_id).alias("run_id"), F.col("id").cast("int").alias("arm"))
    st = BD.bandit_state(rewards, decay)
    return (arms.join(st, ["run_id", "arm"], "left")
            .select("run_id", "arm",
                    (F.coalesce("wins", F.lit(0.0)) + BD.PRIOR_ALPHA).alias("alpha"),
                    (F.coalesce("losses", F.lit(0.0)) + BD.PRIOR_BETA).alias("beta")))


def thompson_sample(pool: DataFrame, ledger: DataFrame, arm: int, cfg: LoopConfig, step: int,
                    model: PipelineModel | None) -> DataFrame:
    """One Thompson round's draw (lazy). It is empty for a dead arm: no unseen rows, or no
    predicted positive once the classifier filter is on. The caller checkpoints the draw and
    tests that, so the arm's rows are scanned once per round."""
    fresh = SM.exclude_seen(pool, ledger).filter(F.col("label_cluster") == arm)
    seed = f"{cfg.seed}:{cfg.run_id}:{step}"
    if cfg.filter_label and model is not None:
        scored = C.predict(model, fresh, cfg.feature_col)
        return SM.arm_posneg_sample(scored, arm, cfg.sample_size, seed).drop("score")
    return SM.sample_from_arm(fresh, arm, cfg.sample_size, seed)


def random_sample(pool: DataFrame, ledger: DataFrame, n_arms: int, cfg: LoopConfig, step: int,
                  model: PipelineModel | None) -> DataFrame:
    """One random round: ``int(sample_size / n_arms)`` rows per cluster (half predicted positive
    once the classifier filter is on)."""
    fresh = SM.exclude_seen(pool, ledger)
    per = int(cfg.sample_size / n_arms)
    seed = f"{cfg.seed}:{cfg.run_id}:{step}"
    if cfg.filter_label and model is not None:
        return SM.stratified_posneg_sample(C.predict(model, fresh, cfg.feature_col), per, seed).drop("score")
    return SM.stratified_sample(fresh, per, seed)


def run_loop(spark: SparkSession, pool: DataFrame, validation: DataFrame, labeler: Labeler,
             cfg: LoopConfig, store: Store, n_arms: int) -> DataFrame:
    """Run rounds up to ``cfg.rounds``; returns the run's results table (read back from the log).

    Resumable: rounds already complete in the logs are skipped, the baseline and the latest
    accepted model are restored. Every round reads only earlier steps of the logs and seeds its
    arm choice and draw by (run, step), so a round interrupted half-way re-runs identically and
    its duplicate appends are dropped on read.
    """
    checkpoint_dir(spark)
    done, baseline, model = resume_point(spark, store, cfg)
    filter_on = cfg.filter_label and model is not None
    for i in range(done, cfg.rounds):
        step = i + 1
        ledger = store.log(spark, "ledger", LEDGER, cfg.run_id, before=step).select("id")
        if cfg.strategy == "thompson":
            rewards = store.log(spark, "rewards", REWARDS, cfg.run_id, before=step)
            post = posterior_for_run(spark, rewards, cfg.run_id, n_arms, cfg.decay)
            arm = BD.choose_arm(post, F.lit(step), cfg.seed).first()["chosen_arm"]
            sample = thompson_sample(pool, ledger, arm, cfg, step, model if filter_on else None)
        elif cfg.strategy == "random":
            arm = -1
            sample = random_sample(pool, ledger, n_arms, cfg, step, model if filter_on else None)
        else:
            raise ValueError(f"unknown strategy {cfg.strategy!r}")

        key = [F.lit(cfg.run_id).alias("run_id"), F.lit(step).alias("step")]
        # reliable checkpoint (spark.checkpoint.dir): the draw runs once and both the ledger
        # and the labeled log read the same rows, also after an executor loss
        sample = sample.checkpoint(eager=True)
        if cfg.strategy == "thompson" and sample.isEmpty():   # dead arm: penalise, next round
            _append_row(spark, store, "rewards", REWARDS, (cfg.run_id, step, arm, float(BD.DEAD_REWARD)))
            _append_row(spark, store, "results", RESULTS, (cfg.run_id, step, arm, None, None, None, None, None, 0))
            continue

        # the log's column ``title`` holds the text the model reads, whatever column it comes from
        labeled = labeler(sample).select(*key, F.lit(arm).alias("arm"), "id", F.col(cfg.feature_col).alias("title"), "label")
        io.append(labeled.select(*[c.name for c in LABELED.fields]), store.path("labeled"), ["run_id"])
        io.append(sample.select(*key, "id"), store.path("ledger"), ["run_id"])

        # training rows: this round's labels + positives carried from rejected rounds
        logged = store.log(spark, "labeled", LABELED, cfg.run_id, before=step + 1)
        results = store.log(spark, "results", RESULTS, cfg.run_id, before=step)
        acc = BD.reward_accept(results, cfg.baseline).select("run_id", "step", "accepted")
        buffer = BD.positive_buffer(logged.filter(F.col("step") < step), acc)
        train = (logged.filter(F.col("step") == step)
                 .unionByName(buffer.select(*[c.name for c in LABELED.fields]))
                 .dropDuplicates(["id"]))
        if cfg.balance:
            train = SM.balance_two_to_one(train, f"{cfg.seed}:{cfg.run_id}:{step}:b", ["run_id"])
        # settled once, in as many partitions as its rows need (at most rounds x sample size rows): every pass of the
        # fit sends a weight vector per partition, and a cache would keep all of the shuffle's partitions
        train = train.checkpoint(eager=True)
        io.append(train.select("run_id", F.lit(step).alias("step"), "id", "title", "label"), store.path("training"), ["run_id"])
        # one job gives both the class counts and the row count (labels are 0/1)
        flags = class_ratio_flags(train, ["run_id"]).first()
        weighted = bool(flags["still_unbalanced"]) if flags else True
        n_train = int(flags["n_pos"] + flags["n_neg"]) if flags else 0
        if n_train == 0:
            metrics = {"accuracy": None, "precision": None, "recall": None, "f1": None}
            cand = None
        else:
            cand = C.train_classifier(train, "title", weighted)
            metrics = C.evaluate(cand, validation, cfg.feature_col).first().asDict()
        metric = metrics.get(cfg.metric)
        reward = BD.DEAD_REWARD if metric is None else metric - baseline
        if metric is not None and reward > 0:
            baseline, model = metric, cand
            if cfg.filter_label:
                filter_on = True
            cand.write().overwrite().save(store.path(f"models/{cfg.run_id}/step={step}"))
        _append_row(spark, store, "results", RESULTS,
                    (cfg.run_id, step, arm, metric, metrics["accuracy"], metrics["precision"],
                     metrics["recall"], metrics["f1"], int(n_train)))
        if cfg.strategy == "thompson":
            _append_row(spark, store, "rewards", REWARDS, (cfg.run_id, step, arm, float(reward)))
    res = store.log(spark, "results", RESULTS, cfg.run_id)
    return BD.reward_accept(res, cfg.baseline).select(
        "run_id", "step", "arm", "metric", "baseline", "reward", "accepted", "n_train")


def resume_point(spark: SparkSession, store: Store, cfg: LoopConfig):
    """(last complete step, baseline in force, latest accepted model) from the run's logs."""
    res = store.log(spark, "results", RESULTS, cfg.run_id)
    done = res.agg(F.max("step")).first()[0] or 0
    if cfg.strategy == "thompson":
        done = min(done, store.log(spark, "rewards", REWARDS, cfg.run_id).agg(F.max("step")).first()[0] or 0)
    if done == 0:
        return 0, cfg.baseline, None
    acc = BD.reward_accept(res.filter(F.col("step") <= done), cfg.baseline).filter("accepted")
    last = acc.agg(F.max("step").alias("step"), F.max("metric").alias("metric")).first()
    if last is None or last["step"] is None:
        return done, cfg.baseline, None
    model = PipelineModel.load(store.path(f"models/{cfg.run_id}/step={last['step']}"))
    return done, max(cfg.baseline, float(last["metric"])), model


def _append_row(spark: SparkSession, store: Store, name: str, schema, row: tuple) -> None:
    io.append(spark.createDataFrame([row], schema).coalesce(1), store.path(name), ["run_id"])


def final_report(spark: SparkSession, store: Store, run_id: str, n_arms: int, decay: float = BD.DECAY) -> DataFrame:
    """Best expected arm of a run (``None`` for the random strategy: no rewards are logged)."""
    rewards = store.log(spark, "rewards", REWARDS, run_id)
    return BD.best_arm(BD.bandit_state(rewards, decay))
