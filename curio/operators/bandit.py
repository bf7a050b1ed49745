"""Thompson-sampling bandit and active-learning loop state, derived from append-only logs.

The original keeps two float arrays and mutates them per round. Here the only state is the
log ``(run_id, step, arm, reward)``; wins and losses are closed-form aggregates:
after ``T`` updates, an update at step ``t`` weighs ``decay ** (T - t + 1)``. Baseline,
accept flags and the positive carry-over buffer are window expressions over the results log.
Steps of a run are 1..T with one log row per round (dead rounds included), as the loop writes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sample import balance_two_to_one

# --- fixed values (bandit defaults) ---------------------------------------------------------
PRIOR_ALPHA = 0.5
PRIOR_BETA = 0.5
DECAY = 0.99
DEAD_REWARD = -1.0
CARRY_BLOCKS = 8      # of a history, see bandit_history
# ---------------------------------------------------------------------------------------------


def reward_accept(results: DataFrame, baseline: float) -> DataFrame:
    """Per round: baseline in force, reward = metric - baseline, accepted = reward > 0,
    and whether the classifier filter is on (any accept before this step).

    The baseline only moves up (an accept raises it to the new metric, a reject keeps it),
    so the baseline before step t is ``max(initial, max metric of steps < t)``. A dead round
    (NULL metric) has reward -1 and is never accepted.
    """
    w_prior = Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    prior_best = F.max("metric").over(w_prior)
    base = F.greatest(F.lit(float(baseline)), F.coalesce(prior_best, F.lit(float(baseline))))
    out = (results.withColumn("baseline", base)
           .withColumn("reward", F.when(F.col("metric").isNull(), F.lit(DEAD_REWARD))
                       .otherwise(F.col("metric") - F.col("baseline")))
           .withColumn("accepted", F.col("metric").isNotNull() & (F.col("reward") > 0)))
    any_before = F.max(F.col("accepted").cast("int")).over(w_prior)
    return out.withColumn("filter_active", F.coalesce(any_before, F.lit(0)) == 1)


def _with_horizon(log: DataFrame) -> DataFrame:
    """Attach T = last step of the run. Partial aggregation first, so a huge run is cheap to
    aggregate; the join back is a shuffle join that AQE splits when one run is skewed."""
    horizon = log.groupBy("run_id").agg(F.max("step").alias("_T"))
    return log.join(horizon, "run_id")


def bandit_state(rewards: DataFrame, decay: float = DECAY) -> DataFrame:
    """Decayed (wins, losses) per (run_id, arm) after the last logged step."""
    j = _with_horizon(rewards)
    w = F.pow(F.lit(decay), (F.col("_T") - F.col("step") + 1).cast("double"))
    return j.groupBy("run_id", "arm").agg(
        F.sum(F.when(F.col("reward") > 0, w).otherwise(F.lit(0.0))).alias("wins"),
        F.sum(F.when(F.col("reward") > 0, F.lit(0.0)).otherwise(w)).alias("losses"),
        F.count(F.lit(1)).alias("pulls"))


def all_arms(runs: DataFrame, n_arms: int) -> DataFrame:
    """One row per (run_id, arm) for arms 0..n_arms-1 (generated, not joined)."""
    return runs.select("run_id").distinct().select(
        "run_id", F.explode(F.sequence(F.lit(0), F.lit(n_arms - 1))).alias("arm"))


def bandit_posterior(rewards: DataFrame, n_arms: int, decay: float = DECAY,
                     alpha: float = PRIOR_ALPHA, beta: float = PRIOR_BETA) -> DataFrame:
    """Beta(wins + alpha, losses + beta) for every arm of every run (unpulled arms: the prior)."""
    st = bandit_state(rewards, decay)
    arms = all_arms(rewards, n_arms)
    return (arms.join(st, ["run_id", "arm"], "left")
            .select("run_id", "arm",
                    F.coalesce("wins", F.lit(0.0)).alias("wins"),
                    F.coalesce("losses", F.lit(0.0)).alias("losses"))
            .withColumn("alpha", F.col("wins") + F.lit(alpha))
            .withColumn("beta", F.col("losses") + F.lit(beta)))


def block_size(decay: float) -> int:
    """Steps of a block: powers of ``decay`` over that many stay below e^100."""
    return max(1, int(100 / -math.log(decay))) if 0 < decay < 1 else 1 if decay <= 0 else 1 << 30


def bandit_history(rewards: DataFrame, n_arms: int, decay: float = DECAY) -> DataFrame:
    """(wins, losses) of every arm after every step: the state the original saves per update.

    For arm a after step T: sum over t <= T of x_t(a) * decay^(T-t+1). Steps are cut into blocks of
    at most e^100 in powers, so they stay finite at any run length. Within a block that begins at s it is
    decay^(T-s+1) * running_sum(x_t(a) * decay^(s-t)), one window per (run, arm, block); a window over the
    blocks' totals carries what came before. Totals weigh e^-100 less with each block, so after
    ``CARRY_BLOCKS`` blocks nothing is left in a double.
    """
    size = block_size(decay)
    grid = rewards.select("run_id", "step", F.col("arm").alias("_chosen"), "reward").withColumn(
        "arm", F.explode(F.sequence(F.lit(0), F.lit(n_arms - 1))))
    block = F.floor(F.col("step") / size)
    hit = F.col("arm") == F.col("_chosen")
    rows = grid.select("run_id", "step", "arm", block.alias("_block"), (F.col("step") - block * size).cast("double").alias("_at"),
                       (hit & (F.col("reward") > 0)).alias("_win"), (hit & ~(F.col("reward") > 0)).alias("_loss"))
    inv = F.pow(F.lit(decay), -F.col("_at"))
    scale = F.pow(F.lit(decay), F.col("_at") + 1)
    left = F.pow(F.lit(decay), size - F.col("_at"))            # of a step, at the end of its block
    # what a run's earlier blocks leave at the begin of each block
    before = Window.partitionBy("run_id", "arm").orderBy("_block").rangeBetween(-CARRY_BLOCKS, -1)
    totals = rows.groupBy("run_id", "arm", "_block").agg(
        *[F.sum(F.when(F.col(x), left).otherwise(0.0)).alias(x) for x in ("_win", "_loss")])
    totals = totals.withColumn("_past", F.collect_list(F.struct("_block", "_win", "_loss")).over(before))

    def carried(x: str) -> F.Column:
        weight = lambda p: F.pow(F.lit(decay), ((F.col("_block") - p["_block"] - 1) * size).cast("double"))
        return F.aggregate("_past", F.lit(0.0), lambda a, p: a + p[x] * weight(p))
    carry = totals.select(F.col("run_id").alias("_run"), F.col("arm").alias("_arm"), F.col("_block").alias("_b"),
                          carried("_win").alias("_w0"), carried("_loss").alias("_l0"))
    rows = rows.join(carry, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("arm") == F.col("_arm")) & (F.col("_block") == F.col("_b")))
    w = Window.partitionBy("run_id", "arm", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "run_id", "step", "arm",
        (F.col("_w0") * scale + scale * F.sum(F.when(F.col("_win"), inv).otherwise(0.0)).over(w)).alias("wins"),
        (F.col("_l0") * scale + scale * F.sum(F.when(F.col("_loss"), inv).otherwise(0.0)).over(w)).alias("losses"))


def best_arm(state: DataFrame) -> DataFrame:
    """Arm with the highest expected win rate w/(w+l) per run; unpulled arms (0/0) never win,
    ties go to the lowest arm. A plain aggregation (no window)."""
    ratio = F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))
    return (state.withColumn("_r", ratio).filter(F.col("_r").isNotNull())
            .groupBy("run_id")
            .agg(F.max_by("arm", F.struct(F.col("_r"), -F.col("arm"))).alias("best_arm"),
                 F.max("_r").alias("expected_rate")))


def dead_arms(rewards: DataFrame) -> DataFrame:
    """Rounds penalised because the chosen arm had nothing left to sample, per (run, arm)."""
    return (rewards.filter(F.col("reward") == F.lit(DEAD_REWARD))
            .groupBy("run_id", "arm").agg(F.count(F.lit(1)).alias("dead_rounds"),
                                          F.min("step").alias("first_dead_step")))


_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_CANDIDATES = 12      # rejection-sampling candidates per gamma draw (failure odds below 1e-15)


def _uniforms(seed: np.ndarray, n: int) -> np.ndarray:
    """Counter-based uniforms in (0, 1): splitmix64(seed + j * golden), shape (rows, n)."""
    with np.errstate(over="ignore"):
        x = seed.astype(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _gamma(shape: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Vectorised Marsaglia-Tsang gamma draws; shape < 1 boosted by U^(1/shape).
    ``u`` holds 3 * _CANDIDATES + 1 uniforms per row."""
    k = _CANDIDATES
    boost = shape < 1
    a = np.where(boost, shape + 1.0, shape)
    d = a - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    u1, u2, u3 = u[:, :k], u[:, k:2 * k], u[:, 2 * k:3 * k]
    z = np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)
    v = (1.0 + c[:, None] * z) ** 3
    with np.errstate(invalid="ignore", divide="ignore"):
        ok = (v > 0) & (np.log(u3) < 0.5 * z * z + d[:, None] - d[:, None] * v + d[:, None] * np.log(v))
    first = np.argmax(ok, axis=1)
    g = d * v[np.arange(len(a)), first]
    return np.where(boost, g * u[:, 3 * k] ** (1.0 / shape), g)


@F.pandas_udf(T.DoubleType())
def _beta_draw(alpha: pd.Series, beta: pd.Series, seed: pd.Series) -> pd.Series:
    """Beta(alpha, beta) = X / (X + Y) with X, Y gamma draws from the row's own seed, so a
    draw does not depend on how rows are batched or partitioned."""
    s = seed.to_numpy().astype(np.int64).view(np.uint64)
    m = 3 * _CANDIDATES + 1
    u = _uniforms(s, 2 * m)
    x = _gamma(alpha.to_numpy(dtype=float), u[:, :m])
    y = _gamma(beta.to_numpy(dtype=float), u[:, m:])
    return pd.Series(x / (x + y))


def choose_arm(posterior: DataFrame, step_col: F.Column | None = None, seed: int = 0) -> DataFrame:
    """Thompson draw: theta ~ Beta(alpha, beta) per arm, seeded by xxhash64(seed, run, step, arm)
    so a retried task draws the same; the chosen arm is the argmax per run."""
    step = step_col if step_col is not None else F.lit(0)
    h = F.xxhash64(F.lit(seed), F.col("run_id"), step, F.col("arm"))
    drawn = posterior.withColumn("theta", _beta_draw(F.col("alpha"), F.col("beta"), h))
    return drawn.groupBy("run_id").agg(F.max_by("arm", F.struct("theta", -F.col("arm"))).alias("chosen_arm"),
                                       F.max("theta").alias("theta"))


def carry_intervals(labeled: DataFrame, accepted: DataFrame) -> DataFrame:
    """Positive rows of each round with the step that releases them from the carry-over buffer.

    A positive labeled at step s stays in the buffer until the next accepted step > s
    (``released_at``; NULL = still buffered). Rows of an accepted step are never buffered
    (``released_at = step``). One window over the per-round results, one equi-join; no pairs.
    """
    w_next = Window.partitionBy("run_id").orderBy("step").rowsBetween(0, Window.unboundedFollowing)
    nxt = accepted.select("run_id", "step", F.min(F.when(F.col("accepted"), F.col("step"))).over(w_next)
                          .alias("released_at"))
    pos = labeled.filter(F.col("label") == 1)
    return pos.join(nxt, ["run_id", "step"], "inner")


def positive_buffer(labeled: DataFrame, accepted: DataFrame) -> DataFrame:
    """Buffer after the last logged round of each run: positives not yet released, one per id."""
    iv = carry_intervals(labeled, accepted).filter(F.col("released_at").isNull())
    w = Window.partitionBy("run_id", "id").orderBy(F.col("step").desc())
    return iv.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "released_at")


def accepted_training_rows(labeled: DataFrame, accepted: DataFrame, seed, balance: bool = True) -> DataFrame:
    """The training set behind every accepted round: its own labels, the positives it releases from
    the carry-over buffer, one row per id (a positive label wins), negatives cut to 2 : 1."""
    released = carry_intervals(labeled, accepted).filter(F.col("released_at").isNotNull())
    released = released.select("run_id", F.col("released_at").alias("step"), "id", "title", "label")
    rounds = accepted.filter("accepted").select("run_id", "step")
    own = labeled.filter(F.col("label") == 0).join(rounds, ["run_id", "step"], "left_semi")
    rows = released.unionByName(own.select(*released.columns)).groupBy("run_id", "step", "id").agg(
        F.max(F.struct("label", "title")).alias("_r"))
    rows = rows.select("run_id", "step", "id", "_r.title", "_r.label")
    return balance_two_to_one(rows, seed, ["run_id", "step"]) if balance else rows


def results_by_arm(rounds: DataFrame, metrics: list[str]) -> DataFrame:
    """Per run and arm: rounds, accepted rounds, and a JSON list of its rounds in order of step with
    their metrics (six decimals as text, null for a dead round). One group holds an arm's rounds."""
    shown = [F.round(F.col(m), 6).cast("decimal(18,6)").cast("string").alias(m) for m in metrics]
    return rounds.groupBy("run_id", "arm").agg(
        F.count(F.lit(1)).alias("n_rounds"),
        F.sum(F.col("accepted").cast("int")).cast("bigint").alias("n_accepted"),
        F.to_json(F.array_sort(F.collect_list(F.struct("step", *shown, "accepted"))),
                  {"ignoreNullFields": "false"}).alias("rounds_json"))
