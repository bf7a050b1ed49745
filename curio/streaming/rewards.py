"""Incremental bandit state over an appended reward log (Structured Streaming).

Rounds append ``(run_id, step, arm, reward)`` rows to a parquet folder. This stream keeps, per (run, arm, block of
steps), the decayed (wins, losses) as of the block's last logged step: with s the begin of the block, sums of
decay^(s - t) over its rows, brought to the last step. A block is so short that these powers stay finite, whatever the
length of a run.

The sums are a streaming aggregation, so late or re-ordered rounds give the same state, a hot run spreads over its
arms and blocks, and no group passes through Python. ``latest_states`` merges the blocks of an arm, ``current_state``
brings every arm to the run's horizon (a window over that run's arm rows), giving exactly
``operators.bandit.bandit_state``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bandit import DECAY, block_size
from ..schemas import REWARDS


def reward_stream(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.readStream.schema(REWARDS).parquet(log_path)


def arm_state_stream(rewards: DataFrame, decay: float = DECAY) -> DataFrame:
    """Streaming (run_id, arm, block, last_step, wins, losses), updated whenever an arm gets rows of the block."""
    size = block_size(decay)
    block = F.floor(F.col("step") / size)
    rows = rewards.select("run_id", "arm", block.alias("block"), "step", (F.col("reward") > 0).alias("_won"),
                          F.pow(F.lit(decay), (block * size - F.col("step")).cast("double")).alias("_w"))
    sums = rows.groupBy("run_id", "arm", "block").agg(
        F.max("step").alias("last_step"), F.sum(F.when(F.col("_won"), F.col("_w")).otherwise(0.0)).alias("_wins"),
        F.sum(F.when(F.col("_won"), 0.0).otherwise(F.col("_w"))).alias("_losses"))
    back = F.pow(F.lit(decay), (F.col("last_step") - F.col("block") * size + 1).cast("double"))
    return sums.select("run_id", "arm", "block", "last_step", (F.col("_wins") * back).alias("wins"), (F.col("_losses") * back).alias("losses"))


def latest_states(updates: DataFrame, decay: float = DECAY) -> DataFrame:
    """(run_id, arm, last_step, wins, losses) from all updates the stream wrote: of each block the last one (an update
    never takes a row back, so it has the most weight), blocks of an arm merged at its last step."""
    newest = F.max_by(F.struct("last_step", "wins", "losses"), F.struct("last_step", F.col("wins") + F.col("losses"))).alias("s")
    blocks = updates.groupBy("run_id", "arm", "block").agg(newest)
    every = F.collect_list(F.struct("s.last_step", "s.wins", "s.losses"))  # a row per block of one arm
    arms = blocks.groupBy("run_id", "arm").agg(F.max("s.last_step").alias("last_step"), every.alias("_b"))

    def total(x: str) -> F.Column:
        return F.aggregate("_b", F.lit(0.0), lambda a, b: a + b[x] * F.pow(F.lit(decay), (F.col("last_step") - b["last_step"]).cast("double")))
    return arms.select("run_id", "arm", "last_step", total("wins").alias("wins"), total("losses").alias("losses"))


def current_state(arm_states: DataFrame, decay: float = DECAY) -> DataFrame:
    """Bring each arm's state to its run's last step (batch view over the stream's output).
    The window spans one run's arm rows (at most the arm count)."""
    horizon = F.max("last_step").over(Window.partitionBy("run_id"))
    f = F.pow(F.lit(decay), (horizon - F.col("last_step")).cast("double"))
    return arm_states.select("run_id", "arm", (F.col("wins") * f).alias("wins"), (F.col("losses") * f).alias("losses"))
