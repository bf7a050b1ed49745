"""Registered queries: bandit state from the reward log, accept/baseline, carry-over, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import sql_draw_key
from ..operators import bandit as BD
from ..operators import stats as ST
from ..sources import bind as B
from . import sqlbits as S
from .registry import query

N_ARMS = 10
D = BD.DECAY
RA = S.REWARD_ACCEPT
HORIZON = f"(SELECT run_id, max(step) AS T FROM ({RA}) GROUP BY run_id)"


def _ra(spark, d):
    return BD.reward_accept(B.results_log(spark, d), B.INITIAL_BASELINE)


def _rewards(spark, d):
    return _ra(spark, d).select("run_id", "step", "arm", "reward")


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@query("reward_accept", f"""SELECT run_id, step, arm, round(baseline, 6) AS baseline, round(reward, 6) AS reward, accepted,
  coalesce(max(CAST(accepted AS INTEGER)) OVER (PARTITION BY run_id ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS filter_active FROM ({RA})""")
def reward_accept(spark, d):
    return _ra(spark, d).select("run_id", "step", "arm", _r6("baseline"), _r6("reward"), "accepted", "filter_active")


STATE_SQL = f"""SELECT r.run_id, r.arm,
  sum(CASE WHEN r.reward > 0 THEN pow({D}, h.T - r.step + 1) ELSE 0 END) AS wins,
  sum(CASE WHEN r.reward > 0 THEN 0 ELSE pow({D}, h.T - r.step + 1) END) AS losses, count(*) AS pulls
FROM ({RA}) r JOIN {HORIZON} h ON r.run_id = h.run_id GROUP BY r.run_id, r.arm"""


@query("bandit_state", f"SELECT run_id, arm, round(wins, 6) AS wins, round(losses, 6) AS losses, pulls FROM ({STATE_SQL})")
def bandit_state(spark, d):
    return BD.bandit_state(_rewards(spark, d)).select("run_id", "arm", _r6("wins"), _r6("losses"), "pulls")


@query("bandit_posterior", f"""SELECT a.run_id, a.arm, round(coalesce(s.wins, 0) + 0.5, 6) AS alpha,
  round(coalesce(s.losses, 0) + 0.5, 6) AS beta
FROM (SELECT DISTINCT run_id, CAST(g.arm AS INTEGER) AS arm FROM ({RA}), range({N_ARMS}) g(arm)) a
LEFT JOIN ({STATE_SQL}) s ON a.run_id = s.run_id AND a.arm = s.arm""")
def bandit_posterior(spark, d):
    p = BD.bandit_posterior(_rewards(spark, d), N_ARMS)
    return p.select("run_id", "arm", _r6("alpha"), _r6("beta"))


@query("bandit_history", f"""WITH ra AS ({RA}),
g AS (SELECT ra.run_id, ra.step, CAST(a.arm AS INTEGER) AS arm FROM ra, range({N_ARMS}) a(arm))
SELECT g.run_id, g.step, g.arm,
  round(coalesce(sum(CASE WHEN r.reward > 0 THEN pow({D}, g.step - r.step + 1) ELSE 0 END), 0), 6) AS wins,
  round(coalesce(sum(CASE WHEN r.reward > 0 THEN 0 ELSE pow({D}, g.step - r.step + 1) END), 0), 6) AS losses
FROM g LEFT JOIN ra r ON r.run_id = g.run_id AND r.arm = g.arm AND r.step <= g.step
GROUP BY g.run_id, g.step, g.arm""")
def bandit_history(spark, d):
    h = BD.bandit_history(_rewards(spark, d), N_ARMS)
    return h.select("run_id", "step", "arm", _r6("wins"), _r6("losses"))


@query("best_arm", f"""SELECT run_id, arm AS best_arm, round(rate, 6) AS expected_rate FROM (
  SELECT run_id, arm, wins / (wins + losses) AS rate,
    row_number() OVER (PARTITION BY run_id ORDER BY wins / (wins + losses) DESC, arm) AS rn
  FROM ({STATE_SQL}) WHERE wins + losses > 0) WHERE rn = 1""")
def best_arm(spark, d):
    b = BD.best_arm(BD.bandit_state(_rewards(spark, d)))
    return b.select("run_id", "best_arm", _r6("expected_rate"))


@query("dead_arms", f"""SELECT run_id, arm, count(*) AS dead_rounds, min(step) AS first_dead_step
FROM ({RA}) WHERE reward = -1 GROUP BY run_id, arm""")
def dead_arms(spark, d):
    return BD.dead_arms(_rewards(spark, d))


NEXT_ACCEPT = f"""SELECT run_id, step, min(CASE WHEN accepted THEN step END) OVER (PARTITION BY run_id ORDER BY step
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS released_at FROM ({RA})"""
CARRY_SQL = f"""SELECT l.run_id, l.step, l.id, n.released_at FROM ({S.LABELED_LOG}) l
JOIN ({NEXT_ACCEPT}) n ON l.run_id = n.run_id AND l.step = n.step WHERE l.label = 1"""


@query("carry_positives", CARRY_SQL)
def carry_positives(spark, d):
    iv = BD.carry_intervals(B.labeled_log(spark, d), _ra(spark, d))
    return iv.select("run_id", "step", "id", "released_at")


@query("positive_buffer", f"""SELECT run_id, id, max(step) AS step FROM ({CARRY_SQL}) WHERE released_at IS NULL
GROUP BY run_id, id""")
def positive_buffer(spark, d):
    return BD.positive_buffer(B.labeled_log(spark, d), _ra(spark, d)).select("run_id", "id", "step")


@query("seen_ledger", f"SELECT run_id, id, min(step) AS first_step FROM ({S.LABELED_LOG}) GROUP BY run_id, id")
def seen_ledger(spark, d):
    return B.labeled_log(spark, d).groupBy("run_id", "id").agg(F.min("step").alias("first_step"))


@query("labeled_log", f"SELECT run_id, step, arm, id, label FROM ({S.LABELED_LOG})")
def labeled_log(spark, d):
    return B.labeled_log(spark, d).select("run_id", "step", "arm", "id", "label")


TRAIN_SEED = 42


@query("accepted_training_rows", f"""WITH t AS (
  SELECT run_id, step, id, max(label) AS label FROM (
    SELECT run_id, released_at AS step, id, 1 AS label FROM ({CARRY_SQL}) WHERE released_at IS NOT NULL
    UNION ALL SELECT l.run_id, l.step, l.id, l.label FROM ({S.LABELED_LOG}) l
      JOIN ({RA}) r ON r.run_id = l.run_id AND r.step = l.step WHERE r.accepted AND l.label = 0)
  GROUP BY run_id, step, id),
c AS (SELECT run_id, step, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS np,
        sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS nn FROM t GROUP BY run_id, step),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, step, label ORDER BY {sql_draw_key(TRAIN_SEED)}, id) AS rn FROM t)
SELECT k.run_id, k.step, k.id, k.label FROM k JOIN c ON k.run_id = c.run_id AND k.step = c.step
WHERE NOT (c.np > 0 AND c.nn > 2 * c.np) OR k.label = 1 OR k.rn <= 2 * c.np""")
def accepted_training_rows(spark, d):
    rows = BD.accepted_training_rows(B.labeled_log(spark, d), _ra(spark, d), TRAIN_SEED)
    return rows.select("run_id", "step", "id", "label")


@query("label_counts", f"SELECT run_id, step, label, count(*) AS n FROM ({S.LABELED_LOG}) GROUP BY run_id, step, label")
def label_counts(spark, d):
    return ST.label_counts(B.labeled_log(spark, d), ["run_id", "step"])


FLAGS_SQL = f"""SELECT run_id, step, np AS n_pos, nn AS n_neg, (np > 0 AND nn > 2 * np) AS needs_balance,
  (np = 0 OR nn >= 2 * np) AS still_unbalanced FROM (
  SELECT run_id, step, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS np,
    CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nn FROM ({S.LABELED_LOG}) GROUP BY run_id, step)"""


@query("class_ratio_flags", FLAGS_SQL)
def class_ratio_flags(spark, d):
    return ST.class_ratio_flags(B.labeled_log(spark, d), ["run_id", "step"])


@query("class_weights", f"""SELECT l.run_id, l.step, l.id, l.label,
  CAST(CASE WHEN f.still_unbalanced THEN (CASE WHEN l.label = 1 THEN 0.8 ELSE 0.2 END) ELSE 1.0 END AS DOUBLE) AS weight
FROM ({S.LABELED_LOG}) l JOIN ({FLAGS_SQL}) f ON l.run_id = f.run_id AND l.step = f.step""")
def class_weights(spark, d):
    from ..operators.classify import class_weight_col
    log = B.labeled_log(spark, d)
    flags = ST.class_ratio_flags(log, ["run_id", "step"]).select("run_id", "step", "still_unbalanced")
    j = log.join(flags, ["run_id", "step"])
    return j.select("run_id", "step", "id", "label", class_weight_col("label", F.col("still_unbalanced")).alias("weight"))


def _shown(c):
    return f"CAST(CAST(round({c}, 6) AS DECIMAL(18, 6)) AS VARCHAR)"


@query("results_by_arm", f"""SELECT run_id, arm, count(*) AS n_rounds, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted,
  CAST(to_json(list({{'step': step, 'metric': {_shown("metric")}, 'baseline': {_shown("baseline")},
    'reward': {_shown("reward")}, 'accepted': accepted}} ORDER BY step)) AS VARCHAR) AS rounds_json
FROM ({RA}) GROUP BY run_id, arm""")
def results_by_arm(spark, d):
    return BD.results_by_arm(_ra(spark, d), ["metric", "baseline", "reward"])


@query("bandit_state_stream", f"SELECT run_id, arm, round(wins, 6) AS wins, round(losses, 6) AS losses FROM ({STATE_SQL})")
def bandit_state_stream(spark, d):
    """The same state maintained incrementally: the reward log is appended to a parquet folder
    and a Structured Streaming query (availableNow) folds it into state per run, arm and block of steps."""
    from ..schemas import REWARDS
    from ..session import scratch_path
    from ..streaming.rewards import arm_state_stream, current_state, latest_states, reward_stream
    log, out, ckpt = (scratch_path(spark, n) for n in ("rewards_log", "arm_state", "arm_state_ckpt"))
    _rewards(spark, d).select(*[f.name for f in REWARDS.fields]).write.mode("append").parquet(log)
    q = (arm_state_stream(reward_stream(spark, log)).writeStream.outputMode("update")
         .foreachBatch(lambda b, _: b.write.mode("append").parquet(out))
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    latest = latest_states(spark.read.parquet(out))
    return current_state(latest).select("run_id", "arm", _r6("wins"), _r6("losses"))
