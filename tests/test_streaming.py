"""The streaming state equals the batch closed form, also with rounds arriving out of order."""

import tempfile

from curio.operators import bandit as BD
from curio.schemas import REWARDS
from curio.streaming.rewards import arm_state_stream, current_state, latest_states, reward_stream


def test_stream_equals_batch(spark):
    log = tempfile.mkdtemp(prefix="curio-rewards-")
    batch1 = [("a", 1, 0, 0.2), ("a", 2, 1, -0.1), ("b", 1, 0, -1.0), ("a", 4, 0, 0.3)]
    batch2 = [("a", 3, 2, 0.1), ("b", 2, 1, 0.05), ("a", 5, 0, -0.2)]
    spark.createDataFrame(batch1, REWARDS).write.mode("append").parquet(log)
    q = (arm_state_stream(reward_stream(spark, log)).writeStream.outputMode("update")
         .format("memory").queryName("arm_state_t").option("checkpointLocation", tempfile.mkdtemp()).start())
    q.processAllAvailable()
    spark.createDataFrame(batch2, REWARDS).write.mode("append").parquet(log)
    q.processAllAvailable()
    q.stop()
    latest = spark.sql("""SELECT run_id, arm, max_by(struct(last_step, wins, losses), last_step) AS s
                          FROM arm_state_t GROUP BY run_id, arm""").selectExpr(
        "run_id", "arm", "s.last_step AS last_step", "s.wins AS wins", "s.losses AS losses")
    got = {(r["run_id"], r["arm"]): (r["wins"], r["losses"]) for r in current_state(latest).collect()}
    exp = {(r["run_id"], r["arm"]): (r["wins"], r["losses"])
           for r in BD.bandit_state(spark.createDataFrame(batch1 + batch2, REWARDS)).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert abs(got[k][0] - exp[k][0]) < 1e-12 and abs(got[k][1] - exp[k][1]) < 1e-12


def test_stream_of_long_runs_and_late_rounds_without_python(spark):
    """Blocks of a long run merge to the closed form; a late round of an old block counts; Spark alone sums."""
    size = BD.block_size(BD.DECAY)
    batch1 = [("a", t, t % 2, 0.1 if t % 3 else -0.2) for t in range(size - 40, size + 40)] + [("a", 90_000, 0, 0.5), ("b", 1, 0, -1.0)]
    batch2 = [("a", size - 100, 1, 0.3), ("a", size + 40, 1, -0.3), ("a", 1, 1, 0.3)]
    log, out = tempfile.mkdtemp(prefix="curio-rewards-"), tempfile.mkdtemp(prefix="curio-states-")
    for rows in (batch1, batch2):
        spark.createDataFrame(rows, REWARDS).write.mode("append").parquet(log)
        stream = arm_state_stream(reward_stream(spark, log))
        q = (stream.writeStream.outputMode("update").foreachBatch(lambda b, _: b.write.mode("append").parquet(out))
             .option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
    assert "Pandas" not in stream._jdf.queryExecution().logical().toString()
    got = {(r["run_id"], r["arm"]): (r["wins"], r["losses"]) for r in current_state(latest_states(spark.read.parquet(out))).collect()}
    exp = {(r["run_id"], r["arm"]): (r["wins"], r["losses"])
           for r in BD.bandit_state(spark.createDataFrame(batch1 + batch2, REWARDS)).collect()}
    assert got.keys() == exp.keys()
    for k in exp:
        assert all(abs(g - e) <= 1e-12 + 1e-9 * abs(e) for g, e in zip(got[k], exp[k])), k
