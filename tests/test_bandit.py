"""Bandit state equals the original step loop; accept/baseline, carry-over, best arm."""

import random

import numpy as np
from pyspark.sql import functions as F

from curio.operators import bandit as BD


def loop_state(log, n_arms, decay=0.99):
    wins, losses = np.zeros(n_arms), np.zeros(n_arms)
    for _, arm, reward in sorted(log):
        if reward > 0:
            wins[arm] += 1
        else:
            losses[arm] += 1
        wins *= decay
        losses *= decay
    return wins, losses


def test_decayed_sum_equals_loop(spark):
    rnd = random.Random(3)
    log = [(t, rnd.randrange(4), rnd.choice([-1.0, -0.1, 0.0, 0.2])) for t in range(1, 40)]
    df = spark.createDataFrame([("r", t, a, x) for t, a, x in log], "run_id string, step int, arm int, reward double")
    st = {r["arm"]: (r["wins"], r["losses"]) for r in BD.bandit_state(df).collect()}
    w, lo = loop_state(log, 4)
    for a in range(4):
        got = st.get(a, (0.0, 0.0))
        assert abs(got[0] - w[a]) < 1e-12 and abs(got[1] - lo[a]) < 1e-12
    hist = BD.bandit_history(df, 4).filter(F.col("step") == 20).collect()
    w20, l20 = loop_state([x for x in log if x[0] <= 20], 4)
    for r in hist:
        assert abs(r["wins"] - w20[r["arm"]]) < 1e-12 and abs(r["losses"] - l20[r["arm"]]) < 1e-12


def test_best_arm_ignores_unvisited(spark):
    st = spark.createDataFrame([("r", 0, 0.0, 0.0), ("r", 1, 0.2, 0.9), ("r", 2, 0.2, 0.9)],
                               "run_id string, arm int, wins double, losses double")
    assert BD.best_arm(st).first()["best_arm"] == 1


def test_reward_accept_sequence(spark):
    res = spark.createDataFrame([("r", 1, 0, 0.5), ("r", 2, 0, 0.6), ("r", 3, 1, None), ("r", 4, 1, 0.55),
                                 ("r", 5, 2, 0.7)], "run_id string, step int, arm int, metric double")
    out = {r["step"]: r for r in BD.reward_accept(res, 0.5).collect()}
    assert [out[s]["accepted"] for s in range(1, 6)] == [False, True, False, False, True]
    assert out[3]["reward"] == -1.0 and abs(out[4]["baseline"] - 0.6) < 1e-12
    assert [out[s]["filter_active"] for s in range(1, 6)] == [False, False, True, True, True]


def test_carry_positives(spark):
    # reject, reject, accept, reject
    res = spark.createDataFrame([("r", 1, 0.4), ("r", 2, 0.3), ("r", 3, 0.9), ("r", 4, 0.1)],
                                "run_id string, step int, metric double").withColumn("arm", F.lit(0))
    acc = BD.reward_accept(res, 0.5)
    lab = spark.createDataFrame([("r", s, f"{s}-{i}", i % 2) for s in range(1, 5) for i in range(4)],
                                "run_id string, step int, id string, label int")
    iv = {r["id"]: r["released_at"] for r in BD.carry_intervals(lab, acc).collect()}
    assert iv["1-1"] == 3 and iv["2-1"] == 3 and iv["3-1"] == 3 and iv["4-1"] is None
    buf = sorted(r["id"] for r in BD.positive_buffer(lab, acc).collect())
    assert buf == ["4-1", "4-3"]


def test_dead_arm_penalty_counts_as_loss(spark):
    df = spark.createDataFrame([("r", 1, 2, -1.0)], "run_id string, step int, arm int, reward double")
    r = BD.bandit_state(df).first()
    assert r["wins"] == 0 and abs(r["losses"] - 0.99) < 1e-12


def test_choose_arm_deterministic(spark):
    post = spark.createDataFrame([("r", a, 0.5 + a, 0.5) for a in range(5)], "run_id string, arm int, alpha double, beta double")
    a = BD.choose_arm(post, F.lit(3), 1).first()["chosen_arm"]
    b = BD.choose_arm(post.repartition(3), F.lit(3), 1).first()["chosen_arm"]
    assert a == b and 0 <= a < 5


def test_beta_draw_moments(spark):
    from pyspark.sql import functions as F
    n = 20000
    df = spark.range(n).select(F.lit("r").alias("run_id"), F.col("id").cast("int").alias("arm"),
                               F.lit(2.5).alias("alpha"), F.lit(0.7).alias("beta"))
    h = F.xxhash64(F.lit(1), F.col("run_id"), F.lit(0), F.col("arm"))
    v = [r[0] for r in df.select(BD._beta_draw(F.col("alpha"), F.col("beta"), h)).collect()]
    mean = sum(v) / n
    var = sum((x - mean) ** 2 for x in v) / (n - 1)
    a, b = 2.5, 0.7
    assert abs(mean - a / (a + b)) < 0.01
    assert abs(var - a * b / ((a + b) ** 2 * (a + b + 1))) < 0.01
    assert all(0.0 < x < 1.0 for x in v)


def test_reward_equal_to_baseline_is_rejected(spark):
    res = spark.createDataFrame([("r", 1, 0, 0.5), ("r", 2, 0, 0.7), ("r", 3, 0, 0.65), ("r", 4, 0, 0.7)],
                                "run_id string, step int, arm int, metric double")
    out = {r["step"]: r for r in BD.reward_accept(res, 0.5).collect()}
    assert [out[s]["accepted"] for s in range(1, 5)] == [False, True, False, False]
    assert abs(out[4]["baseline"] - 0.7) < 1e-12          # a reject keeps the accepted baseline


def test_bandit_edge_cases(spark):
    empty = spark.createDataFrame([], "run_id string, step int, arm int, reward double")
    assert BD.bandit_state(empty).count() == 0
    one = spark.createDataFrame([("r", 1, 0, 0.0), ("r", 2, 0, 0.3)], "run_id string, step int, arm int, reward double")
    st = BD.bandit_state(one).first()                       # reward 0 counts as a loss
    assert abs(st["losses"] - 0.99 ** 2) < 1e-12 and abs(st["wins"] - 0.99) < 1e-12
    post = {r["arm"]: (r["alpha"], r["beta"]) for r in BD.bandit_posterior(one, 3).collect()}
    assert post[1] == (0.5, 0.5) and post[2] == (0.5, 0.5)


def test_accepted_training_rows_match_a_plain_replay(spark):
    """Carry-over, balance and hot repeats against a round-by-round replay."""
    import hashlib
    import random
    rng = random.Random(3)
    rounds = [(f"r{i}", s, rng.random() < 0.4) for i in range(6) for s in range(1, 9)]
    log = [(r, s, 0, f"{r}-{s}-{j % 12}", "t", int(rng.random() < 0.2)) for r, s, _ in rounds for j in range(14)]
    log = [x for x in log if x[1] != 4]                       # a round without labeled rows
    labeled = spark.createDataFrame(log, "run_id string, step int, arm int, id string, title string, label int")
    acc = spark.createDataFrame(rounds, "run_id string, step int, accepted boolean")
    for balance in (True, False):
        got = sorted((r["run_id"], r["step"], r["id"], r["label"])
                     for r in BD.accepted_training_rows(labeled, acc, 5, balance).collect())
        want, buffer = [], {}
        for r, s, ok in rounds:
            own = [(i, y) for a, b, _, i, _, y in log if (a, b) == (r, s)]
            held = buffer.setdefault(r, set())
            held |= {i for i, y in own if y == 1}
            if not ok:
                continue
            neg = sorted({i for i, y in own if y == 0} - held, key=lambda i: (hashlib.md5(f"5:{i}".encode()).hexdigest(), i))
            if balance and held and len(neg) > 2 * len(held):
                neg = neg[:2 * len(held)]
            want += [(r, s, i, 1) for i in held] + [(r, s, i, 0) for i in neg]
            buffer[r] = set()
        assert got == sorted(want)


def test_results_by_arm_shows_metrics_of_every_round(spark):
    import json
    rows = spark.createDataFrame([("a", 2, 1, None, False), ("a", 1, 1, 0.25, True), ("a", 3, 0, 0.5, True)],
                                 "run_id string, step int, arm int, f1 double, accepted boolean")
    got = {r["arm"]: r for r in BD.results_by_arm(rows, ["f1"]).collect()}
    assert json.loads(got[1]["rounds_json"]) == [{"step": 1, "f1": "0.250000", "accepted": True},
                                                 {"step": 2, "f1": None, "accepted": False}]
    assert (got[1]["n_rounds"], got[1]["n_accepted"], got[0]["n_accepted"]) == (2, 1, 1)


def test_logs_keep_run_ids_as_text(spark):
    from curio.schemas import LEDGER
    from curio.session import scratch_path
    from curio.sources import io
    path = scratch_path(spark, "log")
    for run in ("01", "1", "a/b c"):
        io.append(spark.createDataFrame([(run, 1, "x")], LEDGER), path, ["run_id"])
    assert sorted(r["run_id"] for r in io.read_log(spark, path, LEDGER).collect()) == ["01", "1", "a/b c"]


def test_history_of_a_long_run_stays_finite(spark):
    """Two arms over 120,000 steps, the second without a pull for 30,000: equal to the update rule."""
    n = 120_000

    def chosen(t):
        return 0 if 40_000 < t <= 70_000 else t % 2

    log = spark.range(1, n + 1).selectExpr(
        "'r' AS run_id", "cast(id AS int) AS step",
        "cast(if(id > 40000 AND id <= 70000, 0, id % 2) AS int) AS arm", "if(id % 3 = 0, 1.0D, -1.0D) AS reward")
    at = {1, 2, 9_949, 9_950, 9_951, 40_000, 45_000, 69_999, 70_001, 80_001, n}
    got = {(r["step"], r["arm"]): (r["wins"], r["losses"])
           for r in BD.bandit_history(log, 2).filter(F.col("step").isin(sorted(at))).collect()}
    assert len(got) == 2 * len(at)
    w, l = [0.0, 0.0], [0.0, 0.0]
    for t in range(1, n + 1):
        (w if t % 3 == 0 else l)[chosen(t)] += 1
        w, l = [x * 0.99 for x in w], [x * 0.99 for x in l]
        if t in at:
            for a in (0, 1):
                assert all(abs(x - y) <= 1e-9 * y for x, y in zip(got[t, a], (w[a], l[a])) if y > 1e-300), (t, a)
