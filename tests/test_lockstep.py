"""The lockstep grid: fits against a plain optimiser, scoring against numpy, a run of the grid against the same run alone."""

import numpy as np
from pyspark.sql import functions as F

from curio.operators import multi_fit as MF
from curio.plans.grid import grid_configs, run_grid
from curio.plans.lockstep import LABELED_LOG, Steps
from curio.session import scratch_path
from tests.conftest import SF_SMALL


def dense(y, rows, weighted):
    """Standardised tf-idf as a matrix, and the weight of each row."""
    feats = np.unique(np.concatenate(rows))
    tf = np.array([[np.sum(r == f) for f in feats] for r in rows], float)
    idf = np.log((len(y) + 1) / ((tf > 0).sum(0) + 1))
    each = np.where(y > 0, MF.POS_WEIGHT, MF.NEG_WEIGHT) if weighted else np.ones(len(y))
    each = each / each.sum()
    x = tf * idf
    sd = np.sqrt(np.maximum((each[:, None] * x * x).sum(0) - (each[:, None] * x).sum(0) ** 2, 0))
    scale = np.divide(1.0, sd, out=np.zeros_like(sd), where=sd > 1e-9)
    return feats, x * scale, scale * idf, each


def plain_fit(y, rows, weighted, reg=MF.REG_PARAM):
    """Newton steps on the same loss until the gradient is gone."""
    feats, x, back, each = dense(y, rows, weighted)
    x1 = np.c_[x, np.ones(len(y))]
    pen = np.r_[np.full(x.shape[1], reg), 0]
    v = np.zeros(x1.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x1 @ v))
        g = x1.T @ (each * (p - y)) + pen * v
        h = (x1 * (each * p * (1 - p))[:, None]).T @ x1 + np.diag(pen + 1e-12)
        v = v - np.linalg.solve(h, g)
    assert np.abs(g).max() < 1e-8
    return v[-1], feats, v[:-1] * back


def sample_rows(seed=0, n=40):
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.4).astype(float)
    rows = [r.integers(0, 12, r.integers(0, 9)) + 3 * int(c) * (r.random() < 0.5) for c in y]
    return y, [np.asarray(x, np.int64) for x in rows]


def test_fit_rows_equals_a_plain_optimiser():
    for weighted in (False, True):
        y, rows = sample_rows()
        b, f, w = MF.fit_rows(y, rows, weighted, steps=4000)
        pb, pf, pw = plain_fit(y, rows, weighted)
        assert (f == pf).all() and abs(b - pb) < 1e-4 and np.abs(w - pw).max() < 1e-4
        b, f, w = MF.fit_rows(y, rows, weighted)  # the default number of steps decides the same rows

        def z(bias, weights):
            return np.array([bias + sum(weights[np.searchsorted(f, t)] for t in r) for r in rows])
        assert ((z(b, w) > 0) == (z(pb, pw) > 0)).mean() >= 0.95
    assert MF.fit_rows(np.ones(3), [np.array([1])] * 3, False)[0] > 0 > MF.fit_rows(np.zeros(3), [np.array([1])] * 3, False)[0]
    b, f, w = MF.fit_rows(np.array([0.0, 1.0, 0.0]), [np.zeros(0, np.int64)] * 3, False)  # no words at all: the prior
    assert len(f) == 0 and abs(b - np.log(0.5)) < 1e-6


def test_fit_and_predict_of_many_runs(spark):
    texts = [(str(i), t, int("ring" in (t or ""))) for i, t in enumerate(["ring a", "b c", "ring b", None, "", "C ring!", "a b", "c, a", "d"] * 3)]
    rows = [(run, i, t, y, run == "r2") for run in ("r1", "r2", "r3") for i, t, y in texts if not (run == "r3" and y)]
    train = spark.createDataFrame(rows, "run_id string, id string, title string, label int, weighted boolean").repartition(5)
    models = MF.fit_runs(train).cache()
    alone = MF.fit_runs(train.where("run_id = 'r2'").coalesce(1))
    key = ["run_id", "feature", "weight"]
    assert sorted(map(tuple, models.where("run_id = 'r2'").select(key).collect())) == sorted(map(tuple, alone.select(key).collect()))
    judged = spark.createDataFrame([(run, i, t) for run in ("r1", "r2", "r3") for i, t, _ in texts], "run_id string, id string, title string")
    got = MF.predict_runs(judged.drop("title"), MF.term_counts(judged, ["run_id", "id"]), models, ["run_id"], ["run_id", "id"])
    got = {(r["run_id"], r["id"]): r["predicted_label"] for r in got.collect()}
    assert len(got) == 81
    assert all(got["r3", i] == 0 for i, _, _ in texts)
    assert all(got[r, i] == y for r in ("r1", "r2") for i, t, y in texts if t and len(t) > 1)


def test_a_run_of_the_grid_equals_the_run_alone(spark):
    configs = grid_configs(methods=("lda",), balance=(True, False), repeats=1, filter_label=(False, True), datasets=("ads",))
    root = scratch_path(spark, "grid-test")
    together = run_grid(spark, SF_SMALL, configs, rounds=3, k=3, root=root)
    cols = ["run_id", "step", "arm", "metric", "baseline", "reward", "accepted", "n_train"]
    rows = {}
    for r in together.select(cols).collect():
        rows.setdefault(r["run_id"], []).append(tuple(r))
    assert len(rows) == 4 and all(len(x) == 3 for x in rows.values())
    one = configs[1]
    alone = run_grid(spark, SF_SMALL, [one], rounds=3, k=3, root=scratch_path(spark, "grid-alone"))
    assert sorted(map(tuple, alone.select(cols).collect())) == sorted(rows[one["run_id"]])
    labeled = Steps(spark, f"{root}/rounds").read("labeled", 1, 3, LABELED_LOG)
    assert labeled.groupBy("run_id", "id").count().where("count > 1").isEmpty()
    assert labeled.where("label IS NULL").isEmpty()
    # a finished grid is read, one asked for more rounds goes on
    again = run_grid(spark, SF_SMALL, configs, rounds=3, k=3, root=root)
    assert sorted(map(tuple, again.select(cols).collect()), key=str) == sorted((r for x in rows.values() for r in x), key=str)
    more = run_grid(spark, SF_SMALL, configs, rounds=4, k=3, root=root).select(cols)
    assert more.where("step <= 3").exceptAll(together.select(cols)).isEmpty() and more.where("step = 4").count() == 4


def test_draws_follow_the_arm_and_the_draw_key(spark):
    """The draw of a round is the top of the run's own order among unseen rows of its arm."""
    from curio.functions.hashing import draw_key
    configs = grid_configs(methods=("lda",), balance=(True,), repeats=1, datasets=("ads",))
    root = scratch_path(spark, "grid-draw")
    run_grid(spark, SF_SMALL, configs, rounds=2, k=3, root=root)
    steps = Steps(spark, f"{root}/rounds")
    pool = spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/clusters/dataset=ads/method=lda/k=3")
    seen = set()
    for step in (1, 2):
        drawn = {r["id"] for r in steps.read("labeled", step, step, LABELED_LOG).collect()}
        arm = steps.read("choice", step, step, "run_id string, arm int").first()["arm"]
        ids = [r["id"] for r in pool.where(F.col("label_cluster") == arm)
               .orderBy(draw_key(f"42:{configs[0]['run_id']}:{step}"), "id").select("id").collect()]
        assert drawn == set([i for i in ids if i not in seen][:200])
        seen |= drawn
