"""Fits of several seeds in the same passes: few jobs, each fit as if it were alone; a run's weights judged in a scan as by the join."""

import numpy as np
import pytest

from curio.operators import kmeans as KM
from curio.operators import multi_fit as MF
from curio.operators import topics as TP


def vectors(spark, groups=5, each=40, dim=6):
    r = np.random.default_rng(4)
    x = np.vstack([c + 0.2 * r.normal(size=(each, dim)) for c in 6 * r.normal(size=(groups, dim))])
    rows = [(str(i), v.tolist()) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id string, embedding array<double>").repartition(4).localCheckpoint()


def jobs_of(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        rows = f().collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


@pytest.mark.parametrize("fit, args, most", [(TP.kmeans_topics, {"k": 5}, 45), (TP.fine_topics, {"k_fine": 8}, 75)])
def test_fits_of_several_seeds_share_their_passes(spark, fit, args, most):
    x, emb = vectors(spark)
    together, jobs = jobs_of(spark, fit.__name__, lambda: fit(emb, seed=[1, 2, 3], **args))
    assert jobs <= most and len(together) == 3 * len(x)
    out = "label_cluster" if fit is TP.kmeans_topics else "fine_topic"
    got = {s: {r["id"]: r[out] for r in together if r["seed"] == s} for s in (1, 2, 3)}
    alone = {r["id"]: r[out] for r in fit(emb.repartition(3), seed=2, **args).collect()}
    assert got[2] == alone                                   # whatever the partitions and the other seeds
    for s in got:
        label = np.array([got[s][str(i)] for i in range(len(x))])
        assert len(set(label)) == next(iter(args.values()))
        assert all(len(set(np.arange(len(x))[label == c] // 40)) == 1 for c in set(label))   # no cluster joins two groups


def test_kmeans_ends_at_means_of_nearest_rows(spark):
    x, emb = vectors(spark, groups=3)
    with KM.Blocks(emb, "id", "embedding") as blocks:
        (cost, centres), = KM.kmeans(blocks, 4, [7], 100).values()
        at, far = KM.nearest(np.rint(x * blocks.scale), centres[None])
        for c in range(4):
            assert np.allclose(x[at[:, 0] == c].mean(0), centres[c] / blocks.scale, atol=1e-3)
        assert np.isclose(cost, far.sum())


def test_odd_vectors(spark):
    same = spark.createDataFrame([(str(i), [1.0, 0.0]) for i in range(9)], "id string, embedding array<double>")
    assert {r["label_cluster"] for r in TP.kmeans_topics(same, 3).collect()} == {0}      # one distinct vector: one cluster
    assert len({r["fine_topic"] for r in TP.fine_topics(same, 4).collect()}) == 1
    opposite = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [-1.0, 0.0])], "id string, embedding array<double>")
    assert len({r["fine_topic"] for r in TP.fine_topics(opposite, 2).collect()}) == 2    # their mean is zero
    none = same.where("id = 'x'")
    assert TP.kmeans_topics(none, 3).count() == 0 and TP.fine_topics(none, 3).count() == 0


def test_topic_models_of_several_seeds_equal_those_alone(spark):
    words = [["oil", "gas", "well", "rig"], ["cow", "milk", "farm", "hay"]]
    rows = [(str(i), " ".join(np.random.default_rng(i).choice(words[i % 2], 30))) for i in range(60)] + [("e", "")]
    bow = TP.hashed_counts(spark.createDataFrame(rows, "id string, t string").repartition(3), "t", 1 << 14).persist()
    both = TP.fit_ldas(bow, 3, 4, [5, 9])
    for model, seed in zip(both, (5, 9)):
        one = TP.fit_lda(bow, 3, 4, seed)
        assert np.array_equal(model.weight, one.weight) and np.array_equal(model.alpha, one.alpha)
    got = TP.assign_ldas(both, bow).collect()
    assert sorted((r["seed"], r["id"]) for r in got) == sorted((s, i) for s in (5, 9) for i, _ in rows)
    bow.unpersist()


def test_weights_judge_rows_as_the_join_does(spark):
    texts = [(str(i), t) for i, t in enumerate(["ring a", "b c", None, "", "C ring!", "new words only", "c, a c"] * 2)]
    train = spark.createDataFrame([(r, i, t, int("ring" in (t or "").lower()), False) for r in ("r1", "r2") for i, t in texts],
                                  "run_id string, id string, title string, label int, weighted boolean").where("run_id = 'r1' OR id < '5'")
    models = MF.fit_runs(train).cache()
    judged = spark.createDataFrame([(r, i, t) for r in ("r1", "r2") for i, t in texts], "run_id string, id string, title string")
    want = MF.predict_runs(judged.drop("title"), MF.term_counts(judged, ["run_id", "id"]), models, ["run_id"], ["run_id", "id"])
    want = {(r["run_id"], r["id"]): r["predicted_label"] for r in want.collect()}
    rows = judged.select("run_id", "id", MF.terms("title").alias("terms")).toArrow()
    terms, ends = MF.flat_terms(rows["terms"].combine_chunks())
    weights = MF.weights(models.toArrow())
    for run in ("r1", "r2"):
        at = np.flatnonzero(np.array(rows["run_id"].to_pylist()) == run)[::-1]
        got = MF.judge(weights[run], terms, ends, at)
        assert {(run, rows["id"][int(i)].as_py()): int(c) for i, c in zip(at, got)} == {k: v for k, v in want.items() if k[0] == run}
    assert {want["r1", i] for i, _ in texts} == {0, 1}
