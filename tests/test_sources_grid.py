"""Sources (CSV round trip with quotes and newlines, two-split scan) and the experiment grid."""

from curio.schemas import NEWS_POOL
from curio.session import scratch_path
from curio.sources import io
from tests.conftest import SF_SMALL


def test_csv_round_trip_keeps_quotes_and_newlines(spark):
    rows = [("1", "t", 'he said "yes"\nthen left', 1), ("2", "u", "a,b\n\nc", None), ("3", None, "", 0)]
    df = spark.createDataFrame(rows, NEWS_POOL)
    path = scratch_path(spark, "csv")
    io.write_csv(df, path)
    back = {r["id"]: (r["title"], r["text"], r["label"]) for r in io.read_csv(spark, path, NEWS_POOL).collect()}
    assert back["1"] == ("t", 'he said "yes"\nthen left', 1)
    assert back["2"] == ("u", "a,b\n\nc", None)
    assert back["3"][0] is None


def test_read_splits(spark):
    tr, te = scratch_path(spark, "train"), scratch_path(spark, "test")
    spark.createDataFrame([("1", "a", "x", 1), ("2", "b", "y", 0)], NEWS_POOL).write.parquet(tr)
    spark.createDataFrame([("3", "c", "z", 1)], NEWS_POOL).write.parquet(te)
    got = {r["split"]: r["count"] for r in io.read_splits(spark, tr, te, NEWS_POOL).groupBy("split").count().collect()}
    assert got == {"train": 2, "test": 1}


def test_grid_runs_isolated_configs(spark):
    from curio.plans.grid import grid_configs, run_grid, summarize
    cfgs = grid_configs(methods=("lda",), balance=(True, False), repeats=1)
    res = run_grid(spark, SF_SMALL, cfgs, rounds=1, k=3)
    assert res.select("run_id").distinct().count() == 2
    s = summarize(res).collect()
    assert sorted(r["balance"] for r in s) == [False, True] and all(r["n_runs"] == 1 for r in s)


def test_grid_run_registers_the_whole_grid(spark, monkeypatch):
    import inspect
    from curio.plans import grid, q_model, registry
    seen = {}

    def fake(spark, d, configs, **kw):
        seen.update(inspect.signature(grid.run_grid).bind(spark, d, configs, **kw).arguments, kw=kw)
        return spark.createDataFrame([(c["run_id"], True, 0.5 + c["repeat"] / 10, c["dataset"], c["method"], c["balance"], c["filter_label"])
                                      for c in configs], "run_id string, accepted boolean, metric double, dataset string, method string, balance boolean, filter_label boolean")

    monkeypatch.setattr(q_model, "run_grid", fake)
    registry.load_all()
    out = registry.QUERIES["grid_run"](spark, SF_SMALL).collect()
    assert seen["kw"] == {} and len(seen["configs"]) == 72                # default rounds and k
    assert {(r["dataset"], r["method"], r["balance"], r["filter_label"]) for r in out} == {
        (d, m, b, f) for d in ("news", "ads") for m in grid.METHODS for b in (True, False) for f in (True, False)}
    assert all(r["n_runs"] == 3 and r["std_metric"] is not None for r in out)


def test_grid_runs_share_one_assignment(spark, monkeypatch):
    from curio.operators import topics
    from curio.plans.grid import grid_configs, run_grid
    fits, fit = [], topics.cluster
    monkeypatch.setattr(topics, "cluster", lambda *a, **kw: fits.append(1) or fit(*a, **kw))
    run_grid(spark, SF_SMALL, grid_configs(methods=("lda",), balance=(True, False), repeats=1), rounds=0, k=4)
    assert len(fits) == 1


def test_only_one_process_masters_get_local_settings():
    from curio.session import is_local
    assert all(map(is_local, ["local", "local[8]", "local[*]", "local[4,2]"]))
    assert not any(map(is_local, [None, "", "yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"]))


def test_saved_topic_model_assigns_new_texts_as_the_fitted_one(spark):
    from curio.operators import topics as TP
    docs = spark.createDataFrame([(str(i), w * 6) for i, w in enumerate(["oil gas well ", "cow milk farm "] * 10)], "id string, t string")
    new = spark.createDataFrame([("n1", "gas well oil oil"), ("n2", "farm cow unseen"), ("n3", ""), ("n4", None)], "id string, t string")
    model = TP.fit_lda(TP.hashed_counts(docs, "t", 1 << 10), 2, 5)
    path = scratch_path(spark, "lda")
    TP.save_lda(model, path)
    bow = TP.hashed_counts(new, "t", 1 << 10)
    want = sorted(map(tuple, TP.assign_lda(model, bow).collect()))
    assert sorted(map(tuple, TP.assign_lda(TP.load_lda(path), bow).collect())) == want and len(want) == 4
