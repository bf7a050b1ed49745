"""Spark ML operators and the loop: labels in range, k respected, round trip, loop smoke."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from curio.operators import classify as C
from curio.operators import topics as TP
from curio.plans.q_topics import _docs
from tests.conftest import SF_SMALL


def test_lda_assigns_every_row(spark):
    docs = _docs(spark, SF_SMALL)
    a = TP.cluster(docs, "lda", 5, text_col="topic_text", seed=3, max_iter=3)
    assert a.count() == docs.count()
    labs = [r[0] for r in a.select("label_cluster").distinct().collect()]
    assert all(0 <= x < 5 for x in labs) and sorted(labs) == list(range(len(labs)))


def test_reduce_topics_to_k(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    fine = TP.fine_topics(e, 12, seed=1)
    red = TP.reduce_topics(fine, 4, dim=64)
    assert red.select("label_cluster").distinct().count() == 4 and red.count() == e.count()


def test_classifier_separable_and_roundtrip(spark, tmp_path):
    rows = [(f"shark jaw teeth {i}", 1) for i in range(40)] + [(f"silver coin stamp {i}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, "title string, label int")
    m = C.train_classifier(df, "title", weighted=True)
    met = C.evaluate(m, df, "title").first()
    assert met["accuracy"] > 0.9
    m.write().overwrite().save(str(tmp_path / "m"))
    m2 = PipelineModel.load(str(tmp_path / "m"))
    assert C.evaluate(m2, df, "title").first()["accuracy"] == met["accuracy"]


def test_loop_smoke(spark):
    from curio.plans.flagship import active_learning
    res = active_learning(spark, SF_SMALL, method="lda", k=3, rounds=2, sample_size=20, run_id="smoke").collect()
    assert [r["step"] for r in sorted(res, key=lambda r: r["step"])] == [1, 2]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "n" in df.columns


def test_loop_random_strategy_with_classifier_filter(spark):
    from curio.plans.flagship import active_learning
    res = active_learning(spark, SF_SMALL, method="lda", k=3, rounds=3, sample_size=12, strategy="random",
                          filter_label=True, balance=True, run_id="rnd").collect()
    assert sorted(r["step"] for r in res) == [1, 2, 3]
    assert all(r["arm"] == -1 for r in res)


def test_loop_thompson_with_classifier_filter(spark):
    from curio.plans.flagship import active_learning
    res = active_learning(spark, SF_SMALL, method="lda", k=3, rounds=3, sample_size=12, strategy="thompson",
                          filter_label=True, balance=False, run_id="tf").collect()
    assert sorted(r["step"] for r in res) == [1, 2, 3]
    assert all(0 <= r["arm"] < 3 for r in res)


def test_loop_resumes_from_logs(spark):
    from curio.plans.flagship import active_learning
    from curio.session import scratch_path
    root = scratch_path(spark, "resume")
    first = {r["step"]: r for r in active_learning(spark, SF_SMALL, method="lda", k=3, rounds=2, sample_size=15,
                                                    run_id="res", store_root=root).collect()}
    more = {r["step"]: r for r in active_learning(spark, SF_SMALL, method="lda", k=3, rounds=4, sample_size=15,
                                                   run_id="res", store_root=root).collect()}
    assert sorted(more) == [1, 2, 3, 4]
    for s in (1, 2):
        assert more[s]["arm"] == first[s]["arm"] and more[s]["metric"] == first[s]["metric"]
    seen = spark.read.parquet(f"{root}/ledger").filter("run_id = 'res'")
    assert seen.count() == seen.select("id").distinct().count()     # no id drawn twice


def test_loop_dead_arms_are_penalised(spark):
    from curio.plans.flagship import active_learning
    res = active_learning(spark, SF_SMALL, method="lda", k=2, rounds=4, sample_size=10_000,
                          run_id="dead").collect()
    dead = [r for r in res if r["metric"] is None]
    assert len(dead) >= 2                      # each draw empties its arm; repeats find nothing
    assert all(r["reward"] == -1.0 and not r["accepted"] for r in dead)


def test_label_or_ask_uses_the_stored_label_first(spark):
    from curio.operators import labels as LB
    sample = spark.createDataFrame([("1", "shark tooth"), ("2", "shark fin"), ("3", None), ("3", None)],
                                   "id string, title string").withColumn("clean_title", F.col("title"))
    stored = spark.createDataFrame([("1", 0), ("1", 0)], "id string, label int")
    got = LB.label_or_ask(sample, stored, "news", LB.keyword_labeler(["shark"], "relevant", "not relevant"))
    assert sorted((r["id"], r["label"]) for r in got.collect()) == [("1", 0), ("2", 1), ("3", 0), ("3", 0)]


def test_loop_pool_is_every_row_outside_the_validation_set(spark):
    from curio.plans.flagship import loop_tables
    for ds, table in (("news", "documents"), ("ads", "part")):
        pool, validation, stored = loop_tables(spark, SF_SMALL, ds)
        total = spark.read.parquet(f"{SF_SMALL}/{table}.parquet").count()
        assert pool.count() + validation.count() == total
        assert pool.join(stored, "id", "left_anti").count() > 0        # rows that the labeler must answer


def test_cluster_cache_sees_a_grown_pool(spark):
    from curio.plans.flagship import clustered_pool
    from curio.session import scratch_path
    root = scratch_path(spark, "grown")
    pool = spark.range(60).select(F.col("id").cast("string").alias("id"),
                                  F.concat(F.lit("title "), F.col("id") % 7).alias("title"),
                                  F.concat(F.lit("body word"), F.col("id") % 5).alias("text"))
    assert clustered_pool(spark, pool.limit(30), root, "lda", 2).count() == 30
    assert clustered_pool(spark, pool, root, "lda", 2).count() == 60


def test_write_once_repairs_a_short_table_and_refuses_lost_rows(spark):
    import pytest
    from curio.session import scratch_path
    from curio.sources import io
    path = scratch_path(spark, "once")
    spark.range(3).write.parquet(path)
    assert io.write_once(spark, path, lambda: spark.range(5), rows=5).count() == 5
    with pytest.raises(ValueError):
        io.write_once(spark, scratch_path(spark, "lost"), lambda: spark.range(4), rows=5)


def test_a_round_fits_on_as_few_partitions_as_its_rows_need(spark, monkeypatch):
    """The training set of a round is small: the fit must not run over all partitions of the shuffle before it."""
    from curio.plans import loop
    from curio.plans.flagship import active_learning

    seen, fit = [], loop.C.train_classifier
    monkeypatch.setattr(loop.C, "train_classifier", lambda train, *a: seen.append(train.rdd.getNumPartitions()) or fit(train, *a))
    res = active_learning(spark, SF_SMALL, method="lda", k=3, rounds=2, sample_size=20, run_id="parts").collect()
    assert len(res) == 2 and seen and max(seen) <= 2, seen
