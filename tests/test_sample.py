"""Sampler properties: sizes, no repeats, balance ratio, partition independence."""

from pyspark.sql import functions as F

from curio.operators import sample as SM

from tests.conftest import SF_SMALL


def pool(spark, n=300, arms=3):
    rows = [(str(i), i % arms, (i // 7) % 2) for i in range(n)]
    return spark.createDataFrame(rows, "id string, label_cluster int, predicted_label int")


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_sample_from_arm_sizes(spark):
    p = pool(spark)
    assert SM.sample_from_arm(p, 1, 30, 42).count() == 30
    assert SM.sample_from_arm(p, 1, 1000, 42).count() == 100
    assert SM.sample_from_arm(p, 9, 10, 42).count() == 0


def test_partition_independent(spark):
    p = pool(spark)
    a = ids(SM.stratified_sample(p.repartition(1), 7, 42))
    b = ids(SM.stratified_sample(p.repartition(8), 7, 42))
    assert a == b and len(a) == 21


def test_exclude_seen_no_repeats(spark):
    p = pool(spark)
    first = SM.sample_from_arm(p, 0, 40, 1)
    second = SM.sample_from_arm(SM.exclude_seen(p, first), 0, 40, 1)
    assert not set(ids(first)) & set(ids(second))


def test_posneg_quota(spark):
    p = pool(spark)
    out = SM.stratified_posneg_sample(p, 11, 42)
    per = {(r[0], r[1]): r[2] for r in out.groupBy("label_cluster", "predicted_label").count().collect()}
    for arm in range(3):
        assert per[(arm, 1)] == 5 and per[(arm, 0)] == 6


def test_posneg_no_positive_is_dead(spark):
    p = pool(spark).withColumn("predicted_label", F.lit(0))
    assert SM.arm_posneg_sample(p, 1, 20, 42).count() == 0


def test_balance(spark):
    rows = [(str(i), "r", 1 if i < 5 else 0) for i in range(40)]       # 5 pos, 35 neg
    df = spark.createDataFrame(rows, "id string, run_id string, label int")
    b = SM.balance_two_to_one(df, 1, ["run_id"])
    c = {r[0]: r[1] for r in b.groupBy("label").count().collect()}
    assert c == {1: 5, 0: 10}
    exact = spark.createDataFrame([(str(i), "r", 1 if i < 5 else 0) for i in range(15)],
                                  "id string, run_id string, label int")
    assert SM.balance_two_to_one(exact, 1, ["run_id"]).count() == 15   # ratio exactly 2: untouched
    nopos = df.filter("label = 0")
    assert SM.balance_two_to_one(nopos, 1, ["run_id"]).count() == 35


def test_positive_stratified_quota_uses_all_arms(spark):
    p = pool(spark)
    out = SM.positive_stratified_sample(p, 30, 10, 42)      # 3 per cluster, quota over 10 arms
    assert out.count() == 9


def test_stratified_on_testdata(spark):
    from curio.sources import bind as B
    p = B.news_pool(spark, SF_SMALL)
    out = SM.stratified_sample(p, 5, 42)
    assert out.count() == 5 * p.select("label_cluster").distinct().count()


def test_salted_rank_equals_row_number_on_hot_group(spark):
    from pyspark.sql import Window
    from curio.functions.hashing import draw_key
    rows = [(str(i), "hot" if i % 3 else f"g{i % 7}") for i in range(3000)] + [(str(i), None) for i in range(3000, 3050)]
    df = spark.createDataFrame(rows, "id string, g string")
    got = {(r["id"]): r["_rn"] for r in SM.salted_rank(df, ["g"], 5, "id").collect()}
    w = Window.partitionBy("g").orderBy(draw_key(5, "id"), "id")
    exp = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == exp


def test_dedup_by_id_keeps_first_on_hot_id(spark):
    from curio.operators.prepare import dedup_by_id
    rows = [("hot", i, f"t{i}") for i in range(2000, 0, -1)] + [("a", 5, "x"), ("a", 3, "y"), ("b", 9, "z")]
    df = spark.createDataFrame(rows, "id string, doc_id int, text string")
    for d in (df.repartition(1), df.repartition(8)):
        got = {r["id"]: (r["doc_id"], r["text"]) for r in dedup_by_id(d, "doc_id").collect()}
        assert got == {"hot": (1, "t1"), "a": (3, "y"), "b": (9, "z")}


def test_dedup_counts_reports_what_dedup_by_id_drops(spark):
    from curio.operators.prepare import dedup_by_id, dedup_counts
    rows = [("hot", i) for i in range(500)] + [("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)]
    df = spark.createDataFrame(rows, "id string, doc_id int")
    got = dedup_counts(df).first()
    assert (got["before"], got["after"], got["removed"]) == (505, 4, 501)
    assert dedup_by_id(df, "doc_id").count() == 4
    assert tuple(dedup_counts(df.limit(0)).first()) == (0, 0, 0)
