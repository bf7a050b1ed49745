"""Metrics and cluster statistics against hand-computed values."""

from curio.operators import stats as ST


def weighted_prf(y, p):
    classes = sorted(set(y) | set(p))
    n = len(y)
    acc = sum(a == b for a, b in zip(y, p)) / n
    P = R = F1 = 0.0
    for c in classes:
        tp = sum(a == c and b == c for a, b in zip(y, p))
        sup = sum(a == c for a in y)
        pred = sum(b == c for b in p)
        pr = tp / pred if pred else 0.0
        rc = tp / sup if sup else 0.0
        f = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
        P += pr * sup / n
        R += rc * sup / n
        F1 += f * sup / n
    return acc, P, R, F1


def check(spark, y, p):
    df = spark.createDataFrame(list(zip(y, p)), "label int, prediction int")
    r = ST.classification_metrics(df).first()
    exp = weighted_prf(y, p)
    for got, e in zip((r["accuracy"], r["precision"], r["recall"], r["f1"]), exp):
        assert abs(got - e) < 1e-9


def test_metrics(spark):
    check(spark, [0, 0, 1, 1, 1, 0], [0, 1, 1, 1, 0, 0])
    check(spark, [0, 0, 0, 1], [0, 0, 0, 0])          # class never predicted
    check(spark, [0, 1, 1], [0, 1, 1])                # perfect
    check(spark, [0, 1, 1], [1, 0, 0])                # all wrong


def test_cluster_report_and_imbalance(spark):
    df = spark.createDataFrame([(c,) for c in [0] * 6 + [1] * 3 + [2] * 1], "label_cluster int")
    rep = {r["label_cluster"]: (r["n"], r["pct"], r["bar"]) for r in ST.cluster_report(df).collect()}
    assert rep[0] == (6, 60.0, "#" * 30) and rep[2] == (1, 10.0, "#" * 5)
    im = ST.cluster_imbalance(df).first()
    assert (im["min_size"], im["max_size"], im["ratio"]) == (1, 6, 6.0)


def test_class_ratio_flags(spark):
    rows = [("a", 1)] + [("a", 0)] * 2 + [("b", 1)] * 10 + [("b", 0)] * 21 + [("c", 0)] * 3
    df = spark.createDataFrame(rows, "g string, label int")
    f = {r["g"]: (r["needs_balance"], r["still_unbalanced"]) for r in ST.class_ratio_flags(df, ["g"]).collect()}
    assert f == {"a": (False, True), "b": (True, True), "c": (False, True)}


def test_weighted_flag_edges(spark):
    # ratio 1.99 -> balanced enough; exactly 2.0 -> still weighted; no positives -> weighted
    rows = [("a", 1)] * 100 + [("a", 0)] * 199 + [("b", 1)] * 100 + [("b", 0)] * 200 + [("c", 0)] * 5
    df = spark.createDataFrame(rows, "g string, label int")
    f = {r["g"]: r["still_unbalanced"] for r in ST.class_ratio_flags(df, ["g"]).collect()}
    assert f == {"a": False, "b": True, "c": True}


def test_dense_arms_fills_gaps(spark):
    from curio.operators.topics import dense_arms
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0, 2, 3, 4, 8, 8, 2])], "id int, label_cluster int")
    got = {r["label_cluster"]: r["arm"] for r in dense_arms(df).collect()}
    assert got == {0: 0, 2: 1, 3: 2, 4: 3, 8: 4}
