"""Index vectors and topic words against plain Python, over texts longer than one block of added bits."""

import hashlib

import numpy as np

from curio.operators import topics as TP


def vector(word, dim=64):
    d = np.frombuffer(hashlib.md5(word.encode()).digest(), ">u4")
    return np.array([2.0 * (int(d[i // 32]) >> i % 32 & 1) - 1 for i in range(dim)])


def test_embeddings_are_means_of_index_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choice(words, n)) for n in (1, 254, 255, 256, 510, 511, 3000)] + ["", "  ", None, " a  b "]
    want = []
    for t in texts:
        w = (t or "").strip(" ").split(" ") if (t or "").strip(" ") else []
        want.append(np.mean([vector(x) for x in w], axis=0) if w else np.zeros(64))
    rows = [(str(i), t) for i, t in enumerate(texts)] + [("0", "zz")]          # a repeated id is one document
    want[0] = (vector(texts[0]) + vector("zz")) / 2
    emb = TP.embed_documents(spark.createDataFrame(rows, "id string, t string"), "t")
    got = {x["id"]: np.array(x["embedding"]) for x in emb.collect()}
    assert len(got) == len(texts)
    for i, v in enumerate(want):
        assert np.array_equal(got[str(i)], v), texts[i]
    # ids of any type keep their value
    big = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b")], "id long, t string")
    assert {r["id"] for r in TP.embed_documents(big, "t").collect()} == {(1 << 60) + 1, None}


def test_the_bit_table_begins_anew_without_changing_sums():
    table = TP._BitTable(20)
    n, ones = TP.bit_sums(["a b a", "", "c " * 299 + "c"], table)
    assert n.tolist() == [3, 0, 300]
    assert np.array_equal(2 * ones[0] - 3, 2 * vector("a", 20) + vector("b", 20))
    assert np.array_equal(2 * ones[2] - 300, 300 * vector("c", 20)) and not ones[1].any()
    assert np.array_equal(TP.bit_sums(["b"], TP._BitTable(20))[1][0], (vector("b", 20) + 1) / 2)


def test_topic_words_keep_the_best_of_every_task(spark):
    words = [f"w{i}" for i in range(500)] + ["same", "same2"]
    table = spark.createDataFrame([(w, vector(w).tolist()) for w in words] + [("null", [0.0] * 64)], "word string, vector array<double>").repartition(7)
    cents = {0: vector("w3") + 0.5 * vector("w9"), 2: -vector("w4"), 5: np.zeros(64)}
    got = TP.topic_words_by_vector(table, spark.createDataFrame([(t, c.tolist(), 1) for t, c in cents.items()],
                                                                "label_cluster int, centroid array<double>, size int"), n=4)
    assert got.columns == ["label_cluster", "word", "score", "rank"]
    rows = {(r["label_cluster"], r["rank"]): (r["word"], r["score"]) for r in got.collect()}
    assert len(rows) == 12
    for t, c in cents.items():
        size = np.linalg.norm(c) or 1.0
        want = sorted(((-float(vector(w) @ c) / size / 8, w) for w in words), key=lambda x: (round(x[0], 9), x[1]))
        if t == 5:
            want = sorted([(0.0, w) for w in [*words, "null"]])
        for i in range(4):
            assert abs(rows[t, i + 1][1] + want[i][0]) < 1e-9 and (t != 5 or rows[t, i + 1][0] == want[i][1])
    # tasks pass on few rows: nothing is exploded by topic before the cut
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_cluster_methods_embeds_the_documents_once(spark, monkeypatch):
    from curio.plans import q_topics
    from tests.conftest import SF_SMALL

    made, given = [], []
    ids = spark.createDataFrame([("a", 0)], "id string, label_cluster int")
    monkeypatch.setattr(q_topics.TP, "embed_documents", lambda *a, **k: made.append(1) or "vectors")
    monkeypatch.setattr(q_topics.TP, "cluster", lambda *a, **k: given.append(k.get("embeddings")) or ids)
    assert q_topics.cluster_methods(spark, SF_SMALL).count() == 3
    assert made == [1] and given == ["vectors"] * 3
