"""Online LDA: counts against plain Python, settled topic weights against the plain update, a fit whatever the partitions."""

import zlib
from collections import Counter

import numpy as np

from curio.operators import lda as LD
from curio.operators import topics as TP


def nearly_equal_topics(n_terms=400, k=10, n_docs=30):
    """Documents under topics as a fit begins with: the plain update needs hundreds of rounds for them."""
    r = np.random.default_rng(5)
    model = LD.TopicModel.begin(n_terms, k, 3)
    terms = [np.sort(r.choice(n_terms, int(r.integers(1, 200)), replace=False)) for _ in range(n_docs)]
    counts = [r.integers(1, 4, len(t)) for t in terms]
    ends = np.r_[0, np.cumsum([len(t) for t in terms])]
    return model, np.concatenate(terms), np.concatenate(counts), ends


def plain(gamma, terms, counts, weight, alpha):
    theta = np.exp(LD.log_mean(gamma))
    return theta * ((counts / (weight[terms] @ theta)) @ weight[terms]) + alpha


def test_digamma_and_trigamma():
    assert abs(LD.digamma(np.array([1.0]))[0] + np.euler_gamma) < 1e-9 and abs(LD.trigamma(np.array([1.0]))[0] - np.pi ** 2 / 6) < 1e-8
    x = np.array([1e-3, 0.1, 2.5, 700.0])
    assert np.allclose(LD.digamma(x + 1), LD.digamma(x) + 1 / x, rtol=1e-9) and np.allclose(LD.trigamma(x + 1), LD.trigamma(x) - 1 / x ** 2, rtol=1e-7)


def test_documents_settle_in_few_updates_where_plain_ones_need_hundreds(monkeypatch):
    model, terms, counts, ends = nearly_equal_topics()
    weight, turns, settle = model.term_weights(), [], LD.log_mean
    monkeypatch.setattr(LD, "log_mean", lambda x: turns.append(1) or settle(x))
    got, blocks = {}, 0
    for rows, gamma, theta, term, share in LD.infer(terms, counts, ends, weight, model.alpha, model.start):
        blocks += 1
        got.update(zip(rows.tolist(), gamma))
    assert len(turns) <= 150 * blocks and sorted(got) == list(range(30))
    needed = 0
    for i, g in got.items():
        t, c = terms[ends[i]:ends[i + 1]], counts[ends[i]:ends[i + 1]]
        assert np.abs(plain(g, t, c, weight, model.alpha) - g).mean() < 5e-3      # a fixed point of the update
        assert abs(g.sum() - c.sum() - model.alpha.sum()) < 1e-6
        p, n = model.start, 0
        while (n := n + 1) < 5000:
            p, last = plain(p, t, c, weight, model.alpha), p
            if np.abs(p - last).mean() <= LD.TOLERANCE:
                break
        needed = max(needed, n)
    assert needed > 300


def test_empty_and_long_documents_keep_their_places():
    model, terms, counts, ends = nearly_equal_topics(n_docs=3)
    ends = np.r_[0, 0, ends[1], ends[1], ends[2:], ends[-1]]
    rows = np.concatenate([r for r, *_ in LD.infer(terms, counts, ends, model.term_weights(), model.alpha, model.start)])
    assert sorted(rows) == [1, 3, 4]
    alone = np.concatenate([g for _, g, *_ in LD.infer(terms[:ends[2]], counts[:ends[2]], ends[:3], model.term_weights(), model.alpha, model.start)])
    among = {int(i): g for r, gamma, *_ in LD.infer(terms, counts, ends, model.term_weights(), model.alpha, model.start) for i, g in zip(r, gamma)}
    assert np.allclose(alone[0], among[1], atol=1e-2)


def test_hashed_counts_equal_plain_counts(spark):
    texts = ["a b a", "", None, "  ", " c  " + "d " * 300, "b", "ä 1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, t string").repartition(3)
    bow = TP.hashed_counts(df, "t", 1 << 18, "doc")
    assert bow.schema["doc"].dataType.simpleString() == "bigint"
    got = {r["doc"]: dict(zip(r["_bow"]["terms"], r["_bow"]["counts"])) for r in bow.collect()}
    want = {i: Counter(zlib.crc32(w.encode()) % (1 << 18) for w in (t or "").strip().split(" ") if t and t.strip()) for i, t in enumerate(texts)}
    assert got == want


def test_a_fit_does_not_depend_on_partitions_and_parts_topics(spark):
    words = [["oil", "gas", "well", "rig"], ["cow", "milk", "farm", "hay"], ["ring", "gold", "gem", "shop"]]
    rows = [(str(i), " ".join(np.random.default_rng(i).choice(words[i % 3], 40))) for i in range(90)] + [("e", "")]
    df = spark.createDataFrame(rows, "id string, t string")
    one = TP.fit_lda(TP.hashed_counts(df.repartition(1), "t", 1 << 10).persist(), 3, 5)
    many = TP.fit_lda(TP.hashed_counts(df.repartition(7), "t", 1 << 10).persist(), 3, 5)
    assert np.allclose(one.weight, many.weight, rtol=1e-3) and np.allclose(one.alpha, many.alpha, rtol=1e-3)
    got = {r["id"]: r["label_cluster"] for r in TP.assign_lda(many, TP.hashed_counts(df, "t", 1 << 10)).collect()}
    assert len(got) == 91 and got["e"] == 0
    assert sum(len({got[str(i)] for i in range(j, 90, 3)}) for j in range(3)) == 3   # each theme goes to one topic


def test_a_saved_model_is_read_back_bit_by_bit(spark):
    import pytest
    from curio.session import scratch_path
    model = LD.TopicModel(np.random.default_rng(2).gamma(3, 1, (1 << 10, 4)), np.array([0.3, 0.1, 0.25, 0.2]), 11)
    path = scratch_path(spark, "lda-bits")
    TP.save_lda(model, path)
    back = TP.load_lda(path)
    assert np.array_equal(back.weight, model.weight) and np.array_equal(back.alpha, model.alpha) and back.seed == 11
    assert np.array_equal(back.start, model.start)
    with pytest.raises(Exception):
        TP.save_lda(model, path)


def test_rows_scanned_in_one_piece_are_counted_by_all_cores(spark):
    df = spark.createDataFrame([(str(i), f"large ring {i % 7}") for i in range(500)], "id string, t string").coalesce(1)
    bow = TP.hashed_counts(df, "t", 1 << 10)
    assert bow.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in bow.collect()) == sorted(str(i) for i in range(500))
    wide = df.repartition(3 * spark.sparkContext.defaultParallelism)
    assert TP.hashed_counts(wide, "t", 1 << 10).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_many_documents_share_a_block():
    sizes = np.r_[np.full(400, 100), 0, 100_000]
    got = list(LD.blocks(sizes))
    assert [len(rows) for rows in got] == [400, 1] and sorted(np.concatenate(got)) == [*range(400), 401]


def test_a_pass_adds_up_what_each_document_gives():
    import pyarrow as pa
    model, terms, counts, ends = nearly_equal_topics()
    weight, times = model.term_weights(), np.random.default_rng(1).integers(1, 4, 30).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (terms, counts)]
    batch = pa.RecordBatch.from_arrays([pa.array(times), pa.StructArray.from_arrays(lists, names=["terms", "counts"])], names=["n", "bow"])
    out = list(LD.pass_sums(iter([batch.slice(0, 11), batch.slice(11)]), weight, model.alpha, model.start))[0]
    want, logs = np.zeros_like(weight), np.zeros(10)
    for first, last in ((0, 11), (11, 30)):
        for rows, gamma, theta, term, share in LD.infer(terms, counts, ends[first:last + 1], weight, model.alpha, model.start):
            for i, row in enumerate(rows + first):
                n = ends[row + 1] - ends[row]
                np.add.at(want, term[i, :n], times[row] * share[i, :n, None] * theta[i] * weight[term[i, :n]])
                logs += times[row] * LD.log_mean(gamma[i])
    got = np.column_stack([out.column(2 + i).to_numpy() for i in range(10)]) / LD.POINT
    term = out.column(0).to_numpy()
    assert term[0] == -1 and out.column(1)[0].as_py() == times.sum() and np.allclose(got[0], logs, atol=1e-4)
    assert np.array_equal(term[1:], np.flatnonzero(want.any(1))) and np.allclose(got[1:], want[term[1:]], atol=1e-5)
