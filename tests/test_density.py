"""Density topics: graph recall, tree weight and clusters against brute force, hot and degenerate vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curio.operators import density as D
from curio.sources import bind as B


def vectors(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>")


def blobs(seed, centers, n, dim=16, spread=0.12):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centers, dim))
    x = np.concatenate([c[i] + spread * r.normal(size=(n, dim)) for i in range(centers)])
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.repeat(np.arange(centers), n)


def recall(graph, x, k):
    got = {}
    for r in graph.collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    kth = np.sort(d, axis=1)[:, k - 1]
    return np.mean([sum(d[i, j] <= kth[i] + 1e-9 for j in got.get(i, ())) / k for i in range(len(x))])


def test_knn_recall_on_the_embeddings(spark):
    from tests.conftest import SF_SMALL
    e = B.table(spark, SF_SMALL, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    vecs = D.unit_vectors(e).cache()
    rows = sorted(vecs.collect(), key=lambda r: r["id"])
    x = np.array([r["v"] for r in rows])
    at = {r["id"]: i for i, r in enumerate(rows)}
    graph = D.knn_graph(vecs, 10)
    assert graph.groupBy("src").count().where("count <> 10").isEmpty()
    names = spark.createDataFrame(list(at.items()), "src long, i long")
    local = graph.join(names, "src").join(names.select(F.col("src").alias("dst"), F.col("i").alias("j")), "dst").select(
        F.col("i").alias("src"), F.col("j").alias("dst"))
    got = recall(local, x, 10)
    print("recall", got, len(x))
    assert got >= 0.9


def prim(n, edges):
    """Total weight and number of edges of a minimum spanning forest (Kruskal)."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    total = count = 0
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        a, b = find(u), find(v)
        if a != b:
            root[a], total, count = b, total + w, count + 1
    return total, count, [find(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spanning_forest_equals_kruskal(spark, seed):
    r = np.random.default_rng(seed)
    pairs = {tuple(sorted(p)) for p in r.integers(0, 120, (260, 2)).tolist() if p[0] != p[1]}
    edges = [(u, v, float(w)) for (u, v), w in zip(sorted(pairs), r.integers(1, 6, len(pairs)))]  # many ties
    tree, roots = D.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double"))
    total, count, label = prim(120, edges)
    rows = tree.collect()
    assert len(rows) == count and sum(x["w"] for x in rows) == pytest.approx(total)
    got = {x["id"]: x["root"] for x in roots.collect()}
    assert set(got) == {i for e in edges for i in e[:2]}
    assert len({(got[i], label[i]) for i in got}) == len({got[i] for i in got}) == len({label[i] for i in got})


def test_density_topics_find_planted_clusters(spark):
    x, y = blobs(3, 5, 60)
    noise = np.random.default_rng(9).normal(size=(20, 16))
    emb = vectors(spark, np.concatenate([x, noise])).withColumnRenamed("v", "embedding").repartition(5)
    out = {r["id"]: r["topic"] for r in D.density_topics(emb).collect()}
    assert len(out) == 320
    groups = {}
    for i, c in enumerate(y.tolist()):
        groups.setdefault(c, set()).add(out[i])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 5


def test_density_topics_with_equal_vectors_and_few_rows(spark):
    same = np.tile([1.0, 0, 0], (400, 1))
    rest, _ = blobs(5, 2, 40, dim=3, spread=0.05)
    emb = vectors(spark, np.concatenate([same, rest])).withColumnRenamed("v", "embedding")
    emb = emb.union(spark.createDataFrame([(None, [1.0, 0.0, 0.0]), (9999, None)], emb.schema))
    out = D.density_topics(emb).collect()
    assert len(out) == 480 and len({r["topic"] for r in out if r["id"] < 400}) == 1
    tiny = vectors(spark, np.eye(3)[:2]).withColumnRenamed("v", "embedding")
    assert {r["topic"] for r in D.density_topics(tiny).collect()} == {0}
    assert D.density_topics(tiny.limit(0)).count() == 0


def test_descent_finds_every_better_pair_of_a_list_and_sends_no_vector_per_pair(spark):
    """``_near_pairs`` against brute force over the lists, with equal vectors, and no join of pairs with vectors."""
    r = np.random.default_rng(11)
    x = r.normal(size=(60, 8))
    x[40:52] = x[40]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    k = 4
    rows = []
    for i in range(60):
        for j in sorted(set(r.choice(60, 6)) - {i})[:k if i % 9 else 2]:
            rows.append((i, int(j), float(D._lengths(x[[i]], x[[int(j)]])[0])))
    graph = spark.createDataFrame(rows, "src long, dst long, dist double")
    own, lists = {i: [] for i in range(60)}, {i: set() for i in range(60)}
    for i, j, w in rows:
        own[i].append((w, j))
        lists[i].add((w, j))
        lists[j].add((w, i))
    want = set()
    for c, near in lists.items():
        members = [j for _, j in sorted(near)[:2 * k]]
        for a in members:
            for b in members:
                last = max(own[a]) if len(own[a]) >= k else (np.inf, 0)
                if a != b and (d[a, b] < last[0] - 1e-12 or (abs(d[a, b] - last[0]) <= 1e-12 and b < last[1])):
                    want.add((a, b))
    found = D._near_pairs(graph, vectors(spark, x), k)
    got = {(r["src"], r["dst"]): r["dist"] for r in found.collect()}
    assert set(got) == want and all(abs(d[a, b] - w) < 1e-12 for (a, b), w in got.items())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "zip_with" not in plan
