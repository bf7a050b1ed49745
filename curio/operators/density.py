"""Density topics: neighbour graph, spanning tree of mutual reachability, condensed-tree cut, topic vectors.

1. ``knn_graph``: rows are dealt into blocks of similar vectors several times (sign bits of random directions, then a
   projection) and compared within a block; neighbours of neighbours are then compared with each other
   (neighbour descent), the vectors of a list in one place. A block and a neighbour list have a fixed size, so no group grows with the data, also
   when a third of all vectors are equal.
2. ``spanning_tree``: edges weigh the larger of their length and both ends' core distances. Every component picks
   its least edge, picked edges merge components by pointer jumping, until none is left (Boruvka). All rounds are
   joins and aggregations; each is written to the shared folder.
3. ``condensed_clusters``: the tree is cut at ``levels`` quantiles of its weights, all levels in one run of the same
   contraction keyed by level. Components of at least ``min_size`` rows are the nodes of the condensed tree; those of
   largest excess of mass are the clusters.
4. ``density_topics``: a topic's vector is the mean of its cluster; every row goes to its nearest topic vector.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import topics as TP

NEIGHBOURS, TABLES, BLOCK, ROUNDS = 15, 6, 128, 2
MIN_SIZE, LEVELS = 15, 12


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unit_vectors(emb: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors of length 1 (a zero vector stays); distance then orders like cosine. Null vectors are left out."""
    v = F.col(vec_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return emb.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0)).alias("v"))


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` and ``b``; a pair has the same one in every task and direction."""
    d = a - b
    return np.sqrt((d * d).sum(1))


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row; a row's list is cut map-side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return edges.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def _block_edges(vecs: DataFrame, k: int, tables: int, block: int, seed: int) -> DataFrame:
    """(src, dst, dist): each row's k nearest within its block of every table."""
    first = vecs.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n, dim = first["n"], first["d"] or 1
    bits = min(62, max(0, math.ceil(math.log2(max(1, n / block)))))
    kind = vecs.schema["id"].dataType.simpleString()
    planes = [np.random.default_rng([seed, t]).normal(size=(dim, bits + 1)) for t in range(tables)]

    def deal(batches):
        for p in batches:
            if not len(p):
                continue
            x = np.stack(p["v"].to_numpy())
            for t, w in enumerate(planes):
                z = x @ w
                code = (z[:, :bits] > 0).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(p), np.int64)
                yield pd.DataFrame({"t": t, "code": code, "z": z[:, bits], "id": p["id"], "v": p["v"]})

    def compare(batches):
        def done(b):
            x = np.stack(b["v"].to_numpy())
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T))
            np.fill_diagonal(d, np.inf)
            m = min(k, len(b) - 1)
            near = np.argsort(d, axis=1, kind="stable")[:, :m].ravel()
            ids = b["id"].to_numpy()
            row = np.repeat(np.arange(len(b)), m)
            return pd.DataFrame({"src": ids[row], "dst": ids[near], "dist": _lengths(x[row], x[near])})
        held = None
        for p in batches:  # sorted: cut into blocks of one table
            held = p if held is None else pd.concat([held, p], ignore_index=True)
            while len(held) >= 2 * block or (len(held) and held["t"].iloc[0] != held["t"].iloc[-1]):
                same = int((held["t"] == held["t"].iloc[0]).sum())
                size = block if same >= 2 * block else same
                if size > 1:
                    yield done(held.iloc[:size])
                held = held.iloc[size:].reset_index(drop=True)
        if held is not None and len(held) > 1:
            yield done(held)

    dealt = vecs.mapInPandas(deal, f"t int, code long, z double, id {kind}, v array<double>")
    order = ["t", "code", "z", "id"]
    return dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(compare, f"src {kind}, dst {kind}, dist double")


def _near_pairs(graph: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist) of rows that stand in one list (2 k at most, both directions) and would enter src's list of k.

    A list's vectors are sent to one place and compared there, so that a row's vector travels once a list and not once
    a pair; with it goes the last entry of its own list, and only pairs that beat it leave the task.
    """
    kind = vecs.schema["id"].dataType.simpleString()
    both = graph.union(graph.select("dst", "src", "dist")).distinct()
    lists = _nearest(both, 2 * k).select(F.col("src").alias("c"), F.col("dst").alias("id"))
    last = graph.groupBy("src").agg(F.count("*").alias("_n"), F.max(F.struct("dist", "dst")).alias("_e"))
    last = last.select(F.col("src").alias("id"), F.when(F.col("_n") >= k, F.col("_e.dist")).otherwise(float("inf")).alias("reach"),
                       F.col("_e.dst").alias("last"))
    ends = lists.join(vecs.join(last, "id"), "id").repartition("c").sortWithinPartitions("c", "id")

    def pairs(p):
        c, ids, reach, end = (p[x].to_numpy() for x in ("c", "id", "reach", "last"))
        x = np.stack(p["v"].to_numpy())
        begin = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
        size = np.diff(np.r_[begin, len(c)])
        group, at = np.repeat(np.arange(len(size)), size), np.arange(len(c)) - np.repeat(begin, size)
        row = np.full((len(size), size.max()), -1)
        row[group, at] = np.arange(len(c))
        y = np.zeros((*row.shape, x.shape[1]))
        y[group, at] = x
        sq = (y * y).sum(2)
        rough = sq[:, :, None] + sq[:, None, :] - 2 * y @ y.transpose(0, 2, 1)
        bound = np.where(row >= 0, reach[row] ** 2 + 1e-9, -np.inf)
        rough[(row < 0)[:, None, :] | np.eye(row.shape[1], dtype=bool)] = np.inf
        g, i, j = np.nonzero((rough <= bound[:, :, None]) & (rough < np.inf))
        a, b = row[g, i], row[g, j]
        d = _lengths(x[a], x[b])
        keep = d < reach[a]
        tie = np.flatnonzero(d == reach[a])
        keep[tie] = ids[b[tie]] < end[a[tie]]
        return pd.DataFrame({"src": ids[a[keep]], "dst": ids[b[keep]], "dist": d[keep]})

    def compare(batches):
        held = None
        for p in batches:  # sorted by list: the last one may go on in the next batch
            held = p if held is None or not len(held) else pd.concat([held, p], ignore_index=True)
            if len(held):
                c = held["c"].to_numpy()
                whole = np.flatnonzero(c != c[-1])
                cut = whole[-1] + 1 if len(whole) else 0
                if cut:
                    yield pairs(held.iloc[:cut])
                    held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield pairs(held)

    return ends.mapInPandas(compare, f"src {kind}, dst {kind}, dist double")


def knn_graph(vecs: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES, block: int = BLOCK, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(src, dst, dist): about the k nearest other rows of every row of (id, v).

    Blocks are cut from sampled ranges, so a rare neighbour may differ between runs; lists are written once and reread.
    """
    # all of a row's candidates go to one place by its id and are told apart there
    first = _block_edges(vecs, k, tables, block, seed).repartition("src").distinct()
    graph = _written(_nearest(first, k), "knn")
    for _ in range(rounds):
        more = graph.union(_near_pairs(graph, vecs, k)).repartition("src").distinct()
        graph = _written(_nearest(more, k), "knn")
    return graph


def reachability(graph: DataFrame, samples: int) -> DataFrame:
    """(u, v, w) with u < v: w is the largest of the length and both ends' distance to their ``samples``-th neighbour."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    core = graph.withColumn("_n", rank).where(F.col("_n") <= samples).groupBy("src").agg(F.max("dist").alias("core"))
    e = graph.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "dist").distinct()
    return (e.join(core.select(F.col("src").alias("u"), F.col("core").alias("_cu")), "u")
            .join(core.select(F.col("src").alias("v"), F.col("core").alias("_cv")), "v")
            .select("u", "v", F.greatest("dist", "_cu", "_cv").alias("w")))


def spanning_forest(edges: DataFrame, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree, roots): the minimum spanning forest (u, v, w) and (id, root) of every row with an edge, per ``key``.

    Edges are ordered by (w, u, v), so picked edges close no cycle beyond two components picking the same edge.
    """
    by = [key] if key else []
    tree, maps = [], []
    live = _written(edges.select(*by, F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"), "forest-edges")
    while not live.isEmpty():
        both = live.union(live.select(*by, F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "w"))
        best = _written(both.groupBy(*by, "a").agg(F.min(F.struct("w", "u", "v", "b")).alias("e")), "forest-picked")
        tree.append(best.select(*by, "e.u", "e.v", "e.w").distinct())
        # of two components that pick the same edge the smaller one is the root
        other = best.select(*by, F.col("a").alias("_b"), F.col("e.b").alias("_back"))
        on = [F.col("p.e.b") == F.col("o._b")] + [F.col(f"p.{c}") == F.col(f"o.{c}") for c in by]
        up = (best.alias("p").join(other.alias("o"), on)
              .select(*[F.col(f"p.{c}") for c in by], F.col("p.a").alias("a"),
                      F.when((F.col("o._back") == F.col("p.a")) & (F.col("p.a") < F.col("p.e.b")), F.col("p.a")).otherwise(F.col("p.e.b")).alias("r")))
        up = _written(up, "forest-up")
        while True:
            step = up.select(*by, F.col("a").alias("r"), F.col("r").alias("_next"))
            jumped = _written(up.join(step, [*by, "r"]).select(*by, "a", F.col("_next").alias("r"), (F.col("_next") != F.col("r")).alias("_moved")), "forest-up")
            up = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        maps.append(up)
        left = up.select(*by, "a", F.col("r").alias("_ra"))
        right = up.select(*by, F.col("a").alias("b"), F.col("r").alias("_rb"))
        e = live.join(left, [*by, "a"]).join(right, [*by, "b"]).where("_ra <> _rb")
        ends = [*by, F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")]
        live = _written(e.select(*ends, F.struct("w", "u", "v").alias("e")).groupBy(*by, "a", "b").agg(F.min("e").alias("e"))
                        .select(*by, "a", "b", "e.u", "e.v", "e.w"), "forest-edges")
    nodes = edges.select(*by, F.col("u").alias("id")).union(edges.select(*by, "v")).distinct()
    roots = nodes.withColumn("root", F.col("id"))
    for up in maps:
        roots = roots.join(up.select(*by, F.col("a").alias("root"), F.col("r").alias("_r")), [*by, "root"], "left").select(
            *by, "id", F.coalesce("_r", "root").alias("root"))
    out = edges.select(*by, "u", "v", "w").limit(0)
    for t in tree:
        out = out.union(t)
    return _written(out, "forest"), _written(roots, "forest-roots")


def condensed_clusters(tree: DataFrame, min_size: int = MIN_SIZE, levels: int = LEVELS) -> DataFrame:
    """(id, cluster): rows of the clusters of largest excess of mass; the rest is noise and not returned."""
    at = [i / levels for i in range(1, levels + 1)]
    cuts = sorted(set(tree.agg(F.percentile_approx("w", at, 10_000).alias("q")).first()["q"] or []))
    if not cuts:
        return tree.select(F.col("u").alias("id"), F.col("u").alias("cluster")).limit(0)
    spread = F.array(*[F.lit(float(c)) for c in cuts])
    keyed = tree.select(F.posexplode(spread).alias("level", "_cut"), "u", "v", "w").where("w <= _cut").drop("_cut")
    _, roots = spanning_forest(keyed, "level")
    nodes = roots.groupBy("level", "root").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    parent = roots.select((F.col("level") - 1).alias("level"), F.col("id").alias("root"), F.col("root").alias("up"))
    nodes = _written(nodes.join(parent, ["level", "root"], "left"), "condensed")
    # density gained between a level and the next one; the loosest level counts down to zero density
    dens = [1 / max(c, 1e-9) for c in cuts] + [0.0]
    below = None
    chosen = []
    for i in range(len(cuts)):
        here = nodes.where(F.col("level") == i).withColumn("own", F.col("size") * F.lit(dens[i] - dens[i + 1]))
        if below is not None:
            kids = below.groupBy(F.col("up").alias("root")).agg(F.count("*").alias("kids"), F.sum("best").alias("apart"), F.max("mass").alias("one"))
            here = here.join(kids, "root", "left")
            mass = F.col("own") + F.when(F.col("kids") == 1, F.col("one")).otherwise(0.0)
            here = here.withColumn("mass", mass).withColumn("apart", F.coalesce("apart", F.lit(0.0)))
        else:
            here = here.withColumn("mass", F.col("own")).withColumn("apart", F.lit(0.0))
        here = here.select("level", "root", "up", "mass", F.greatest("mass", "apart").alias("best"), (F.col("mass") >= F.col("apart")).alias("take"))
        below = _written(here, "condensed-level")
        chosen.append(below.where("take").select("level", "root"))
    picked = chosen[0]
    for c in chosen[1:]:
        picked = picked.union(c)
    # the highest chosen node above a row is its cluster
    top = roots.join(picked, ["level", "root"]).groupBy("id").agg(F.max(F.struct("level", "root")).alias("c"))
    return top.select("id", F.concat_ws(":", "c.level", "c.root").alias("cluster"))


def density_topics(emb: DataFrame, id_col: str = "id", vec_col: str = "embedding", k: int = NEIGHBOURS, samples: int = 5,
                   min_size: int = MIN_SIZE, levels: int = LEVELS, seed: int = 1) -> DataFrame:
    """(id, topic, similarity): every row at the topic vector most similar to it; topics are numbered by size.

    Without any cluster all rows are one topic. Rows without a vector or id are left out.
    """
    vecs = _written(unit_vectors(emb, id_col, vec_col), "unit-vectors")
    if vecs.isEmpty():
        return vecs.select(F.col("id").alias(id_col), F.lit(0).alias("topic"), F.lit(0.0).alias("similarity"))
    tree, _ = spanning_forest(reachability(knn_graph(vecs, k, seed=seed), samples))
    members = _written(condensed_clusters(tree, min_size, levels), "density-members")
    if members.isEmpty():
        members = vecs.select("id", F.lit("all").alias("cluster"))
    dim = vecs.agg(F.max(F.size("v"))).first()[0] or 1
    cents = TP.centroids(members.join(vecs, "id"), "cluster", "v", dim)
    number = F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1  # a row per topic
    cents = _written(cents.withColumn("topic", number).drop("cluster"), "topic-vectors")
    return TP.nearest_centroid(vecs, cents, "topic", "v", "id").withColumnRenamed("id", id_col)
