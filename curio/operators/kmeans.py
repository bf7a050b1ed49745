"""Many k-means and bisecting k-means fits at once, by passes over cached blocks of vectors.

A pass takes every block once for all fits and sends back sums, so the number of Spark jobs does not depend on the
number of fits. Vectors are compared in fixed point: the sums of a block are whole numbers below 2^53 and those of a
table below 2^63, so centres do not depend on the order of tasks. A row's draws come from its id alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the largest number of all vectors in fixed point.
POINT_BITS = 30
#: Distances that a task holds at a time.
CELLS = 1 << 21
#: Fewest and most tasks of a pass, for each core.
LEAST_PER_CORE, MOST_PER_CORE = 1, 4
#: Rounds in which candidates for the first centres are drawn, candidates of a round for each centre, steps of their reduction to k.
DRAW_ROUNDS, OVERSAMPLING, REDUCE_STEPS = 2, 2, 30
#: Movement of a centre under which a fit is settled.
TOLERANCE = 1e-4
#: How far the two first centres of a split stand from their mean, of its size; deepest level of splits.
SPLIT, LEVELS = 1e-4, 62
#: Share of a cluster's squares under which its spread is rounding.
NO_SPREAD = 1e-12


def matrix(vectors: pa.Array) -> np.ndarray:
    """(rows, dim) of a list column without gaps."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = x.reshape(len(vectors), -1) if len(vectors) else x.reshape(0, 0)
    if vectors.null_count or len(np.unique(vectors.value_lengths())) > 1 or not np.isfinite(x).all():
        raise ValueError("vectors must be of one length and hold finite numbers")
    return x


def uniforms(rows: np.ndarray, start: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each row's number (splitmix64)."""
    with np.errstate(over="ignore"):
        salt = np.uint64(start & (1 << 64) - 1) * np.uint64(0xD1342543DE82EF95) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)
        z = rows.view(np.uint64) + salt
        for _ in range(2):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(float) * 2.0 ** -53


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, squared distance) of each row under each fit, both (rows, fits); ``centres`` (fits, k, dim), ties to the lowest."""
    fits, k, dim = centres.shape
    flat = centres.reshape(-1, dim)
    size = (flat * flat).sum(1)
    at, least = np.empty((len(x), fits), np.int64), np.empty((len(x), fits))
    step = max(1, CELLS // (fits * k))
    for i in range(0, len(x), step):
        part = x[i:i + step]
        far = (size - 2 * (part @ flat.T)).reshape(len(part), fits, k)
        best = far.argmin(2)
        at[i:i + step] = best
        least[i:i + step] = np.take_along_axis(far, best[:, :, None], 2)[:, :, 0] + (part * part).sum(1)[:, None]
    return at, np.maximum(least, 0)


def group_sums(x: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums) of the groups 0..n-1; rows of other groups are left out."""
    own = (group >= 0) & (group < n)
    member = np.zeros((n, len(x)))
    member[group[own], np.flatnonzero(own)] = 1
    return np.bincount(group[own], minlength=n), np.rint(member @ x).astype(np.int64)


class Blocks:
    """The vectors of a table as cached matrices, with a number of each row's id; released at the end of a ``with``."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str):
        rows = df.select(F.xxhash64(id_col).alias("h"), F.col(vec_col).cast("array<double>").alias("v"))
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = rows.rdd.getNumPartitions()
        rows = rows.repartition(cores) if n < LEAST_PER_CORE * cores else rows.coalesce(MOST_PER_CORE * cores)

        def pack(batches):
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()]), pa.array([x.tobytes()]), pa.array([x.shape[1]])],
                                                     names=["h", "v", "dim"])

        # an RDD: a pass over it is a job without a plan
        self.rdd = (rows.mapInArrow(pack, "h binary, v binary, dim long").rdd.map(lambda r: (bytes(r["h"]), bytes(r["v"]), r["dim"]))
                    .persist(StorageLevel.MEMORY_AND_DISK))
        self.scale = 1.0
        seen = self.run(lambda h, x: ([x.shape[1]], [float(np.abs(x).max(initial=0))]), whole=False)
        dims, most = seen or ([], [])
        if len(set(dims)) > 1:
            raise ValueError("vectors must be of one length and hold finite numbers")
        self.dim = dims[0] if dims else 0
        if max(most, default=0) > 0:
            self.scale = 2.0 ** (POINT_BITS - int(np.ceil(np.log2(max(most)))))

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.rdd.unpersist()

    def run(self, of_block, whole: bool = True) -> tuple | None:
        """One pass: the tuples that ``of_block(row numbers, vectors in fixed point)`` gives, added up part by part (arrays are
        summed, lists strung together); nothing for an empty table."""
        scale = self.scale

        def task(blocks):
            out = None
            for h, v, dim in blocks:
                x = np.frombuffer(v).reshape(len(h) // 8, dim)
                got = of_block(np.frombuffer(h, np.int64), np.rint(x * scale) if whole else x)
                out = got if out is None else tuple(a + c for a, c in zip(out, got))
            return [] if out is None else [out]

        out = None
        for got in self.rdd.mapPartitions(task).collect():
            out = got if out is None else tuple(a + c for a, c in zip(out, got))
        return out


def assign(df: DataFrame, id_col: str, vec_col: str, seeds: list[int], clusters, scale: float, out: str, keep: list[str] = ()) -> DataFrame:
    """(seed, id, kept columns, ``out``): a row for each seed with the cluster that ``clusters(vectors in fixed point)`` (rows, seeds) gives."""
    cols = [id_col, *keep]

    def task(batches):
        for b in batches:
            if b.num_rows:
                at = clusters(np.rint(matrix(b.column(len(cols))) * scale)).astype(np.int32)
                for i, seed in enumerate(seeds):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, seed, np.int64)), *[b.column(j) for j in range(len(cols))], pa.array(at[:, i])],
                                                     names=["seed", *cols, out])

    kept = df.select(*cols).schema.fields
    schema = T.StructType([T.StructField("seed", T.LongType()), *kept, T.StructField(out, T.IntegerType())])
    return df.select(*cols, F.col(vec_col).cast("array<double>").alias("_v")).mapInArrow(task, schema)


# --- k-means ----------------------------------------------------------------------------------

def reduced(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of weighted points: drawn by weight and squared distance, then moved by plain steps."""
    def draw(odds: np.ndarray) -> int:
        ends = np.cumsum(odds)
        return int(min(np.searchsorted(ends, rng.random() * ends[-1], side="right"), len(odds) - 1))

    centres = points[[draw(weight)]]
    while len(centres) < k:
        odds = weight * nearest(points, centres[None])[1][:, 0]
        centres = np.vstack([centres, points[draw(odds if odds.sum() > 0 else weight)]])
    before = None
    for _ in range(REDUCE_STEPS):
        at = nearest(points, centres[None])[0][:, 0]
        if before is not None and (at == before).all():
            break
        before = at
        for c in range(k):
            own = at == c
            mass = weight[own].sum()
            centres[c] = (weight[own, None] * points[own]).sum(0) / mass if mass > 0 else points[rng.integers(len(points))]
    return centres


def first_centres(blocks: Blocks, k: int, starts: list[int]) -> list[np.ndarray]:
    """Up to k centres of each start: a row drawn evenly, then rounds of candidates drawn by their squared distance from those
    before, at last the candidates, weighted by the rows nearest to them, reduced to k."""
    def lowest(h, x):
        u = [uniforms(h, s, 0) for s in starts]
        return tuple([(float(y.min()), x[y.argmin()].tolist())] for y in u)

    found = [np.array([min(got)[1]]) for got in blocks.run(lowest)]
    for turn in range(1, DRAW_ROUNDS + 1):
        cost, = blocks.run(lambda h, x: (np.array([nearest(x, c[None])[1].sum() for c in found]),))

        def drawn(h, x):
            out = []
            for s, c, total in zip(starts, found, cost):
                odds = OVERSAMPLING * k * nearest(x, c[None])[1][:, 0] / total if total > 0 else np.zeros(len(x))
                out.append([x[uniforms(h, s, turn) < odds]])
            return tuple(out)

        found = [np.unique(np.vstack([c, *more]), axis=0) for c, more in zip(found, blocks.run(drawn))]
    weights = blocks.run(lambda h, x: tuple(np.bincount(nearest(x, c[None])[0][:, 0], minlength=len(c)) for c in found))
    return [c if len(c) <= k else reduced(c, w.astype(float), k, np.random.default_rng([s & (1 << 63) - 1, 1])) for s, c, w in zip(starts, found, weights)]


def kmeans(blocks: Blocks, k: int, starts: list[int], max_iter: int) -> dict[int, tuple[float, np.ndarray]]:
    """(cost, centres in fixed point) of each start: the sum of squared distances of all rows from their centres."""
    if not blocks.dim:
        return {s: (0.0, np.zeros((1, 1))) for s in starts}
    centres = dict(zip(starts, first_centres(blocks, k, starts)))
    moving = list(starts)

    def stacked(of: list[int]) -> np.ndarray:
        # a start with fewer centres repeats its first one: ties go to the lowest
        return np.stack([np.vstack([centres[s], np.repeat(centres[s][:1], k - len(centres[s]), axis=0)]) for s in of])

    for _ in range(max_iter):
        now = stacked(moving)

        def step(h, x, now=now):
            at, _ = nearest(x, now)
            parts = [group_sums(x, at[:, i], now.shape[1]) for i in range(len(now))]
            return np.stack([n for n, _ in parts]), np.stack([t for _, t in parts])

        n, total = blocks.run(step)
        still = []
        for i, s in enumerate(moving):
            own = np.arange(len(centres[s]))
            new = np.where(n[i, own, None] > 0, total[i, own] / np.maximum(n[i, own, None], 1), centres[s])
            if (((new - centres[s]) ** 2).sum(1) > (TOLERANCE * blocks.scale) ** 2).any():
                still.append(s)
            centres[s] = new
        moving = still
        if not moving:
            break
    last = stacked(starts)
    cost, = blocks.run(lambda h, x: (nearest(x, last)[1].sum(0),))
    return {s: (float(c), centres[s]) for s, c in zip(starts, cost)}


# --- bisecting k-means --------------------------------------------------------------------------

@dataclass
class Node:
    """Rows, their sum and their sum of squares."""

    size: int
    total: np.ndarray
    squares: float

    @property
    def centre(self) -> np.ndarray:
        return self.total / self.size

    @property
    def spread(self) -> float:
        return max(self.squares - float((self.centre * self.total).sum()), 0.0)


def side(left: np.ndarray | None, right: np.ndarray | None, dim: int) -> tuple[np.ndarray, float]:
    """(direction, limit): a row goes right if its product with the direction is above the limit; a missing side gets none."""
    if left is None or right is None:
        return np.zeros(dim), 0.0 if right is None else -1.0
    return 2 * (right - left), float((right * right).sum() - (left * left).sum())


class Tree:
    """Splits by level: node numbers ascending, with the centres of their two sides (children 2i and 2i + 1, root 1)."""

    def __init__(self, dim: int):
        self.dim, self.levels = dim, []

    def add(self, splits: dict[int, tuple]) -> None:
        nodes = sorted(splits)
        rules = [side(*splits[i], self.dim) for i in nodes]
        self.levels.append((np.array(nodes, np.int64), np.array([w for w, _ in rules]), np.array([b for _, b in rules])))

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        node = np.ones(len(x), np.int64)
        for nodes, way, limit in self.levels:
            at = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
            hit = np.flatnonzero(nodes[at] == node)
            right = x[hit] @ way.T > limit
            node[hit] = 2 * node[hit] + right[np.arange(len(hit)), at[hit]]
        return node


class Bisection:
    """A fit: the nodes so far, the centres that rows were dealt by, the leaves still wanted."""

    def __init__(self, root: Node, k: int, seed: int, dim: int):
        self.nodes, self.active, self.wanted, self.dim = {1: root}, [1], k - 1, dim
        self.rng = np.random.default_rng(seed & (1 << 63) - 1)
        self.dealt, self.splits = Tree(dim), []      # the last holds (node, children met)
        self.sides: dict[int, tuple] = {}

    def begin(self, level: int) -> bool:
        """Choose the clusters of this level to be split: those with a spread, the largest if too many."""
        able = [i for i in self.active if self.nodes[i].spread > NO_SPREAD * self.nodes[i].squares] if level < LEVELS else []
        able = sorted(able, key=lambda i: (-self.nodes[i].size, i))[:max(self.wanted, 0)]
        self.sides = {}
        for i in sorted(able):
            c = self.nodes[i].centre
            reach = np.linalg.norm(c) or (self.nodes[i].spread / self.nodes[i].size) ** 0.5
            way = SPLIT * reach * self.rng.random(self.dim)
            self.sides[i] = (c - way, c + way)
        return bool(able)

    def trial(self) -> Tree:
        out = Tree(self.dim)
        out.levels = list(self.dealt.levels)
        out.add(self.sides)
        return out

    def learn(self, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> bool:
        """Take a pass's sums of all children; whether a centre has moved."""
        self.met, new = {}, {}
        for j, i in enumerate(sorted(self.sides)):
            for c in (2 * j, 2 * j + 1):
                if n[c]:
                    self.met[2 * i + c % 2] = Node(int(n[c]), total[c].astype(float), float(squares[c]))
            new[i] = tuple(self.met[c].centre if c in self.met else None for c in (2 * i, 2 * i + 1))
        same = all(a is b or a is not None and b is not None and np.array_equal(a, b) for i in new for a, b in zip(new[i], self.sides[i]))
        self.before, self.sides = self.sides, new
        return not same

    def end(self) -> None:
        """Keep the level: rows stay where the last pass dealt them."""
        self.dealt.add(self.before)
        self.nodes.update(self.met)
        self.splits.append(dict(self.sides))
        self.wanted -= len(self.before)
        self.active, self.sides = sorted(self.met), {}

    def leaves(self) -> tuple[Tree, np.ndarray]:
        """(tree by the centres of the clusters, its leaves from left to right)."""
        tree, parents = Tree(self.dim), set()
        for level in self.splits:
            tree.add(level)
            parents |= set(level)
        out, todo = [], [1]
        while todo:
            i = todo.pop()
            if i in parents:
                todo += [c for c in (2 * i + 1, 2 * i) if c in self.nodes]
            else:
                out.append(i)
        return tree, np.array(out, np.int64)


def bisecting(blocks: Blocks, k: int, seeds: list[int], max_iter: int) -> list[tuple[Tree, np.ndarray]]:
    """(tree, leaves) of each seed: clusters are split in two, all of a level at once, until there are k."""
    if not blocks.dim:
        return [(Tree(1), np.array([1])) for _ in seeds]
    n, total, squares = blocks.run(lambda h, x: (np.array([len(x)]), np.rint(x.sum(0)).astype(np.int64), np.array([(x * x).sum()])))
    fits = [Bisection(Node(int(n[0]), total.astype(float), float(squares[0])), k, s, blocks.dim) for s in seeds]
    for level in range(LEVELS + 1):
        open_ = [f for f in fits if f.begin(level)]
        if not open_:
            break
        moving = list(open_)
        for _ in range(max_iter):
            trials = [(f.trial(), np.array(sorted(f.sides), np.int64)) for f in moving]

            def step(h, x, trials=trials):
                out, size = [], (x * x).sum(1)
                for tree, nodes in trials:
                    node = tree.descend(x)
                    at = np.minimum(np.searchsorted(nodes, node // 2), len(nodes) - 1)
                    group = np.where(nodes[at] == node // 2, 2 * at + node % 2, -1)
                    m = 2 * len(nodes)
                    out += [*group_sums(x, group, m), np.bincount(group + 1, size, m + 1)[1:]]
                return tuple(out)

            got = blocks.run(step)
            moving = [f for i, f in enumerate(moving) if f.learn(*got[3 * i:3 * i + 3])]
            if not moving:
                break
        for f in open_:
            f.end()
    return [f.leaves() for f in fits]


def leaf_numbers(trees: list[tuple[Tree, np.ndarray]]):
    """Function (vectors in fixed point) -> (rows, trees): the leaf that each row comes to."""
    def of(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(trees)), np.int64)
        for i, (tree, leaves) in enumerate(trees):
            order = np.argsort(leaves)
            out[:, i] = order[np.searchsorted(leaves[order], tree.descend(x))]
        return out
    return of
