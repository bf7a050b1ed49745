"""Numpy steps of the online LDA in ``topics``: topics of documents on a batch of term counts, and the model they sum up to.

A document's topic weights are the fixed point of one update. Documents of like length stand in one padded block, so
an update is two products for all of them, and steps are lengthened along the last two updates (squared
extrapolation): with topics that are still nearly equal the plain update needs hundreds of rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Largest mean change of a document's topic weights by a plain update at which it is settled.
TOLERANCE = 1e-3
#: Shape of the Gamma draws (mean 1) that topics and documents start from.
GAMMA_SHAPE = 100.0
#: Term counts in a block of documents (a longer document goes alone): enough documents that an update's work outweighs its calls.
BLOCK = 1 << 16
#: Updates after which a document goes on by plain updates, which never lower the bound.
LONG_STEPS = 300
#: Updates after which steps are taken by the update's slope (Newton).
SHORT_STEPS = 12
#: Most that such a step lengthens a change.
MOST_LEAP = 1000.0
#: Updates after which a fit is given up with an error (numbers that are none).
MOST_STEPS = 1 << 20
#: Fixed point of a task's sums: added as integers they do not depend on the order of tasks.
POINT = 1 << 24
#: Terms of a packed range of a task's sums, and the columns of such a row.
RANGE = 1 << 13
PACKED = "fit int, first int, n long, terms binary, vals binary"
#: Learning offset and decay of the online fit.
OFFSET, DECAY = 1024.0, 0.51


@dataclass
class TopicModel:
    """Term weights (n_terms, k) and the prior of a document's topics (k)."""

    weight: np.ndarray
    alpha: np.ndarray
    seed: int

    @classmethod
    def begin(cls, n_terms: int, k: int, seed: int) -> TopicModel:
        draw = np.random.default_rng(seed).gamma(GAMMA_SHAPE, 1 / GAMMA_SHAPE, (n_terms, k))
        return cls(draw, np.full(k, 1 / k), seed)

    @property
    def start(self) -> np.ndarray:
        """Topic weights that every document starts from."""
        return np.random.default_rng([self.seed, 1]).gamma(GAMMA_SHAPE, 1 / GAMMA_SHAPE, len(self.alpha))

    def term_weights(self, terms: np.ndarray | None = None) -> np.ndarray:
        """What a topic is expected to give a term: exp of the expected logarithm, (terms, k). Taken by ranges of terms: the
        driver holds no other table of that size."""
        out = self.weight.copy() if terms is None else self.weight[terms]
        total = digamma(self.weight.sum(0))
        for i in range(0, len(out), RANGE):
            out[i:i + RANGE] = np.exp(digamma(out[i:i + RANGE]) - total)
        return out

    def learn(self, turn: int, sums: np.ndarray, scale: float, logs: np.ndarray, n: float) -> None:
        """Blend in one pass (from 1): expected counts by term and topic (the table is used up), and the sum of the documents'
        log topic shares."""
        rate = (OFFSET + turn) ** -DECAY
        sums *= scale
        sums += 1 / len(self.alpha)
        sums *= rate
        self.weight *= 1 - rate
        self.weight += sums
        if n:
            slope = n * (logs / n - log_mean(self.alpha))
            c, q = n * trigamma(self.alpha.sum()), -n * trigamma(self.alpha)
            step = -(slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
            if (self.alpha + rate * step > 0).all():
                self.alpha = self.alpha + rate * step


def digamma(x: np.ndarray) -> np.ndarray:
    """For numbers above 0: the asymptotic series six places on; the six reciprocals between stand in three pairs of like sum."""
    y = x + 6.0
    r = 1.0 / y
    f = r * r
    t = x * (x + 5.0)
    out = np.log(y) - 0.5 * r - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
    return out - (x + y - 1.0) * (1.0 / t + 1.0 / (t + 4.0) + 1.0 / (t + 6.0))


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    f = 1.0 / (y * y)
    out = 1.0 / y + f / 2 + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f * (1 / 30 - f * 5 / 66))))
    for i in range(6):
        out += 1.0 / (x + i) ** 2
    return out


def log_mean(x: np.ndarray) -> np.ndarray:
    """Expected logarithm of each part of Dirichlet draws; the parts are the last axis."""
    return digamma(x) - digamma(x.sum(-1, keepdims=True))


def blocks(sizes: np.ndarray):
    """Rows of non-empty documents in blocks of like size: a block is padded to its longest, by at most a fifth or 8."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        least = sizes[order[0]]
        n = int(np.searchsorted(sizes[order], max(least * 6 // 5, least + 8), side="right"))
        n = min(n, max(1, BLOCK // int(sizes[order[n - 1]])))
        yield order[:n]
        order = order[n:]


def leap(gamma: np.ndarray, change: np.ndarray, theta: np.ndarray, weight: np.ndarray, share: np.ndarray, count: np.ndarray,
         alpha: np.ndarray) -> np.ndarray:
    """A Newton step to where the update changes nothing. The update's slope is similar to a symmetric matrix, so its
    slow directions are its eigenvectors; where the update moves away (1 and above), the step follows it."""
    each = np.divide(share * share, count, out=np.zeros_like(share), where=count > 0)
    mixed = np.matmul(weight * each[:, None, :], weight.transpose(0, 2, 1)) * theta[:, :, None] * theta[:, None, :]
    slope = -mixed
    k = np.arange(gamma.shape[1])
    slope[:, k, k] += gamma + change - alpha
    root = np.sqrt(trigamma(gamma))
    values, axes = np.linalg.eigh(slope * root[:, :, None] * root[:, None, :])
    along = np.matmul((change * root)[:, None, :], axes)[:, 0, :] / np.maximum(np.abs(1 - values), 1 / MOST_LEAP)
    far = gamma + np.matmul(axes, along[:, :, None])[:, :, 0] / root
    return np.maximum(far, alpha + 0.1 * (gamma - alpha))


def settle(weight: np.ndarray, count: np.ndarray, alpha: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Topic weights (documents, k) at the fixed point, from ``weight`` (documents, k, places) of the terms and their
    ``count`` (documents, places; padding 0)."""
    done = np.empty((len(count), len(alpha)))
    row, closed = np.arange(len(count)), np.zeros(len(count), bool)
    now = np.tile(start, (len(count), 1))
    before = step = None
    for turn in range(MOST_STEPS):
        theta = np.exp(log_mean(now))
        share = count / (np.matmul(theta[:, None, :], weight)[:, 0, :] + 1e-100)
        new = theta * np.matmul(weight, share[:, :, None])[:, :, 0] + alpha
        change = new - now
        met = ~closed & (np.abs(change).mean(1) <= TOLERANCE)
        if met.any():
            done[row[met]] = new[met]
            closed |= met
            if closed.all():
                return done
            if closed.sum() * 3 > len(row):
                go = ~closed
                row, closed, new, now, change = row[go], closed[go], new[go], now[go], change[go]
                theta, share, weight, count = theta[go], share[go], weight[go], count[go]
                if step is not None:
                    before, step = before[go], step[go]
        if turn >= LONG_STEPS or turn >= SHORT_STEPS and turn % 2:
            now = new
        elif turn >= SHORT_STEPS:
            now = leap(now, change, theta, weight, share, count, alpha)
        elif step is None:
            before, step, now = now, change, new
        else:
            bend = change - step
            length = np.sqrt((step * step).sum(1) / np.maximum((bend * bend).sum(1), 1e-300))
            length = np.maximum(length, 1.0)[:, None]
            far = before + 2 * length * step + length * length * bend
            now = np.where((far >= alpha).all(1)[:, None], far, new)
            step = None
    raise ArithmeticError(f"topic weights of {len(row)} documents do not settle")


def met_terms(terms: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms ascending, place of each of ``terms`` among them): a batch's weights and sums are a small table."""
    place = np.zeros(n_terms, np.int64)
    place[terms] = 1
    met = np.flatnonzero(place)
    place[met] = np.arange(len(met))
    return met, place[terms]


def infer(terms: np.ndarray, counts: np.ndarray, ends: np.ndarray, weight: np.ndarray, alpha: np.ndarray, start: np.ndarray):
    """Yields (rows, topic weights, terms, shares) by block; ``ends`` has n + 1 places of the documents in ``terms`` and
    ``counts``, ``weight`` (terms, k). A document's share of a term is its count by what its topics expect of the term."""
    sizes = np.diff(ends)
    for rows in blocks(sizes):
        width = int(sizes[rows].max())
        place = np.arange(width)
        held = place < sizes[rows][:, None]
        at = np.where(held, ends[rows][:, None] + place, 0)
        term = np.where(held, terms[at], 0)
        count = np.where(held, counts[at], 0).astype(float)
        w = np.ascontiguousarray(weight[term].transpose(0, 2, 1))
        gamma = settle(w, count, alpha, start)
        theta = np.exp(log_mean(gamma))
        yield rows, gamma, theta, term, count / (np.matmul(theta[:, None, :], w)[:, 0, :] + 1e-100)


def flat(bow: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, counts, ends) of a batch's term counts."""
    terms, counts = bow.flatten()
    ends = np.r_[0, np.cumsum(terms.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    return terms.flatten().to_numpy(), counts.flatten().to_numpy(), ends


class Sums:
    """What a task adds up in a pass of one model: expected counts by term and topic, log topic shares, documents."""

    def __init__(self, weight: np.ndarray, alpha: np.ndarray, start: np.ndarray):
        self.weight, self.alpha, self.start = weight, alpha, start
        self.sums, self.logs, self.n = np.zeros_like(weight), np.zeros(len(alpha)), 0

    def add(self, times: np.ndarray, terms: np.ndarray, counts: np.ndarray, ends: np.ndarray) -> None:
        """Documents with the times each was drawn; one drawn twice counts twice, one not drawn is left alone."""
        sizes = np.diff(ends)
        if not times.all():
            go = np.flatnonzero(times)
            place = np.repeat(ends[go] - np.r_[0, np.cumsum(sizes[go])[:-1]], sizes[go]) + np.arange(sizes[go].sum()) if len(go) else go
            times, terms, counts, ends = times[go], terms[place], counts[place], np.r_[0, np.cumsum(sizes[go])]
        seen, terms = met_terms(terms, len(self.weight))
        part = np.zeros((len(self.alpha), len(seen)))
        for rows, gamma, theta, term, share in infer(terms, counts, ends, self.weight[seen], self.alpha, self.start):
            m = times[rows]
            self.n += int(m.sum())
            self.logs += m @ log_mean(gamma)
            share = share * m[:, None]    # padding has none
            for topic in range(len(self.alpha)):
                part[topic] += np.bincount(term.ravel(), (share * theta[:, topic, None]).ravel(), len(seen))
        self.sums[seen] += part.T

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(terms met, values in fixed point); the first row, term -1, has the log topic shares."""
        met = np.flatnonzero(self.sums.any(1))
        values = np.vstack([self.logs, self.sums[met] * self.weight[met]]) * POINT
        return np.r_[-1, met].astype(np.int32), np.rint(values).astype(np.int64)


def pass_sums(batches, weight: np.ndarray, alpha: np.ndarray, start: np.ndarray):
    """A task's part of a pass of one model, from batches of (times drawn, term counts): a row per term met, with its expected
    counts by topic, and a row -1 with the sums of log topic shares; ``n`` counts documents."""
    part = Sums(weight, alpha, start)
    for b in batches:
        part.add(b.column(0).to_numpy(), *flat(b.column(1)))
    terms, values = part.rows()
    columns = [pa.array(terms), pa.array(np.r_[part.n, np.zeros(len(terms) - 1, np.int64)])]
    yield pa.RecordBatch.from_arrays(columns + [pa.array(v) for v in values.T.copy()],
                                     names=["term", "n", *[f"s{i}" for i in range(len(alpha))]])


def packed(fit: int, first: int, n: int, terms: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row: a fit's values for the terms met of the range from ``first`` (-1: the row of log topic shares)."""
    columns = [pa.array([fit], pa.int32()), pa.array([first], pa.int32()), pa.array([n], pa.int64()),
               pa.array([terms.astype(np.int32).tobytes()]), pa.array([np.ascontiguousarray(values).tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["fit", "first", "n", "terms", "vals"])


def all_terms(batches, n_terms: int):
    """A row with a bit for each term: whether the task's term counts hold it."""
    seen = np.zeros(n_terms, bool)
    for b in batches:
        seen[flat(b.column(0))[0]] = True
    yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()])], names=["seen"])


def places(vocabulary: np.ndarray, n_terms: int) -> np.ndarray:
    """The place of each term among those of the vocabulary."""
    out = np.zeros(n_terms, np.int32)
    out[vocabulary] = np.arange(len(vocabulary), dtype=np.int32)
    return out


def packed_sums(batches, models: list[tuple], vocabulary: np.ndarray, n_terms: int):
    """A task's part of a pass of several models, from batches of (times drawn under each, term counts). The models' weights
    are those of the ``vocabulary``, the terms that occur at all."""
    parts, place = [Sums(*m) for m in models], places(vocabulary, n_terms)
    for b in batches:
        terms, counts, ends = flat(b.column(len(parts)))
        terms = place[terms]
        for i, part in enumerate(parts):
            part.add(b.column(i).to_numpy(), terms, counts, ends)
    for i, part in enumerate(parts):
        terms, values = part.rows()
        yield packed(i, -1, part.n, terms[:1], values[:1])
        terms[1:] = vocabulary[terms[1:]]
        cuts = np.searchsorted(terms, np.arange(0, n_terms + RANGE, RANGE))
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if b > a:
                yield packed(i, j * RANGE, 0, terms[a:b], values[a:b])


def united(batches, k: int):
    """The rows of each fit and range added up to one."""
    table: dict[tuple, list] = {}
    for b in batches:
        for r in b.to_pylist():
            first = max(r["first"], 0)
            own = table.setdefault((r["fit"], r["first"]), [0, np.zeros((RANGE if r["first"] >= 0 else 1, k), np.int64)])
            own[0] += r["n"]
            at = np.frombuffer(r["terms"], np.int32) - first if r["first"] >= 0 else np.zeros(1, np.int32)
            own[1][at] += np.frombuffer(r["vals"], np.int64).reshape(-1, k)
    for (fit, first), (n, values) in table.items():
        met = np.flatnonzero(values.any(1)) if first >= 0 else np.zeros(1, np.int64)
        yield packed(fit, first, n, met + first, values[met])


def unpacked(rows: pa.Table, fit: int, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sums by term, log topic shares, documents) of a fit."""
    sums, logs, n = np.zeros((n_terms, k)), np.zeros(k), 0
    own = rows.filter(pc.equal(rows["fit"], fit))
    for first, drawn, terms, values in zip(*[own[c] for c in ("first", "n", "terms", "vals")]):
        values = np.frombuffer(values.as_buffer(), np.int64).reshape(-1, k) / POINT
        if first.as_py() < 0:
            logs, n = values[0], drawn.as_py()
        else:
            sums[np.frombuffer(terms.as_buffer(), np.int32)] = values
    return sums, logs, n


def dominant(batches, models: list[tuple], vocabulary: np.ndarray | None, n_terms: int, bow: int, out: str):
    """For each model (seed, weights, prior, start) the batches with its seed first and each document's largest topic (ties:
    lowest; no terms: 0) in place of column ``bow``. The weights are those of the ``vocabulary``, if there is one."""
    place = None if vocabulary is None else places(vocabulary, n_terms)
    for b in batches:
        terms, counts, ends = flat(b.column(bow))
        terms = terms if place is None else place[terms]
        names = b.schema.names
        kept = [i for i in range(len(names)) if i != bow]
        for seed, weight, alpha, start in models:
            best = np.zeros(b.num_rows, np.int32)
            seen, at = met_terms(terms, len(weight))
            for rows, gamma, *_ in infer(at, counts, ends, weight[seen], alpha, start):
                best[rows] = gamma.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, seed, np.int64)), *[b.column(i) for i in kept], pa.array(best)],
                                             names=["seed", *[names[i] for i in kept], out])
