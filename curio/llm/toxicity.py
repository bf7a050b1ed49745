"""Toxicity scoring by a counterfactual-regularised classifier.

Features are words (ASCII letters lower-cased, other ASCII characters part words) and their prefixes of
4 to 6 bytes, hashed to ``DIMS`` numbers; a document has a feature or not. The
classifier is fitted on a bounded sample of the labelled rows (``max_train``, expected size; ``MAX_PER_ID`` of one id):
features that tell the classes apart (likelihood ratio above ``MIN_G2``) and every identity term that the sample holds
enter a logistic regression with the loss

    class-balanced log loss + l2 |w|^2 + cf * mean over counterfactual pairs of (score(x) - score(x'))^2

where x' is x with its identity terms swapped for others of their group, and the score is the logit.
A group's name alone then hardly moves a score, which keeps neutral mentions of groups clean. Groups are listed for
English, French, German and Spanish; a term that stands in two languages swaps within the first. Only texts and labels
are read; ids only place rows in the sample.

The sample is featurised by Spark and fitted in one task of bounded size; the fitted weights are a few
thousand numbers at most (``DIMS`` bounds them). All documents are scored, whole, in place.

Edge cases: a null text counts as empty; a text without known features gets the intercept's score. Labels
other than 0 and 1 and null labels are not learned from; an id with both labels is learned with both. Of rows that share
an id, ``MAX_PER_ID`` are learned from at most. If a class is missing, every score is the smoothed share of label 1 (0.5
without labels). Empty tables give no rows. Columns of any other name than the score's stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import free_name, sliced, text_bytes, text_or_empty, written

MAX_TRAIN = 12_000
MAX_PER_ID = 4
DIMS = 1 << 22
MIN_G2 = 15.0
MIN_DOCS = 4
PREFIXES = (4, 5, 6)
#: Distinct words a task remembers before it starts anew.
TABLE_SIZE = 500_000
#: Text bytes that are scored at a time.
SCORE_BYTES = 1 << 20

#: Terms of a group stand in for each other in counterfactual texts.
IDENTITY_GROUPS = [
    "woman man person", "women men people", "girl boy child", "female male", "she he they", "her his their",
    "muslim christian jew hindu buddhist atheist", "muslims christians jews hindus buddhists atheists",
    "black white asian latino arab", "african european american mexican chinese indian",
    "africans europeans americans mexicans indians", "gay straight lesbian bisexual", "transgender cisgender",
    "immigrant native foreigner refugee", "immigrants natives foreigners refugees", "disabled deaf blind autistic", "old young elderly",
    "femme homme personne", "femmes hommes personnes", "fille garçon", "elle il", "elles ils",
    "musulman chrétien juif hindou bouddhiste athée", "musulmans chrétiens juifs hindous bouddhistes athées",
    "noir blanc asiatique arabe", "noirs blancs asiatiques arabes", "africain européen américain mexicain chinois indien",
    "immigré étranger réfugié", "immigrés étrangers réfugiés", "homosexuel hétérosexuel lesbienne",
    "frau mann mensch", "frauen männer menschen", "mädchen junge", "sie er", "muslime christen juden hindus buddhisten atheisten",
    "moslem christ jude", "schwarze weiße asiaten araber", "afrikaner europäer amerikaner mexikaner chinese inder",
    "einwanderer ausländer flüchtling", "schwul lesbisch hetero",
    "mujer hombre persona", "mujeres hombres personas", "niña niño", "ella él", "ellas ellos",
    "musulmán cristiano judío hindú budista ateo", "musulmanes cristianos judíos hindúes budistas ateos",
    "negro blanco asiático árabe", "negros blancos asiáticos árabes", "africano europeo americano mexicano chino indio",
    "inmigrante extranjero refugiado", "inmigrantes extranjeros refugiados", "lesbiana heterosexual",
]

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def swaps(groups: list[str] = IDENTITY_GROUPS) -> list[dict[bytes, bytes]]:
    """Two rotations of each group: term -> the next one, term -> the one before."""
    out = []
    for step in (1, -1):
        m = {}
        for g in groups:
            t = [x for x in g.encode().split() if x not in m]
            m.update({x: t[(i + step) % len(t)] for i, x in enumerate(t) if len(t) > 1})
        out.append(m)
    return out


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashed features of one word: the word (behind a byte that no word holds) and its prefixes."""
    h, last = xxhash.xxh32_intdigest, DIMS - 1
    return (h(b"\0" + word, 17) & last, *(h(word[:k], 17) & last for k in PREFIXES if len(word) > k))


class Featuriser:
    """Features of texts, with a table of the words met so far."""

    def __init__(self):
        self.table: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, distinct: set[bytes]) -> np.ndarray:
        t = self.table
        if len(t) > TABLE_SIZE:
            t.clear()
        for w in distinct:
            if w not in t:
                t[w] = word_features(w)
        return np.array(sorted(set().union(*map(t.__getitem__, distinct))), dtype=np.int32)


def featurise(labelled: DataFrame, groups: list[str]) -> DataFrame:
    """(label, x, xs): a document's features and what its counterfactuals change (nothing without identity terms): a
    feature that goes stands as itself, one that comes as -1 - feature."""
    def run(batches):
        f, maps = Featuriser(), swaps(groups)
        terms = set(maps[0])
        for b in sliced(batches, "_t"):
            x, xs = [], []
            for t in text_bytes(b.column("_t")):
                w = set(words(t))
                x.append(f(w))
                other = [f({m.get(a, a) for a in w}) for m in maps] if w & terms else []
                xs.append([np.r_[np.setdiff1d(x[-1], v), -1 - np.setdiff1d(v, x[-1])].astype(np.int32) for v in other])
            yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(x, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.list_(pa.int32())))],
                                             ["label", "x", "xs"])

    return labelled.select("_y", "_t").mapInArrow(run, "label int, x array<int>, xs array<array<int>>")


def term_features(groups: list[str]) -> np.ndarray:
    """The features of the identity terms as words."""
    return np.array(sorted({word_features(t)[0] for t in swaps(groups)[0]}), dtype=np.int64)


def select_features(y: np.ndarray, rows: list[np.ndarray], always: np.ndarray) -> np.ndarray:
    """Features whose presence differs between the classes (likelihood ratio of the 2x2 table), and ``always`` where present."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    # counted row by row: all rows' features at once, sorted, would take many times their size
    size = 1 + max((int(r.max()) for r in rows if len(r)), default=-1)
    seen_in, seen_in_1 = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    for r, label in zip(rows, y):
        np.add.at(seen_in, r, 1)
        if label:
            np.add.at(seen_in_1, r, 1)
    feats = np.flatnonzero(seen_in).astype(np.int32)
    a = seen_in_1[feats].astype(np.float64)  # present, label 1
    b = seen_in[feats] - a
    del seen_in, seen_in_1
    g2 = np.zeros(len(feats))
    for seen, total, share in ((a, n1, n1), (b, n0, n0), (n1 - a, n1, n1), (n0 - b, n0, n0)):
        held = (a + b) if seen is a or seen is b else (n1 + n0 - a - b)
        want = held * share / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 += np.where(seen > 0, 2 * seen * np.log(seen / want), 0)
    return feats[((g2 >= MIN_G2) & (a + b >= MIN_DOCS)) | np.isin(feats, always)]


def fit(y: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[int, np.ndarray]], cf: float, l2: float = 1e-4,
        steps: int = 600, always: np.ndarray = np.zeros(0, np.int64)) -> tuple[float, np.ndarray, np.ndarray]:
    """(intercept, feature numbers, weights). ``pairs`` holds (row, features that a counterfactual of it changes)."""
    n, n1 = len(y), float(y.sum())
    prior = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    feats = select_features(y, rows, always) if 0 < n1 < n else np.zeros(0, dtype=np.int32)
    if not len(feats):
        return prior, feats, np.zeros(0)

    def compact(x):
        at = np.searchsorted(feats, x)
        at[at == len(feats)] = 0
        return at[feats[at] == x]

    own = [compact(r) for r in rows]
    r = np.repeat(np.arange(n), [len(c) for c in own])
    c = np.concatenate(own)
    diff = [(compact(x[x >= 0]), compact(-1 - x[x < 0])) for _, x in pairs]
    pr = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(diff)] or [np.zeros(0, int)]).astype(np.int64)
    pcol = np.concatenate([np.r_[a, b] for a, b in diff] or [np.zeros(0, int)]).astype(np.int64)
    pv = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in diff] or [np.zeros(0)])
    m, k = max(1, len(diff)), len(feats)
    w, bias = np.zeros(k), prior
    each = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1)) * n  # both classes weigh the same
    # diagonal steps from a bound of the curvature: features are 0/1 and rows hold few of them
    width = max(1, max(len(x) for x in own))
    curve = 0.25 * width * np.bincount(c, weights=each[r], minlength=k) / n + 2 * l2
    if len(pv):
        curve = curve + 2 * cf * max(len(a) + len(b) for a, b in diff) * np.bincount(pcol, minlength=k) / m
    vw, vb, t = w.copy(), bias, 1.0
    for _ in range(steps):  # accelerated gradient descent
        z = vb + np.bincount(r, weights=vw[c], minlength=n)
        g = each * (1 / (1 + np.exp(-z)) - y)
        gw = np.bincount(c, weights=g[r], minlength=k) / n + 2 * l2 * vw
        if len(pv):
            d = np.bincount(pr, weights=pv * vw[pcol], minlength=m)
            gw += 2 * cf * np.bincount(pcol, weights=pv * d[pr], minlength=k) / m
        nw, nb = vw - gw / curve, vb - g.mean() / 0.25
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - bias)
        w, bias, t = nw, nb, t2
    return float(bias), feats, w


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_train: int = MAX_TRAIN, cf: float = 1.0,
          groups: list[str] = IDENTITY_GROUPS) -> tuple[float, dict[int, float]]:
    """Fit on about ``max_train`` labelled rows for which ``use`` (a condition on ``id_col``) holds."""
    lab = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & F.col(id_col).isNotNull())
    if use is not None:
        lab = lab.where(use)
    lab = lab.distinct()
    n = lab.count()
    slot = F.pmod(F.xxhash64(id_col), F.lit(1 << 20))
    lab = lab.where(slot < min(1 << 20, int(max_train / max(1, n) * (1 << 20))))
    lab = written(lab, "op7-sample")
    texts = docs.select(F.col(id_col), text_or_empty(text_col).alias("_t")).join(lab, id_col)
    per_id = Window.partitionBy(id_col).orderBy(F.xxhash64("_t", "_y"))  # cut before the shuffle, so a hot id does not travel
    texts = texts.withColumn("_n", F.row_number().over(per_id)).where(F.col("_n") <= MAX_PER_ID)
    rows = written(featurise(texts, groups), "op7-features")
    always = term_features(groups)

    def run(batches):
        y, x, pairs = [], [], []
        for b in batches:
            for label, feats, alt in zip(b.column("label").to_pylist(), b.column("x"), b.column("xs").to_pylist()):
                pairs += [(len(y), np.array(v, dtype=np.int32)) for v in alt]
                y.append(label)
                x.append(feats.values.to_numpy())
        bias, feats, w = fit(np.array(y, dtype=np.float64), x, pairs, cf, always=always)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, feats].astype(np.int64)), pa.array(np.r_[bias, w])], ["feature", "weight"])

    fitted = rows.repartition(1).mapInArrow(run, "feature long, weight double").collect()
    weights = {r["feature"]: r["weight"] for r in fitted}
    return weights.pop(-1, 0.0), weights


def score(docs: DataFrame, model: tuple[float, dict[int, float]], text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """The documents with a column ``score_col`` (probability of label 1) in place of one of that name; all others stay."""
    bias, weights = model
    docs = docs.drop(score_col) if score_col != text_col else docs
    keep = docs.columns
    if text_col in keep and isinstance(docs.schema[text_col].dataType, StringType):
        text, src = text_col, docs  # read in place: a second copy of all texts would go to Python
    else:
        text = free_name(docs, "_scored_text")
        src = docs.withColumn(text, text_or_empty(text_col))

    def run(batches):
        table: dict[bytes, tuple] = {}
        for b in sliced(batches, text, SCORE_BYTES):
            if len(table) > TABLE_SIZE:
                table.clear()
            out = []
            for t in text_bytes(b.column(text)):
                distinct = set(words(t))
                hits = set()
                for w in distinct:
                    known = table.get(w)
                    if known is None:
                        known = table[w] = tuple(f for f in word_features(w) if f in weights)
                    if known:
                        hits.update(known)
                out.append(1 / (1 + np.exp(-min(700.0, max(-700.0, bias + sum(weights[f] for f in sorted(hits)))))))
            cols = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.float64())], [*keep, score_col])

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    return src.mapInArrow(run, schema)
