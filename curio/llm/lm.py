"""Language-model scoring by prediction by partial matching (PPM) over bytes, beside a word model.

The byte-context trie of order ``ORDER`` is learned from the training rows: counts of every (context,
symbol) with contexts of 0..ORDER bytes. A text's code length starts each symbol at the longest
context; a symbol unseen there costs an escape (half the number of distinct symbols over the counts, a seen
one loses half a count for it: method D) and is tried in the next shorter context, where symbols already excluded do not count. Below
order 0 the remaining symbols are equally likely. Symbols are 256 bytes and the end; places before a
text's begin are a symbol of their own in contexts.

Counts of the longest contexts hold all others, because every place has a whole (padded) context. As all
symbols of a context also occur in its shorter contexts, the excluded counts depend on the
context alone, so a cost per distinct (context, symbol) suffices: tasks cost the distinct ones of a
batch and sum them by position.

The trie is sent to the tasks only if it has at most ``MAX_SENT`` entries; beyond, costs are found with
joins (``costs_by_join``), with equal results. The word counts never travel whole: rows are put in shards of
rows by file and place in the file, each shard sends its distinct words and gets their counts back.

``adaptive_lengths`` scores each text with a model that starts empty and learns as it reads.

Edge cases: a null text counts as empty (the end token alone); a null id counts as the empty
text for the hold-out rule (held out). Without training rows every symbol costs 1/257 and N = V = 0. Rows that share an id
are scored each. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_shard, placed, sliced, text_bytes, text_or_empty, written

ORDER = 5
SYMBOLS = 258  # bytes, place before the begin, end
PAD, END = 256, 257
CODED = 257  # symbols that a code tells apart: bytes and the end
MAX_SENT = 8_000_000
#: Words counted before a task hands its counts on.
TABLE_SIZE = 300_000
#: Text bytes scored at once (sorting their contexts stays in the processor's caches).
SCORED_BYTES = 1 << 20
#: Stands for the end token in word tables; no word is white space.
END_WORD = b"\n"


def training_row(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 != 0


# --- the byte model --------------------------------------------------------------------------

def gram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """A code of (context, symbol) for every symbol of the texts, and where each text begins."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.r_[0, np.cumsum(size + order + 1)]
    s = np.full(int(begin[-1]), PAD, dtype=np.int64)
    body = np.frombuffer(b"".join(texts), dtype=np.uint8)
    at = np.arange(len(body)) + np.repeat(begin[:-1] + order - np.r_[0, np.cumsum(size)][:-1], size)
    s[at] = body
    s[begin[1:] - 1] = END
    n = len(s) - order
    g = np.zeros(max(0, n), dtype=np.int64)
    for i in range(order + 1):
        g *= SYMBOLS
        g += s[i:i + n]
    return g[s[order:] != PAD], np.r_[0, np.cumsum(size + 1)][:-1]


class Trie:
    """Costs of (context, symbol) codes from the counts at the longest context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        at = np.argsort(codes)
        g, n = codes[at].astype(np.int64), counts[at].astype(np.float64)
        self.order, self.levels = order, []
        for j in range(order, -1, -1):
            if j < order:
                g, inv = np.unique(g % SYMBOLS ** (j + 1), return_inverse=True)
                n = np.bincount(inv, weights=n)
            ctx, first = np.unique(g // SYMBOLS, return_index=True)
            total = np.add.reduceat(n, first) if len(g) else n
            self.levels.append([j, g, n, ctx, total, np.diff(np.r_[first, len(g)]).astype(np.float64), None])
        for upper, lower in zip(self.levels, self.levels[1:]):
            held = lower[2][np.searchsorted(lower[1], upper[1] % SYMBOLS ** upper[0])] if len(upper[1]) else upper[2]
            first = np.searchsorted(upper[1] // SYMBOLS, upper[3])
            upper[6] = np.add.reduceat(held, first) if len(upper[1]) else held  # counts excluded one context below

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each code (sorted codes are looked up fastest)."""
        out, todo = np.zeros(len(codes)), np.arange(len(codes))
        out_n, out_d = np.zeros(len(codes)), np.zeros(len(codes))  # excluded counts and symbols
        for j, g, n, ctx, total, distinct, below in self.levels:
            c = codes[todo] % SYMBOLS ** (j + 1)
            ci, has = self.find(ctx, c // SYMBOLS)
            gi, hit = self.find(g, c)
            zero = np.zeros(len(c))
            held = np.where(has, total[ci], 0) if len(ctx) else zero
            kinds = np.where(has, distinct[ci], 0) if len(ctx) else zero
            left, left_d = held - out_n[todo], kinds - out_d[todo]
            out[todo[hit]] += np.log10((n[gi[hit]] - 0.5) / left[hit])
            esc = ~hit & has & (left > 0)
            out[todo[esc]] += np.log10(left_d[esc] / 2 / left[esc])
            out_n[todo] = np.where(has, below[ci], 0) if below is not None and len(ctx) else 0
            out_d[todo] = kinds
            todo = todo[~hit]
        out[todo] -= np.log10(CODED - out_d[todo])
        return out

    def text_costs(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        g, begin = gram_codes(texts, self.order)
        u, inv = np.unique(g, return_inverse=True)
        return np.add.reduceat(self.costs(u)[inv], begin) if len(texts) else np.zeros(0)


_TRIES: dict[str, Trie] = {}


def trie_of(tag: str, sent, order: int) -> Trie:
    """The trie of a broadcast, built once in a worker process (tasks reuse it)."""
    if tag not in _TRIES:
        _TRIES.clear()
        _TRIES[tag] = Trie(*sent.value, order)
    return _TRIES[tag]


class AdaptiveTrie:
    """The same model as a dictionary of contexts that may learn while it reads (small inputs, plain form)."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[tuple, dict[int, int]] = {}

    def symbols(self, text: bytes):
        ctx = (PAD,) * self.order
        for s in (*text, END):
            yield ctx, s
            ctx = (*ctx, s)[1:] if self.order else ()

    def learn(self, ctx: tuple, s: int) -> None:
        for j in range(self.order + 1):
            c = self.counts.setdefault(ctx[j:], {})
            c[s] = c.get(s, 0) + 1

    def cost(self, ctx: tuple, s: int) -> float:
        out, excluded = 0.0, set()
        for j in range(self.order + 1):
            seen = {k: v for k, v in self.counts.get(ctx[j:], {}).items() if k not in excluded}
            if not seen:
                continue
            total = sum(seen.values())
            if s in seen:
                return out + math.log10((seen[s] - 0.5) / total)
            out += math.log10(len(seen) / 2 / total)
            excluded |= seen.keys()
        return out - math.log10(CODED - len(excluded))

    def length(self, text: bytes, adapt: bool) -> float:
        out = 0.0
        for ctx, s in self.symbols(text):
            out += self.cost(ctx, s)
            if adapt:
                self.learn(ctx, s)
        return out


def adaptive_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, score): log10 probability of each text under a model that starts empty and learns as it reads."""
    src = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))

    def run(batches):
        for b in sliced(batches, "_t"):
            out = [AdaptiveTrie(order).length(t.lower(), True) for t in text_bytes(b.column("_t"))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(out, pa.float64())], ["_id", "score"])

    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, score double").withColumnRenamed("_id", id_col)


def learn_grams(texts: DataFrame, order: int) -> DataFrame:
    """(gram, n) over all texts of column ``_t``, written."""
    def run(batches):
        for b in sliced(batches, "_t"):
            u, n = np.unique(gram_codes([t.lower() for t in text_bytes(b.column("_t"))], order)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], ["gram", "n"])

    return written(texts.select("_t").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "op6-grams")


def costs_by_join(texts: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(_key, score) for (_key, _t) with the trie left distributed: its levels are tables, costs come from joins."""
    def run(batches):
        for b in sliced(batches, "_t"):
            for key, t in zip(b.column("_key").to_pylist(), text_bytes(b.column("_t"))):
                u, n = np.unique(gram_codes([t.lower()], order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(u), pa.string()), pa.array(u), pa.array(n.astype(np.int64))], ["_key", "gram", "times"])

    places = texts.select("_key", "_t").mapInArrow(run, "_key string, gram long, times long")
    levels = []
    g = grams
    for j in range(order, -1, -1):
        if j < order:
            g = g.groupBy((F.col("gram") % SYMBOLS ** (j + 1)).alias("gram")).agg(F.sum("n").alias("n"))
        levels.append(g)
    zero = F.lit(0.0)
    x = (places.select("gram").distinct().withColumn("cost", zero).withColumn("done", F.lit(False))
         .withColumn("xn", zero).withColumn("xd", zero))
    for i, j in enumerate(range(order, -1, -1)):
        g, top = levels[i], SYMBOLS ** (j + 1)
        ctx = F.expr(f"gram div {SYMBOLS}")
        c = g.groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        if j:
            lower = levels[i + 1].select(F.col("gram").alias("low"), F.col("n").alias("ln"))
            below = (g.select(ctx.alias("ctx"), (F.col("gram") % SYMBOLS ** j).alias("low")).join(lower, "low")
                     .groupBy("ctx").agg(F.sum("ln").alias("below")))
            c = c.join(below, "ctx")
        else:
            c = c.withColumn("below", zero)
        x = (x.withColumn("g", F.col("gram") % top).withColumn("ctx", F.expr(f"g div {SYMBOLS}"))
             .join(g.select(F.col("gram").alias("g"), "n"), "g", "left").join(c, "ctx", "left"))
        left = F.coalesce("total", zero) - F.col("xn")
        kinds = F.coalesce("kinds", zero) - F.col("xd")
        hit, open_ = F.col("n").isNotNull(), ~F.col("done")
        step = (F.when(open_ & hit, F.log10((F.col("n") - 0.5) / left))
                .when(open_ & F.col("total").isNotNull() & (left > 0), F.log10(kinds / 2 / left)).otherwise(zero))
        x = x.select("gram", (F.col("cost") + step).alias("cost"), (F.col("done") | hit).alias("done"),
                     F.coalesce("below", zero).cast("double").alias("xn"), F.coalesce("kinds", zero).cast("double").alias("xd"))
    cost = x.select("gram", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - F.log10(CODED - F.col("xd"))).alias("cost"))
    return places.join(cost, "gram").groupBy("_key").agg(F.sum(F.col("times") * F.col("cost")).alias("score"))


# --- the word model and the score ------------------------------------------------------------

def sharded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _key, _train, _t, _shard); _key names a row."""
    src = placed(df, F.col(id_col).alias("_id"), training_row(id_col).alias("_train"), text_or_empty(text_col).alias("_t"))
    return src.select("_id", F.concat_ws(":", "_shard", "_row").alias("_key"), "_train", "_t", "_shard")


def word_counts(src: DataFrame) -> DataFrame:
    """(_shard, _word, _n, _c, _k): each shard's words, with the count in all training tokens; _k numbers a word's rows."""
    def run(batches):
        from collections import Counter
        shard, seen = None, Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), shard, dtype=np.int64)), pa.array(list(seen), pa.binary()),
                                               pa.array(list(seen.values()), pa.int64())], ["_shard", "_word", "_n"])

        for b in sliced(batches, "_t"):
            for s, learn, t in zip(b.column("_shard").to_pylist(), b.column("_train").to_pylist(), text_bytes(b.column("_t"))):
                if s != shard or len(seen) > TABLE_SIZE:
                    if seen:
                        yield rows()
                    shard = s
                    seen.clear()
                words = t.lower().split()
                words.append(END_WORD)
                if learn:
                    seen.update(words)
                else:
                    for w in words:
                        seen.setdefault(w, 0)
        if seen:
            yield rows()

    rows = src.select("_shard", "_train", "_t").mapInArrow(run, "_shard long, _word binary, _n long")
    w = Window.partitionBy("_word")
    return written(rows.withColumn("_k", F.row_number().over(w.orderBy("_shard"))).withColumn("_c", F.sum("_n").over(w)), "op6-words")


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, max_sent: int = MAX_SENT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = df.sparkSession
    src = sharded(df, id_col, text_col)
    grams = learn_grams(src.where("_train"), order)
    words = word_counts(src)
    r = words.agg(F.sum("_n").alias("n"), F.sum(((F.col("_k") == 1) & (F.col("_c") > 0)).cast("long")).alias("v")).first()
    n, v = int(r["n"] or 0), int(r["v"] or 0)
    sent, tag = None, uuid.uuid4().hex
    if grams.count() <= max_sent:
        t = grams.toArrow()
        sent = spark.sparkContext.broadcast((t["gram"].to_numpy(), t["n"].to_numpy()))

    none = F.lit(None)
    # a shard's words come first, then its texts: a task holds one shard's word table at a time
    rows = by_shard(words.select("_shard", F.lit(0).alias("_kind"), F.col("_word").alias("_t"), "_c", none.cast("string").alias("_key"),
                         none.cast(src.schema["_id"].dataType).alias("_id"), none.cast("boolean").alias("_train")),
                    src.select("_shard", F.lit(1), F.col("_t").cast("binary"), none.cast("long"), "_key", "_id", "_train"))

    def run(batches):
        trie, shard, table = trie_of(tag, sent, order) if sent else None, None, {}
        for b in sliced(batches, "_t", SCORED_BYTES):
            shards, kinds = b.column("_shard").to_numpy(), b.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                if shards[i] != shard:
                    shard, table = shards[i], {}
                if not kinds[i]:
                    table.update(zip(part.column("_t").to_pylist(), part.column("_c").to_pylist()))
                    continue
                texts = [(t or b"").lower() for t in part.column("_t").to_pylist()]
                tokens = [[*t.split(), END_WORD] for t in texts]
                size = np.array([len(t) for t in tokens], dtype=np.int64)
                first = np.r_[0, np.cumsum(size)][:-1]
                get = table.__getitem__
                c = np.fromiter(map(get, chain.from_iterable(tokens)), dtype=np.float64, count=int(size.sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_key"), part.column("_train"), pa.array(size), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                     pa.array(np.add.reduceat(np.log10(c + 0.1), first)), pa.array(trie.text_costs(texts) if trie else np.zeros(len(texts)))],
                    ["_id", "_key", "_train", "n_tokens", "n_known", "logs", "score"])

    kind = src.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_id {kind}, _key string, _train boolean, n_tokens long, n_known long, logs double, score double")
    if not sent:
        out = out.drop("score").join(costs_by_join(src, grams, order), "_key")
    return out.select(F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("logs") - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))).alias("base_score"), "score")
