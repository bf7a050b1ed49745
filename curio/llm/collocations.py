"""Phrase collocation mining with weighted acyclic automata.

A count automaton holds phrases of up to ``longest`` words: states are phrases, arcs are words, the weight of a state
is the phrase's number of occurrences. Phrases share their prefixes, and a state of level k is a pair (state of
level k - 1, word), so the automaton is a sorted list of such pairs per level.

1. Shards: a task reads texts up to ``shard_bytes`` and cuts them into pieces and words. Each shard sends its
   distinct words with their counts. Words with two occurrences or more are numbered, and every shard gets the
   numbers of its own words by a join; a word that occurs once is in no candidate, so it parts a piece.
2. Each shard builds its automaton level by level, adding arcs in sorted order; equal phrases are one state with
   a weight. The automaton is cut by prefix (its first ``HEAD`` words) into ranges of the prefix's hash.
3. Union: the owner of a range unites the shards' states and sums their weights as integers. States under ``least`` go,
   with all that hangs on them.
4. Composition: a part of a candidate occurs at least as often as the candidate, so every part is a state that
   was kept. The cuts of each candidate look both parts up by joins, which Spark can split if a part is hot.

A hot phrase reaches its owner once per shard, whatever its count. Ranges grow in number with the texts, so
a range holds about ``range_bytes`` of text. Texts are cut at piece ends, which no phrase crosses, so a very
long text is no larger unit than its pieces allow.

Edge cases: a null text is empty, a null language is ``und`` and pooled with that name. Texts or pieces without
words give nothing. Repeated rows and ids count as often as they occur; ids are not read. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shard_count, sliced, text_bytes, text_or_empty, written

SHARD_BYTES = 12 << 20
RANGE_BYTES = 16 << 20
LONGEST = 5
LEAST = 100
TOP = 2000
#: Words of a prefix that decide its range; longer phrases follow their prefix.
HEAD = 3

_UPPER = bytes(range(65, 91))
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z in lower case, tab as space, every break as line feed.
_TABLE = bytes.maketrans(_UPPER + b"\t" + _BREAKS, _UPPER.lower() + b" " + b"\n" * len(_BREAKS))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = 32  # a state and a word make one key


def packed(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers below 2^31, compressed byte plane by byte plane."""
    a = np.concatenate([np.array([len(columns), *map(len, columns)]), *columns]).astype(np.int32)
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], size, asbytes=True), np.uint8)
    a = np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel().astype(np.int64)
    cuts = 1 + int(a[0]) + np.concatenate(([0], np.cumsum(a[1:1 + a[0]])))
    return [a[i:j] for i, j in zip(cuts, cuts[1:])]


def tokens(buf: bytes) -> tuple[np.ndarray, pa.Array]:
    """Word numbers from 1 with 0 between two pieces, and the distinct words, of a text in which ``_TABLE`` is applied."""
    a = np.frombuffer(buf, np.uint8)
    inside = (a != 32) & (a != 10)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(a[inside].tobytes())]).dictionary_encode()
    piece = np.cumsum(a == 10, dtype=np.int32)[starts]
    return np.insert(words.indices.to_numpy() + 1, np.flatnonzero(np.diff(piece)) + 1, 0), words.dictionary


def automaton(stream: np.ndarray, longest: int) -> list[tuple]:
    """Levels (parent state, word, weight) in sorted order of a stream of word numbers, negative where no phrase may cross."""
    piece = np.cumsum(stream < 0)[stream >= 0]
    ids = stream[stream >= 0].astype(np.int64)
    words, state, weight = np.unique(ids, return_inverse=True, return_counts=True)
    levels = [(None, words, weight)]
    at = np.arange(len(ids))
    for k in range(1, longest):
        go = np.flatnonzero(at + k < len(ids))
        go = go[piece[at[go] + k] == piece[at[go]]]
        at = at[go]
        arc, state, weight = np.unique((state[go] << _SHIFT) | ids[at + k], return_inverse=True, return_counts=True)
        levels.append((arc >> _SHIFT, arc & ((1 << _SHIFT) - 1), weight))
    return levels


def cut(levels: list[tuple], ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, states) for each range with states of two words or more.

    Up to ``HEAD`` words a state names its whole path, beyond that the place of its parent among the range's states of
    the level above; the first column is sorted and holds differences.
    """
    h, paths, out = np.zeros(0, np.uint64), [], []
    where = place = None  # of the level above: the range of each state, and the state's place in it
    for k, (parent, word, weight) in enumerate(levels):
        if k < HEAD:
            h = (word.astype(np.uint64) if k == 0 else (h[parent] ^ word.astype(np.uint64))) * _MIX
            h = h ^ (h >> np.uint64(29))
            paths = [word] if k == 0 else [p[parent] for p in paths] + [word]
            if k == 0:
                continue
            where = (((h * _MIX >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            cols = [*paths, weight]
        else:
            cols = [place[parent], word, weight]
            where = where[parent]
        order = np.argsort(where, kind="stable")
        cuts = np.searchsorted(where[order], np.arange(ranges + 1))
        place = np.empty(len(where), np.int64)
        place[order] = np.arange(len(where)) - cuts[where[order]]
        out.append(([c[order] for c in cols], cuts))
    for r in range(ranges):
        cols = [[c[cuts[r]:cuts[r + 1]] for c in cs] for cs, cuts in out]
        if any(len(c[0]) for c in cols):
            yield r, packed([np.diff(c, prepend=0) if i == 0 else c for cs in cols for i, c in enumerate(cs)])


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the place of each key among them, exact sums of the weights."""
    uniq, inv = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(uniq), np.int64)
    np.add.at(sums, inv, weights)
    return uniq, inv, sums


def united(blobs: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Union of the shards' automata of one range: per level the paths (a row per phrase) that stay, and their weights."""
    parts = [unpacked(b) for b in blobs]
    low = (1 << _SHIFT) - 1
    at, state, stays, names = 0, None, None, None
    offsets: list[int] = []
    k = 1
    while at < len(parts[0]):
        width = (k + 1 if k < HEAD else 2) + 1
        cols = [np.concatenate([p[at + i] if i else np.cumsum(p[at]) for p in parts]) for i in range(width)]
        sizes = [len(p[at]) for p in parts]
        if k < HEAD:
            steps = []
            head = cols[0]
            for c in cols[1:-2]:  # number the path prefix by prefix, so that a key stays in 64 bits
                u, head = np.unique((head << _SHIFT) | c, return_inverse=True)
                steps.append(u)
            uniq, state, sums = _sums((head << _SHIFT) | cols[-2], cols[-1])
            stays = sums >= least
            path, up = [uniq[stays] & low], uniq[stays] >> _SHIFT
            for u in reversed(steps):
                path.append(u[up] & low)
                up = u[up] >> _SHIFT
            names = np.stack([up, *reversed(path)], axis=1)
        else:
            up = state[cols[0] + np.repeat(offsets, sizes)]
            live = np.flatnonzero(stays[up])
            uniq, inv, sums = _sums((up[live] << _SHIFT) | cols[1][live], cols[2][live])
            name_of = np.cumsum(stays) - 1
            state = np.full(len(up), len(uniq))  # one more state for all that went
            state[live] = inv
            stays = sums >= least
            names = np.column_stack([names[name_of[uniq[stays] >> _SHIFT]], uniq[stays] & low])
        yield names, sums[stays]
        stays = np.append(stays, False)
        offsets = (np.cumsum(sizes) - sizes).tolist()
        at, k = at + width, k + 1


def text_shards(src: DataFrame, shard_bytes: int) -> DataFrame:
    """(shard, lang, tokens, words, counts): packed word numbers, the distinct words and their counts of each shard and language."""
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("tokens", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size, shard = 0, TaskContext.get().partitionId() << 32

        def flush():
            for lang, bufs in held.items():
                ids, words = tokens(b"\n".join(bufs))
                if len(ids):
                    counts = np.bincount(ids, minlength=len(words) + 1)[1:]
                    cols = [shard], [lang], [packed([ids])], [words.cast(pa.large_string()).to_pylist()], [counts]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
            held.clear()

        for b in sliced(batches, "text"):
            for lang, t in zip(b.column("lang").to_pylist(), text_bytes(b.column("text"))):
                t = t.translate(_TABLE)
                at = 0
                while at < len(t):  # a long text goes in portions that end with a piece
                    end = t.find(b"\n", at + shard_bytes - size) if at + shard_bytes - size < len(t) else -1
                    end = len(t) if end < 0 else end
                    held[lang].append(t[at:end])
                    size, at = size + end - at + 1, end + 1
                    if size >= shard_bytes:
                        yield from flush()
                        size, shard = 0, shard + 1
        yield from flush()

    return src.mapInArrow(run, "shard long, lang string, tokens binary, words array<string>, counts array<long>")


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows with dense numbers ``id`` from 0 in the given order, without a sort in one task."""
    ranged = written(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "numbered")
    sizes = ranged.groupBy("pid").agg(F.count("*").alias("c"))  # a row per partition
    first = sizes.select("pid", (F.sum("c").over(Window.orderBy("pid")) - F.col("c")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy(*order))
    return ranged.join(first, "pid").withColumn("id", (F.col("first") + rank - 1).cast("int")).drop("pid", "first")


def phrase_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
                  shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, m, phrase, f): phrases of m words with f >= ``least`` occurrences; m = 0 holds all word occurrences."""
    src = df.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    ranges = shard_count(src, "text", range_bytes)
    shards = written(text_shards(src, shard_bytes), "phrase-shards")
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select(
        "shard", "lang", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    total = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("f"))
    # frequent words get small numbers, which pack well
    vocab = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min(least, 2))
    vocab = written(numbered(vocab, F.desc("f"), "lang", "word"), "phrase-words")
    mine = (words.select("shard", "lang", "local", "word").join(vocab.select("lang", "word", "id"), ["lang", "word"])
            .groupBy("shard", "lang").agg(F.collect_list("local").alias("local"), F.collect_list("id").alias("id")))

    def shard_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                stream, = unpacked(b.column("tokens")[i].as_py())
                local, ids = (b.column(c)[i].values.to_numpy() for c in ("local", "id"))
                number = np.full(int(stream.max()) + 1, -1, np.int64)
                number[local + 1] = ids
                got = list(cut(automaton(number[stream], longest), ranges))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in got], pa.int32()), pa.array([b.column("lang")[i].as_py()] * len(got), pa.string()),
                                                  pa.array([s for _, s in got], pa.binary())], ["range", "lang", "states"])

    def unite(table: pa.Table) -> pa.Table:
        blobs = defaultdict(list)
        for lang, s in zip(table.column("lang").to_pylist(), table.column("states").to_pylist()):
            blobs[lang].append(s)
        langs, paths, f = [], [], []
        for lang in sorted(blobs):
            for names, sums in united(blobs[lang], least):
                langs += [lang] * len(names)
                paths += names.tolist()
                f += sums.tolist()
        return pa.table([pa.array(langs, pa.string()), pa.array(paths, pa.list_(pa.int32())), pa.array(f, pa.int64())], names=["lang", "path", "f"])

    states = shards.select("shard", "lang", "tokens").join(mine, ["shard", "lang"]).select("lang", "tokens", "local", "id").mapInArrow(
        shard_states, "range int, lang string, states binary")
    found = written(states.groupBy("range").applyInArrow(unite, "lang string, path array<int>, f long"), "phrase-paths")
    spelled = (found.select("lang", "path", "f", F.posexplode("path").alias("at", "id")).join(vocab.select("id", "word"), "id")
               .groupBy("lang", "path", "f").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
               .select("lang", F.size("path").alias("m"), F.array_join("w.word", " ").alias("phrase"), "f"))
    return written(spelled.union(vocab.where(F.col("f") >= least).select("lang", F.lit(1), "word", "f")).union(total.select("lang", F.lit(0), F.lit(""), "f")), "phrase-counts")


def exact_ratio(scale: int, a: str, n: str, left: str, right: str) -> Column:
    """floor(scale * a * n / (left * right)) with 38 digits on the way."""
    def wide(c):
        return f"CAST({c} AS DECIMAL(19,0))"
    return F.expr(f"CAST(CAST({scale} AS DECIMAL(10,0)) * {wide(a)} * {wide(n)} AS DECIMAL(38,0)) div "
                  f"CAST({wide(left)} * {wide(right)} AS DECIMAL(38,0))")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST,
                 top: int = TOP, cover: int = 100, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    A phrase goes if a longer candidate around it has at least ``cover`` percent of its occurrences. A longer phrase's
    occurrences are no more than those of any phrase between the two, so phrases one word longer tell.
    """
    grams = phrase_counts(df, text_col, lang_col, longest, least, shard_bytes, range_bytes)
    n = grams.where("m = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    cand = grams.where("m >= 2").select("lang", "m", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    around = (cand.where("m >= 3")
              .select("lang", F.col("a").alias("around"),
                      F.explode(F.array(F.array_join(F.expr("slice(w, 1, m - 1)"), " "), F.array_join(F.expr("slice(w, 2, m - 1)"), " "))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    cand = cand.join(around, ["lang", "phrase"], "left").where(f"around IS NULL OR 100 * around < {int(cover)} * a")
    cuts = (cand.select("lang", "phrase", "a", "w", "m", F.explode(F.expr("sequence(1, m - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("first"),
                    F.array_join(F.expr("slice(w, k + 1, m - k)"), " ").alias("rest")))
    part = grams.where("m >= 1")
    cuts = (cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
            .join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
            .join(n, "lang")
            .select("lang", "phrase", "a", "n", F.struct(exact_ratio(1000, "a", "n", "l", "r").alias("score"), "k", "l", "r").alias("c")))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("c").alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))
            .withColumn("rank", F.row_number().over(order).cast("long")).where(f"rank <= {int(top)}")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
