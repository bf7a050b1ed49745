"""Substring de-duplication with automata of recurring phrases.

Every window of ``WINDOW`` words has one anchor: its phrase of ``PHRASE`` words with the smallest hash, the
leftmost if tied. Equal windows have equal anchors, so only anchors that occur twice can belong to repeated windows.
Consecutive windows with the same anchor form a segment.

1. Each shard sends its distinct segments (anchor hash, digest of the words, place of one occurrence, count). A
   segment counted twice or more is a confirmed recurring passage. A segment counted once whose anchor
   recurs is uncertain: its windows are compared one by one with those of the other segments of that anchor.
2. The passages of a shard are read from their place in its own texts. Their anchor phrases are compiled into
   Aho-Corasick automata (words are the letters; an automaton holds ``PHRASES`` phrases at most), all texts of
   the shard are streamed through them, and at each hit the whole passage is compared word by word. The words of
   every occurrence are covered, and covered words are removed.

Shards are runs of rows of a file, so their size does not grow with the input and each text meets only the
automata of its own shard; confirmation is global. Copies within a shard collapse before any
shuffle; joins on an anchor or a segment can be split by Spark when one is hot, and segments are counted by partial sums.
Passages of different shards are equal if a 128-bit BLAKE2b digest of their words is; the rolling word and anchor
hashes only bring candidates together. Within a shard the words themselves are compared before anything is removed.

Edge cases: a null text has no words and gives an empty text. Texts shorter than a window stay whole; kept
words are joined by single spaces. Windows that repeat within one text or overlap count like any others. Rows sharing an id are rows of their
own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARD_ROWS, by_shard, placed, sliced, text_bytes, text_or_empty, written

WINDOW, PHRASE = 35, 8
#: Phrases of one automaton; its words are pairs of LETTERS x LETTERS letters (nodes with few children are searched fast).
PHRASES, LETTERS = 100_000, 512
#: Segments a task holds before it sends them.
HELD = 1_000_000
#: Stands for words that no phrase of the automaton holds.
OTHER = "\0\0"
KNOWN = re.compile("[^\0]+")

_rng = np.random.default_rng(35)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASES = [0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any spans of a sequence from prefix sums (arithmetic modulo 2^64)."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power = np.full(n + 1, base, dtype=np.uint64)
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        power[0] = inverse[0] = 1
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * np.cumprod(power)[:-1], out=self.sums[1:])
        self.inverse = np.cumprod(inverse)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


class Words:
    """The words of some texts, joined by single spaces."""

    def __init__(self, body: bytes, start: np.ndarray, end: np.ndarray):
        self.body = b" ".join(body.split())
        after = np.cumsum(end - start + 1)
        self.start, self.end = after - (end - start + 1), after - 1

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128-bit digests (two numbers a row) of the words first .. last - 1."""
        body = memoryview(self.body)
        out = [blake2b(body[i:j], digest_size=16).digest() for i, j in zip(self.start[first].tolist(), self.end[last - 1].tolist())]
        return np.frombuffer(b"".join(out), dtype="<i8").reshape(-1, 2)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Words]:
    """A hash of every word of the texts, the texts' first words (one more entry: the number of words), and the words."""
    body = b" ".join([*texts, b""])
    raw = np.frombuffer(body, dtype=np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.r_[True, blank, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    h = Rolling(_BYTE[raw], _BASES[0]).span(start, end) if len(raw) else np.zeros(0, dtype=np.uint64)
    offsets = np.r_[0, np.cumsum([len(t) + 1 for t in texts])].astype(np.int64)
    return h, np.searchsorted(start, offsets), Words(body, start, end)


def segments(texts: list[bytes], window: int, phrase: int) -> dict[str, np.ndarray]:
    """Segments of the texts: hi (anchor), d1 and d2 (digest), doc (number of the text), start, windows, left (anchor's place)."""
    h, first, words = word_hashes(texts)
    n, places = len(h), window - phrase + 1
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    ends = first[1:][doc] if n else np.zeros(0, dtype=np.int64)
    at = np.arange(n)
    roll = Rolling(h, _BASES[1])
    g = np.full(n + places, np.iinfo(np.uint64).max, dtype=np.uint64)
    ok = at + phrase <= ends
    g[:n][ok] = roll.span(at[ok], at[ok] + phrase)
    best, arg, width = g, np.arange(n + places), 1
    while width < places:  # leftmost smallest among ``places`` places, by doubling
        step = min(width, places - width)
        take = best[step:] < best[:-step]
        # beyond the end nothing is smaller; those entries are never used
        best = np.r_[np.where(take, best[step:], best[:-step]), best[len(best) - step:]]
        arg = np.r_[np.where(take, arg[step:], arg[:-step]), arg[len(arg) - step:]]
        width += step
    valid, arg = at + window <= ends, arg[:n]
    new = valid & np.r_[True, (arg[1:] != arg[:-1]) | ~valid[:-1]][:n]
    start = np.flatnonzero(new)
    stop = np.flatnonzero(valid & np.r_[(arg[1:] != arg[:-1]) | ~valid[1:], True][:n]) + 1
    windows, left = stop - start, arg[start] - start
    d = words.digests(start, start + windows + (window - 1))
    return {"hi": g[arg[start]].view(np.int64), "d1": d[:, 0], "d2": d[:, 1], "doc": doc[start], "start": start - first[doc[start]], "windows": windows, "left": left}


def pack(doc, start, windows, left):
    """A place in a shard as one number: 12 bits of row, 36 of word, 7 of windows, 7 of the anchor's offset."""
    return ((doc.astype(np.int64) << 36 | start.astype(np.int64)) << 7 | windows.astype(np.int64)) << 7 | left.astype(np.int64)


def unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return at >> 50, (at >> 14) & ((1 << 36) - 1), (at >> 7) & 127, at & 127


def shard_segments(src: DataFrame, window: int, phrase: int) -> DataFrame:
    """(hi, d1, d2, _shard, at, n): the distinct segments of each shard with the place of one and their number."""
    def run(batches):
        held, count, shard = [], 0, None

        def flush():
            c = [np.concatenate(x) for x in zip(*held)]
            order = np.lexsort((c[2], c[1], c[0]))
            hi, d1, d2, at = (x[order] for x in c)
            first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
            n = np.diff(np.r_[first, len(hi)])
            return pa.RecordBatch.from_arrays([pa.array(hi[first]), pa.array(d1[first]), pa.array(d2[first]), pa.array(np.full(len(first), shard, dtype=np.int64)),
                                               pa.array(at[first]), pa.array(n.astype(np.int64))], ["hi", "d1", "d2", "_shard", "at", "n"])

        for b in sliced(batches, "_t"):
            shards = b.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if shards[i] != shard or count > HELD:
                    if count:
                        yield flush()
                    held, count, shard = [], 0, shards[i]
                part = b.slice(i, j - i)
                s = segments(text_bytes(part.column("_t")), window, phrase)
                rows = part.column("_row").to_numpy() % SHARD_ROWS
                held.append((s["hi"], s["d1"], s["d2"], pack(rows[s["doc"]], s["start"], s["windows"], s["left"])))
                count += len(s["hi"])
        if count:
            yield flush()

    return src.select("_shard", "_row", "_t").mapInArrow(run, "hi long, d1 long, d2 long, _shard long, at long, n long")


def text_blocks(src: DataFrame) -> DataFrame:
    """(_shard, block): the rows of a shard in compressed blocks (Arrow streams) of a few MB of text."""
    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in sliced(batches, "_t"):
            shards = b.column("_shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = pa.RecordBatch.from_arrays([b.column(c).slice(i, j - i) for c in ("_id", "_row", "_t")], ["_id", "_row", "_t"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([int(shards[i])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                 ["_shard", "block"])

    return src.select("_shard", "_id", "_row", "_t").mapInArrow(run, "_shard long, block binary")


def opened(block: bytes) -> tuple[pa.Array, np.ndarray, list[bytes]]:
    """A block's ids, rows within the shard, and texts."""
    t = pa.ipc.open_stream(block).read_all().combine_chunks().to_batches()[0]
    return t.column("_id"), t.column("_row").to_numpy() % SHARD_ROWS, text_bytes(t.column("_t"))


def with_blocks(pointers: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pointers (_shard, hi, at, weight) and the text blocks, shard by shard, pointers first."""
    none = F.lit(None)
    return by_shard(pointers.select("_shard", F.lit(0).alias("_kind"), "hi", "at", "weight", none.cast("binary").alias("block")),
                    blocks.select("_shard", F.lit(1), none.cast("long"), none.cast("long"), none.cast("long"), "block"))


def shards_of(batches):
    """(shard, [hi, at, weight] as arrays, blocks) of one shard after the other."""
    shard, pointers, blocks = None, [], []

    def done():
        cols = [np.concatenate(x) for x in zip(*pointers)] if pointers else [np.zeros(0, dtype=np.int64)] * 3
        return shard, cols, blocks

    for b in batches:
        if not b.num_rows:
            continue
        shards, kinds = b.column("_shard").to_numpy(), b.column("_kind").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if shards[i] != shard:
                if shard is not None:
                    yield done()
                shard, pointers, blocks = shards[i], [], []
            if kinds[i]:
                blocks += b.column("block").slice(i, j - i).to_pylist()
            else:
                pointers.append([b.column(c).slice(i, j - i).to_numpy() for c in ("hi", "at", "weight")])
    if shard is not None:
        yield done()


def window_rows(pointers: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """(d1, d2, _shard, at, hi, weight): the windows of the segments pointed at, distinct within a shard."""
    def run(batches):
        for shard, (hi, at, weight), shard_blocks in shards_of(batches):
            if not len(at):
                continue
            doc, start, windows, left = unpack(at)
            out = []
            for block in shard_blocks:
                _, rows, texts = opened(block)
                place = np.full(SHARD_ROWS, -1)
                place[rows] = np.arange(len(rows))
                mine = np.flatnonzero(place[doc] >= 0)
                if not len(mine):
                    continue
                used = np.unique(place[doc[mine]])
                _, first, words = word_hashes([texts[k] for k in used.tolist()])
                base = first[np.searchsorted(used, place[doc[mine]])] + start[mine]
                rep = np.repeat(mine, windows[mine])
                k = np.arange(len(rep)) - np.repeat(np.r_[0, np.cumsum(windows[mine])][:-1], windows[mine])
                s = np.repeat(base, windows[mine]) + k
                d = words.digests(s, s + window)
                out.append((d[:, 0], d[:, 1], hi[rep], pack(doc[rep], start[rep] + k, np.ones_like(k), left[rep] - k), weight[rep]))
            if not out:
                continue
            a, w, hi, p, n = (np.concatenate(x) for x in zip(*out))
            order = np.lexsort((w, a))
            a, w, hi, p, n = a[order], w[order], hi[order], p[order], n[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (w[1:] != w[:-1])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[first]), pa.array(w[first]), pa.array(np.full(len(first), shard, dtype=np.int64)), pa.array(p[first]),
                 pa.array(hi[first]), pa.array(np.add.reduceat(n, first))], ["d1", "d2", "_shard", "at", "hi", "weight"])

    return with_blocks(pointers, blocks).mapInArrow(run, "d1 long, d2 long, _shard long, at long, hi long, weight long")


def letters_of(i: int) -> str:
    """The i-th word as two letters of different ranges, so a match can only begin at a word."""
    return chr(0x100 + i // LETTERS) + chr(0x1000 + i % LETTERS)


def automata(passages: dict[tuple, dict]) -> list[tuple[dict, ahocorasick.Automaton]]:
    """Automata over the anchor phrases, each with its own letters for words."""
    out = []
    letters, auto = {}, ahocorasick.Automaton()
    for phrase, spans in passages.items():
        if len(auto) >= PHRASES or len(letters) + len(phrase) > LETTERS ** 2:
            out.append((letters, auto))
            letters, auto = {}, ahocorasick.Automaton()
        for w in phrase:
            if w not in letters:
                letters[w] = letters_of(len(letters))
        auto.add_word("".join(map(letters.__getitem__, phrase)), spans)
    if len(auto):
        out.append((letters, auto))
    for _, a in out:
        a.make_automaton()
    return out


def passages_of(at: np.ndarray, shard_blocks: list[bytes], window: int, phrase: int) -> dict[tuple, dict]:
    """Anchor phrase -> {(words before it, length): passages}, read at the places pointed at."""
    doc, start, windows, left = unpack(at)
    order = np.argsort(doc, kind="stable")
    doc, start, windows, left = doc[order], start[order], windows[order], left[order]
    out: dict[tuple, dict] = {}
    for block in shard_blocks:
        _, rows, texts = opened(block)
        lo, hi = np.searchsorted(doc, rows), np.searchsorted(doc, rows, side="right")
        for t, i, j in zip(texts, lo.tolist(), hi.tolist()):
            if i == j:
                continue
            words = t.split()
            for s, n, a in zip(start[i:j].tolist(), windows[i:j].tolist(), left[i:j].tolist()):
                size = n + window - 1
                spans = out.setdefault(tuple(words[s + a:s + a + phrase]), {})
                spans.setdefault((a, size), set()).add(b" ".join(words[s:s + size]))
    return out


def cover(words: list[bytes], machines: list, phrase: int) -> bytearray:
    """One byte a word: 1 where an occurrence of a passage covers it."""
    mask = bytearray(len(words))
    for letters, auto in machines:
        text = "".join(map(letters.get, words, repeat(OTHER)))
        for run in KNOWN.finditer(text):  # no phrase holds a word without letters
            for end, spans in auto.iter(text, run.start(), run.end()):
                p = (end + 1) // 2 - phrase
                for (before, size), known in spans.items():
                    a = p - before
                    if a >= 0 and a + size <= len(words) and 0 in mask[a:a + size] and b" ".join(words[a:a + size]) in known:
                        mask[a:a + size] = b"\x01" * size
    return mask


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(id, n_words, n_removed, text): the kept words joined by one space."""
    if not (1 <= phrase <= window and window - phrase < 64):
        raise ValueError("a phrase must fit the window, which may be 63 words longer at most")
    src = placed(df, F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))
    found = written(shard_segments(src, window, phrase), "op5-segments")
    recurring = found.groupBy("hi").agg(F.sum("n").alias("a")).where("a > 1").select("hi")
    recurring = written(recurring, "op5-anchors")
    segment = ["hi", "d1", "d2"]
    kept = found.join(recurring, "hi")
    sums = kept.groupBy(*segment).agg(F.sum("n").alias("s"), F.min(F.struct("_shard", "at")).alias("one"))
    kept = written(kept.join(sums, segment).withColumn("first", F.struct("_shard", "at") == F.col("one")).drop("one"), "op5-recurring")
    unsure = written(kept.groupBy("hi").agg(F.min("s").alias("least")).where("least = 1").select("hi"), "op5-unsure")
    pointers = (kept.where("s = 1 OR first").join(unsure, "hi")
                .select("_shard", "hi", "at", F.least(F.col("s"), F.lit(2)).alias("weight")))
    blocks = text_blocks(src)
    windows = written(window_rows(pointers, blocks, window), "op5-windows")
    repeated = windows.groupBy("d1", "d2").agg(F.sum("weight").alias("total")).where("total > 1").select("d1", "d2")
    again = windows.join(repeated, ["d1", "d2"])
    places = (kept.where("s > 1").select("_shard", "hi", "at", F.lit(1).cast("long").alias("weight"))
              .union(again.select("_shard", "hi", "at", "weight")))

    def run(batches):
        for _, (_, at, _), shard_blocks in shards_of(batches):
            machines = automata(passages_of(at, shard_blocks, window, phrase)) if len(at) else []
            for block in shard_blocks:
                ids, _, texts = opened(block)
                n, gone, out = [], [], []
                for t in texts:
                    words = t.split()
                    mask = cover(words, machines, phrase)
                    removed = mask.count(1)
                    n.append(len(words))
                    gone.append(removed)
                    out.append(b" ".join([w for w, m in zip(words, mask) if not m] if removed else words))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary())],
                                                 ["_id", "n_words", "n_removed", "_kept"])

    kind = src.schema["_id"].dataType.simpleString()
    out = with_blocks(places, blocks).mapInArrow(run, f"_id {kind}, n_words long, n_removed long, _kept binary")
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("_kept").cast("string").alias(text_col))
