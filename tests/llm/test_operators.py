"""Each training-data operator against a brute-force version on awkward rows, and on an empty table."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from curio.llm import decontaminate as dc
from curio.llm import exact_dedup as ed
from curio.llm import graph
from curio.llm import line_dedup as ld
from curio.llm import lm
from curio.llm import records as rec
from curio.llm import sentencepieces as sp
from curio.llm import sharding as sh
from curio.llm import simhash as sim
from curio.llm import substring_dedup as ss
from curio.llm import toxicity as tox
from curio.llm.queries import model_path
from tests.llm.util import awkward, frame, key, prose

ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def digest(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


# --- exact dedup -----------------------------------------------------------------------------

@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, empty, weak):
    kw = {"key": lambda c: F.pmod(F.octet_length(c), F.lit(3)).cast("long"), "capacity": 1} if weak else {"capacity": 4}
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    got = ed.exact_dedup(docs, **kw).collect()
    assert len(got) == len(ROWS)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), digest(t or "")) for i, t in ROWS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    if weak:  # texts that share a key are chained, each with a place of its own
        chains = defaultdict(set)
        for r in got:
            chains[len(dict.fromkeys([r["text_sha256"]])), r["text_sha256"]].add(r["chain"])
        assert all(len(c) == 1 for c in chains.values()) and max(r["chain"] for r in got) > 0
    assert ed.exact_dedup(empty).count() == 0


def test_directory_doubles_and_shares_buckets(spark):
    keys = (spark.range(3000).select(F.xxhash64("id").alias("_h"))
            .union(spark.range(500).select(F.shiftleft("id", 50)))).distinct()  # crowded at the low end
    n = keys.count()
    slots, depth = ed.directory(keys, 64)
    held = (keys.withColumn("slot", ed.prefix("_h", depth)).join(slots, "slot")
            .groupBy("bucket", "local_depth").count().collect())
    assert sum(r["count"] for r in held) == n and max(r["count"] for r in held) <= 64
    assert depth > 6 and min(r["local_depth"] for r in held) < depth


def test_index_tasks_hold_whole_buckets(spark):
    d = spark.range(20000).select(F.col("id").alias("_id"), F.col("id").cast("string").alias("_t"))
    keyed = d.select("_id", F.col("_id").alias("_u"), F.xxhash64("_t").alias("_h"), F.unhex(F.sha2("_t", 256)).alias("_sha"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index, slots, depth = ed.build_index(keyed, d.select(F.xxhash64("_t").alias("_h"), "_t"), 1024)
        placed = index.withColumn("file", F.input_file_name()).groupBy("_first").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(placed) > 8 and depth > 3 and sum(r["n"] for r in placed) == 20000
    assert {r["files"] for r in placed} == {1} and max(r["n"] for r in placed) <= 1024
    assert {r["_first"] for r in placed} == {r["_first"] for r in slots.collect()}


# --- sharding --------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 100, 997])
def test_permutation_is_one_to_one(spark, n):
    p = [r[0] for r in spark.range(n).select(sh.permute(F.col("id"), n, 7)).collect()]
    assert sorted(p) == list(range(n))
    assert n < 50 or p != sorted(p)


def test_shards(docs, empty):
    got = sh.shard_rows(docs, shards=5, seed=3).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    sizes = [len(slots[k]) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["row"])] == sorted((i for i, _ in ROWS), key=key)
    assert {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sh.shard_rows(docs.repartition(2), shards=5, seed=3).collect()} \
        == {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got}
    assert sh.shard_rows(empty).count() == 0


# --- tokenising ------------------------------------------------------------------------------

def test_sentencepiece(docs, empty):
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=model_path("piece_bpe_32k.model"))
    want = Counter()
    for i, t in ROWS:
        ids = p.encode(t or "", add_bos=True, add_eos=True)
        want[i, len(ids), np.array(ids, dtype="<u4").tobytes(), p.decode(ids)] += 1
    got = sp.encode_texts(docs, model_path("piece_bpe_32k.model")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert sp.encode_texts(empty, model_path("piece_bpe_32k.model")).count() == 0


def test_sentencepiece_table_is_bounded():
    proto = open(model_path("piece_bpe_32k.model"), "rb").read()
    codec = sp.ChunkCodec(proto, table_size=10)
    texts = [prose(k, 40) for k in range(20)]
    for t in texts:
        ids, back = codec.apply([t])
        assert back == [t] and np.frombuffer(ids[0], "<u4").tolist() == codec.sp.encode(t, add_bos=True, add_eos=True)
        assert len(codec.ids) <= 10 + 41


def test_crc32c():
    assert hex(rec.crc32c([b"123456789"])[0]) == "0xe3069283"
    parts = [bytes(range(256))[: 4 + k] * 3 for k in range(60)]
    assert rec.crc32c(parts).tolist() == [rec.crc32c([p])[0] for p in parts]


def test_records(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer
    path = model_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    index = rec.write_records(docs, path, f"file://{tmp_path}/r", shard_bytes=60_000)
    got = sorted(rec.read_records(spark, f"file://{tmp_path}/r", chunk=1000).collect(), key=lambda r: r["start"])
    assert [r["id"] for r in got] == sorted((i for i, _ in ROWS), key=key)
    want = Counter((i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()) for i, t in ROWS)
    assert Counter((r["id"], bytes(r["ids"])) for r in got) == want
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    some = index.where("length > 100").first()  # the index finds a record without the others
    with open(rec.shard_path(f"{tmp_path}/r", some["shard"]), "rb") as f:
        f.seek(some["offset"])
        frame_ = f.read(some["length"])
    (i, ids), = rec.parse_frames(frame_)[0]
    assert i == some["id"] and len(ids) == 4 * some["n_tokens"]
    assert struct.unpack_from("<Q", frame_)[0] == some["length"] - 16
    with pytest.raises(ValueError):
        rec.parse_frames(frame_[:40] + bytes([frame_[40] ^ 1]) + frame_[41:])
    rec.write_records(empty, path, f"file://{tmp_path}/e")
    assert rec.read_records(spark, f"file://{tmp_path}/e").count() == 0


# --- substring and line dedup ----------------------------------------------------------------

def brute_words(window):
    words = [(i, (t or "").encode().split()) for i, t in ROWS]
    seen = Counter(tuple(w[k:k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        out[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


@pytest.mark.parametrize("window,phrase", [(35, 8), (5, 2), (8, 8)])
def test_substring_dedup(docs, empty, window, phrase):
    got = ss.remove_repeats(docs, window=window, phrase=phrase).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute_words(window)
    assert ss.remove_repeats(empty).count() == 0


def test_substring_dedup_compares_the_words(spark):
    """Long regular two-letter words collide under any polynomial hash modulo 2^64; their windows differ all the same."""
    a, b = "x", "y"
    for _ in range(12):
        a, b = a + b, b + a
    rest = " ".join(f"w{k}" for k in range(34))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest} more"), (4, f"{b}\n{rest} tail of it")]
    h = ss.word_hashes([a.encode(), b.encode()])[0]
    assert a != b and h[0] == h[1]
    alone = ss.remove_repeats(frame(spark, rows[:2])).collect()
    assert [r["n_removed"] for r in alone] == [0, 0]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in ss.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: (35, ""), 3: (35, "more"), 2: (35, ""), 4: (35, "tail of it")}


def test_substring_dedup_many_automata(docs, monkeypatch):
    monkeypatch.setattr(ss, "PHRASES", 3)
    at = np.zeros(0, dtype=np.int64)
    assert ss.automata(ss.passages_of(at, [], 35, 8)) == []
    phrases = {tuple(w.encode() for w in prose(k, 4).split()): {(0, 4): {prose(k, 4).encode()}} for k in range(10)}
    machines = ss.automata(phrases)
    assert len(machines) == 4
    words = (prose(50, 5) + " " + prose(3, 4) + " " + prose(51, 5) + " " + prose(8, 4)).encode().split()
    assert bytes(ss.cover(words, machines, 4)) == bytes([0] * 5 + [1] * 4 + [0] * 5 + [1] * 4)


def test_line_dedup(docs, empty):
    order = sorted(ROWS, key=lambda r: key(r[0]))
    got = ld.dedup_lines(frame(docs.sparkSession, [r for r in order if r[0] not in (None, 25, 26)])).collect()
    first, want = {}, Counter()
    for i, t in order:
        if i in (None, 25, 26):
            continue
        lines = (t or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k:k + 3])
            if first.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        want[i, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)] += 1
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in got) == want
    assert ld.dedup_lines(docs).count() == len(ROWS)
    assert ld.dedup_lines(empty).count() == 0


# --- language model --------------------------------------------------------------------------

def brute_lm():
    """Scores by the plain dictionary form of the trie and by counting words."""
    train = [t or "" for i, t in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    trie, words = lm.AdaptiveTrie(), Counter()
    for t in train:
        b = t.encode().lower()
        words.update([*b.split(), b"\n"])
        for ctx, s in trie.symbols(b):
            trie.learn(ctx, s)
    n, v = sum(words.values()), len(words)
    out = []
    for i, t in ROWS:
        b = (t or "").encode().lower()
        tokens = [*b.split(), b"\n"]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append(((i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(tokens), sum(words[w] > 0 for w in tokens), n), base,
                    trie.length(b, False)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_sent", [lm.MAX_SENT, 0])
def test_ppm(docs, empty, max_sent):
    got = sorted((((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]), r["base_score"], r["score"])
                  for r in lm.score_texts(docs, max_sent=max_sent).collect()), key=repr)
    want = brute_lm()
    assert Counter(g[0] for g in got) == Counter(w[0] for w in want)
    for k in (1, 2):
        assert np.allclose(sorted(g[k] for g in got), sorted(w[k] for w in want), rtol=1e-9)
    assert lm.score_texts(empty, max_sent=max_sent).count() == 0


def test_ppm_is_a_distribution():
    trie = lm.AdaptiveTrie(2)
    for ctx, s in trie.symbols(b"abracadabra"):
        trie.learn(ctx, s)
    for ctx in [(97, 98), (98, 114), (120, 121), (256, 256)]:
        total = sum(10 ** trie.cost(ctx, s) for s in [*range(256), lm.END])
        assert abs(total - 1) < 1e-9


def test_adaptive_learns_while_reading(spark):
    d = frame(spark, [(1, "ab" * 200), (2, prose(1, 57)[:400]), (3, None)])
    got = {r["doc_id"]: r["score"] for r in lm.adaptive_lengths(d).collect()}
    assert got[1] > got[2] and abs(got[3] - math.log10(1 / 257)) < 1e-9


# --- toxicity --------------------------------------------------------------------------------

def test_toxicity_learns_and_counterfactuals_pull_groups_together(spark):
    bad, good, rows, labels = "rotten vile nasty".split(), "kind warm calm".split(), [], []
    for k in range(600):
        toxic = k % 2
        body = prose(k, 20) + " " + (bad if toxic else good)[k % 3]
        # in the labelled sample one group's name goes with toxic texts
        group = "muslim" if (toxic and k % 4 == 1) or k % 40 == 0 else "christian" if k % 3 == 0 else ""
        rows.append((k, f"{body} {group}"))
        labels.append((k, 1, toxic))
    d = frame(spark, rows)
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    probe = frame(spark, [(1, "a muslim neighbour"), (2, "a christian neighbour"), (3, "vile " + prose(1, 5)), (4, "calm " + prose(2, 5)), (5, None), (6, "")])
    gap = {}
    for cf in (0.0, 5.0):
        model = tox.train(d, lab, cf=cf)
        s = {r["doc_id"]: r["score"] for r in tox.score(probe, model, score_col="toxic_score").select("doc_id", F.col("toxic_score").alias("score")).collect()}
        assert s[3] > 0.7 > 0.5 > s[4] and s[5] == s[6] and 0 <= s[5] <= 1
        logit = {k: math.log(v / (1 - v)) for k, v in s.items()}
        gap[cf] = abs(logit[1] - logit[2])
    assert gap[0.0] > 0.5 and gap[5.0] < 0.4 * gap[0.0]


def test_toxicity_edges(docs, empty):
    spark = docs.sparkSession
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = tox.train(docs, none)
    out = tox.score(docs, model, score_col="toxic_score")
    assert {r["toxic_score"] for r in out.collect()} == {0.5} and out.columns == [*docs.columns, "toxic_score"]
    assert tox.score(empty, model, score_col="toxic_score").count() == 0
    one = spark.createDataFrame([(4, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r["toxic_score"] < 1 for r in tox.score(docs, tox.train(docs, one), score_col="toxic_score").collect())


# --- decontamination -------------------------------------------------------------------------

def shingles(t):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_decontamination(docs, empty):
    spark = docs.sparkSession
    long = dict(r for r in ROWS if r[0] is not None)[21].split()
    items = [(1, prose(1, 60)), (2, " ".join(long[5000:5030]).upper().replace(" ", ", ")), (3, "one"), (4, ""), (5, None), (6, prose(99, 40)),
             (7, " ".join(long[100:140]) + " " + prose(98, 6)), (8, " ".join(long[200:230]) + " " + prose(97, 12)), (8, "beta"), (None, "a b"), (9, prose(1, 60))]
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    by_id, by_doc = defaultdict(set), defaultdict(set)
    for i, t in items:
        by_id[i] |= shingles(t)
    for i, t in ROWS:
        by_doc[i] |= shingles(t)
    for i, q in by_id.items():
        for d, s in by_doc.items():
            if i is not None and d is not None and q and len(q & s) / len(q) >= 0.8:
                want[i, d] = (len(q), len(q & s))
    got = {(r["item_id"], r["doc_id"]): (r["n_item"], r["n_found"]) for r in dc.contained_items(docs, b).collect()}
    assert got == want and {(1, 12), (2, 21), (3, 4), (3, 6), (7, 21)} <= set(got) and (8, 21) not in got
    left = dc.decontaminate(docs, b)
    bad = {d for _, d in want}
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(i for i, _ in ROWS if i not in bad) and left.columns == docs.columns
    assert dc.contained_items(empty, b).count() == 0
    assert dc.contained_items(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_computes_no_unused_size(spark):
    items = spark.createDataFrame([(1, prose(1, 60))], "_item long, _text string")
    assert dc.shingle_rows(items, ["_item"], "_text").columns == ["_item", "w0", "w1", "w2", "w3", "w4"]
    assert dc.item_sketches(items, 0.8)[1].columns == ["h", "_item", "m", "need"]


# --- SimHash ---------------------------------------------------------------------------------

def plain_fingerprint(t):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(fps, bits=3):
    """A number for each fingerprint, equal within a component."""
    root = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    return root


def components(fps, ids, bits=3):
    root = roots_of(fps, bits)
    return [min((ids[k] for k in range(len(fps)) if root[k] == r and ids[k] is not None), default=None) for r in root]


def test_simhash(docs, empty):
    fps = [plain_fingerprint(t) for _, t in ROWS]
    ids = [i for i, _ in ROWS]
    want = Counter(zip(ids, (f"{f:016x}" for f in fps), components(fps, ids)))
    got = sim.simhash_components(docs).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(set(roots_of(fps)))
    assert sim.simhash_components(empty).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_simhash_links_of_dense_groups(spark, block, monkeypatch):
    monkeypatch.setattr(sim, "BLOCK", block)
    r = np.random.default_rng(5)
    fps = {0, (1 << 64) - 1}
    for base in r.integers(0, 1 << 63, 12, dtype=np.uint64).tolist():
        for _ in range(12):
            x = base
            for b in r.integers(0, 64, 2):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    classes = spark.createDataFrame([(x,) for x in signed], "_fp long")
    roots = {x["node"]: x["root"] for x in graph.connected_components(sim.links(classes, 3)).collect()}
    mine = components(fps, list(range(len(fps))))
    groups = defaultdict(set)
    for k, s in enumerate(signed):
        groups[roots.get(s, s)].add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(k for k in range(len(fps)) if mine[k] == c) for c in set(mine))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}


def plain_toxicity(y, rows, pairs, cf, feats, l2=1e-4):
    """Newton steps on the loss of ``toxicity.fit`` over the features ``feats``."""
    x = np.array([[float(f in set(r.tolist())) for f in feats] for r in rows])
    d = np.array([[float(f in v) - float(-1 - f in v) for f in feats] for _, v in pairs]).reshape(-1, len(feats))
    n, n1 = len(y), y.sum()
    each = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))
    x1 = np.c_[x, np.ones(n)]
    quad = np.zeros((len(feats) + 1,) * 2)
    quad[:-1, :-1] = 2 * l2 * np.eye(len(feats)) + 2 * cf * d.T @ d / max(1, len(pairs))
    v = np.zeros(len(feats) + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ v))
        v = v - np.linalg.solve((x1 * (each * p * (1 - p))[:, None]).T @ x1 + quad + 1e-12 * np.eye(len(v)),
                                x1.T @ (each * (p - y)) + quad @ v)
    return v[-1], v[:-1]


def toxic_sample(n=300):
    """Texts whose toxic ones name one group more often than the others."""
    r = np.random.default_rng(4)
    y = (r.random(n) < 0.4).astype(float)
    texts = []
    for c in y:
        w = list(r.choice(["table", "river", "green", "paper", "stone"], 6))
        w += ["vile"] * int(r.random() < (0.6 if c else 0.1)) + ["filth"] * int(r.random() < (0.5 if c else 0.05))
        w += ["muslim"] * int(r.random() < (0.4 if c else 0.1)) + ["christian"] * int(r.random() < 0.2)
        texts.append(" ".join(w))
    return y, texts


@pytest.mark.parametrize("cf", [0.0, 1.0, 20.0])
def test_toxicity_fit_equals_a_plain_optimiser(cf):
    y, texts = toxic_sample()
    f, maps = tox.Featuriser(), tox.swaps()
    bags = [set(tox.words(t.encode())) for t in texts]
    rows = [f(b) for b in bags]
    swapped = [(i, f({m.get(w, w) for w in b})) for m in maps for i, b in enumerate(bags) if b & set(maps[0])]
    pairs = [(i, np.array([*(set(rows[i].tolist()) - set(v.tolist())), *(-1 - k for k in set(v.tolist()) - set(rows[i].tolist()))])) for i, v in swapped]
    assert pairs and all(len(d) for _, d in pairs)
    always = tox.term_features(tox.IDENTITY_GROUPS)
    bias, feats, w = tox.fit(y, rows, pairs, cf, steps=20000, always=always)
    assert np.isin(feats, always).sum() == 2
    pb, pw = plain_toxicity(y, rows, pairs, cf, feats)
    assert abs(bias - pb) < 1e-3 and np.abs(w - pw).max() < 1e-3


def test_toxicity_penalty_acts(spark):
    """With the penalty the name of a group moves a score less, and the classes are still told apart."""
    y, texts = toxic_sample(600)
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id long, toxic int")
    probe = frame(spark, [(0, "paper muslim river"), (1, "paper christian river"), (2, "paper river"), (3, "vile filth river")])
    gap, hit = [], []
    for cf in (0.0, 20.0):
        model = tox.train(docs, labels, cf=cf)
        got = {r["doc_id"]: r["score"] for r in tox.score(probe, model).collect()}
        gap.append(abs(got[0] - got[1]))
        hit.append(got[3])
    assert gap[1] < 0.5 * gap[0] and min(hit) > 0.7


def test_toxicity_bounds_rows_of_one_id_and_keeps_clashing_columns(spark):
    y, texts = toxic_sample(200)
    docs = frame(spark, [(i, t) for i, t in enumerate(texts)] + [(7, texts[0] + f" {k}") for k in range(500)])
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)] * 3 + [(7, 0), (7, 1)], "doc_id long, toxic int")
    seen = []
    keep = tox.featurise
    try:
        tox.featurise = lambda df, g: seen.append(df.groupBy("doc_id").count().agg(F.max("count")).first()[0]) or keep(df, g)
        model = tox.train(docs, labels)
    finally:
        tox.featurise = keep
    assert seen == [tox.MAX_PER_ID]
    odd = docs.withColumn("_scored_text", F.lit("kept")).withColumn("_SCORED_TEXT_", F.lit(1))
    got = tox.score(odd, model, score_col="p")
    assert got.columns == [*odd.columns, "p"] and got.where("_scored_text = 'kept'").count() == odd.count()


def test_bpe_table_equals_the_library_on_hard_cuts_and_with_a_tiny_table():
    from tokenizers import Tokenizer
    spec = Path(model_path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    library = Tokenizer.from_str(spec)
    texts = ["", " a", "\n", "a\n", "a\n\nb", "a \nb", "a  b", "b\t", "b\t c", "x b\t", "\nfoo bar", "\n foo", "é\n　z q", "q 　 r",
             "a\nb\nc d\n\ne f", "x\r\ny z", "it's \n's x\n's", "a\xad b c", "​z y", "a <|endoftext|> b", "can't' x", " ab!!'s", "q it!'s",
             "z foo,'ll bar", "q ×a! ÷b! ×", "Wort### Wort, Wort!? Wort", "one two. one two, one",
             "über Straße, Ñandú où él! ªº µm ŷes ʼn", "Größe Größe. größe\nÀ-ÿ z"]
    table = rec.BpeTable(spec, 0, table_size=5)
    for step in (1, 4, len(texts)):
        for i in range(0, len(texts), step):
            some = texts[i:i + step]
            want = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4").tobytes() for t in some]
            assert table.apply(some) == want


def traced_peak(call):
    """What ``call`` gives and the most bytes that it held at once."""
    import tracemalloc
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_feature_choice_holds_counts_not_all_rows_at_once():
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 50_000, 600)).astype(np.int32) for _ in range(3000)]
    y = (r.random(3000) < 0.2).astype(np.float64)
    rows = [np.union1d(x, [7, 50_001]).astype(np.int32) if v else x for x, v in zip(rows, y)]
    got, peak = traced_peak(lambda: tox.select_features(y, rows, np.array([11, 60_000])))
    assert peak < sum(x.nbytes for x in rows)

    def g2(f):
        n = len(y)
        held = np.array([f in x for x in rows])
        out = 0.0
        for here in (held, ~held):
            for label in (y > 0, y == 0):
                seen = (here & label).sum()
                out += 2 * seen * np.log(seen * n / (here.sum() * label.sum())) if seen else 0
        return out, held.sum()
    assert {7, 11, 50_001} <= set(got.tolist()) and 60_000 not in got and got.dtype == np.int32
    probe = [*got.tolist()[:10], *range(100, 110)]
    assert [f in got for f in probe] == [f == 11 or (g2(f)[0] >= tox.MIN_G2 and g2(f)[1] >= tox.MIN_DOCS) for f in probe]
    assert tox.select_features(np.array([0.0, 1.0]), [np.zeros(0, np.int32)] * 2, np.array([1])).tolist() == []


def test_scoring_sends_texts_to_python_once(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id long, text string")
    model = (-1.0, {f: 2.0 for f in tox.word_features(b"alpha")})
    out = tox.score(d, model)
    got = {r["doc_id"]: (r["text"], r["score"]) for r in out.collect()}
    assert out.columns == ["doc_id", "text", "score"] and [got[i][0] for i in (1, 2, 3)] == ["alpha beta", None, ""]
    assert got[1][1] > 0.9 and got[2][1] == got[3][1] == 1 / (1 + np.exp(1.0))
    assert "_scored_text" not in out._jdf.queryExecution().analyzed().toString()
    # other types are still read as text
    n = tox.score(d.select("doc_id", F.lit(5).alias("text")), model)
    assert n.schema["text"].dataType.simpleString() == "int" and {r["score"] for r in n.collect()} == {got[2][1]}


def test_encoding_holds_small_pieces_of_a_batch():
    import pyarrow as pa
    proto = Path(model_path("piece_bpe_32k.model")).read_bytes()
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(2000)) for i in range(400)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(401)), pa.array([t or "" for t in texts])], ["_id", "_t"])
    codec = sp.ChunkCodec(proto)

    def run():
        n = 0
        for b in sp.encode_batches(iter([batch]), codec):
            n += b.num_rows
        return n
    n, peak = traced_peak(run)
    assert n == 401 and peak < 16 * sum(len(t or "") for t in texts)
    first = next(sp.encode_batches(iter([batch]), codec))
    assert np.frombuffer(first.column("ids")[3].as_py(), "<u4").tolist() == codec.sp.encode(texts[3], add_bos=True, add_eos=True)
