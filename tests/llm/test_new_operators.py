"""Spelling variants, mixing and collocations against brute force on awkward rows, and on an empty table."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curio.llm import collocations as col
from curio.llm import mixing as mix
from curio.llm import spelling as spell
from tests.llm.util import SCHEMA, awkward, frame

ROWS = awkward()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


# --- spelling variants -----------------------------------------------------------------------

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i:] == b[i + 1:] or a[i + 1:] == b[i:]


def brute_variants(rows, one_in=97, min_count=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= min_count}
    form, out = {}, {}
    for w, c in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * c else None
        out[w] = (form[w], c, len(close), words[form[w]] if form[w] else None)

    def root(w):
        return root(form[w]) if form[w] else w
    return {w: (f, root(w), c, k, fn) for w, (f, c, k, fn) in out.items()}


def got_variants(df, **kw):
    rows = spell.spelling_variants(df, **kw).collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("one_in", [97, 2])
def test_spelling_variants(docs, empty, one_in):
    want = brute_variants(ROWS, one_in)
    assert got_variants(docs, one_in=one_in) == want and len(want) > 5
    assert spell.spelling_variants(empty).count() == 0


def test_spelling_chains_and_accents(spark):
    r = random.Random(5)
    base = ["naïveté", "accommodate", "grâce", "aaaaa", "abcdefghij", "z" * 3000]
    texts = []
    for w in base:
        for depth, copies in enumerate([40, 20, 10, 5, 3, 3]):
            texts += [w] * copies
            at = r.randrange(len(w))
            w = [w[:at] + w[at + 1:], w[:at] + "é" + w[at + 1:], w[:at] + "q" + w[at:]][depth % 3]
    rows = [(k, t.upper() if k % 7 == 0 else t) for k, t in enumerate(texts)]
    df = frame(spark, rows)
    want = brute_variants(rows)
    got = got_variants(df)
    assert got == want
    assert any(f and g and want[g][0] for w, (f, g, *_) in want.items() if f) or any(v[0] and v[0] != v[1] for v in want.values())


@settings(max_examples=25, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), max_size=40))
def test_near_pairs(spark, words):
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    got = [(r["a"], r["b"]) for r in spell.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    want = {frozenset(p) for p in product(words, words) if near(*p)}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)


# --- mixing ----------------------------------------------------------------------------------

def test_targets():
    assert mix.targets([100, 100, 100], [1, 1, 1], 1.5, 2) == [150, 150, 150]
    assert mix.targets([10, 100, 100], [3, 1, 2], 1.5, 2) == [20, (315 - 20) / 3, (315 - 20) * 2 / 3]
    # the excess of the first puts the second above its limit in turn
    got = mix.targets([10, 60, 1000], [10, 10, 1], 1.5, 2)
    assert got[:2] == [20, 120] and got[2] == 1605 - 140
    assert mix.targets([0, 0], [3, 1], 1.5, 2) == [0, 0] and mix.targets([], [3], 1.5, 2) == []


def best_sum(sizes, counts, goal):
    sums = {0}
    for s, c in zip(sizes, counts):
        sums = {x + s * k for x in sums for k in range(c + 1)}
    return min(abs(x - goal) for x in sums)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), max_size=6, unique_by=lambda p: p[0]), st.integers(0, 200))
def test_fit_reaches_the_nearest_sum(pairs, goal):
    sizes, counts = [p[0] for p in pairs], [p[1] for p in pairs]
    goal = min(goal, sum(s * c for s, c in pairs))
    take = mix.fit_counts(sizes, counts, goal)
    assert all(0 <= t <= c for t, c in zip(take, counts))
    assert abs(sum(s * t for s, t in zip(sizes, take)) - goal) == best_sum(sizes, counts, goal)


def test_fit_takes_the_sum_above_where_it_is_nearer():
    assert mix.fit_counts([1, 6], [1, 1], 4) == [0, 1]
    assert mix.fit_counts([1, 8], [1, 1], 4) == [1, 0] and mix.fit_counts([3, 8], [1, 1], 4) == [1, 0]
    assert mix.fit_counts([2, 30, 31], [1, 1, 1], 20) == [0, 1, 0]


def test_fit_large_is_exact():
    r = random.Random(2)
    sizes = sorted({r.randrange(1, 20000) for _ in range(3000)})
    counts = [r.randrange(1, 2000) for _ in sizes]
    total = sum(s * c for s, c in zip(sizes, counts))
    for goal in (1, total // 3, total - 1, total):
        take = mix.fit_counts(sizes, counts, goal)
        got = sum(s * t for s, t in zip(sizes, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and abs(got - goal) <= min(sizes)


def check_mix(df, seed=1, **kw):
    got = [r.asDict() for r in mix.mix_sources(df, seed=seed, **kw).collect()]
    by = defaultdict(list)
    for r in got:
        by[r["source_size"], r["target"]].append(r)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    return got, by


def test_mix_sources(spark, docs, empty):
    rows = [(i, t, "en", s, 0, 0.5, "x", 1) for k, (i, t) in enumerate(ROWS) for s in (["a", "B", "é", None, ""][k % 5],)]
    rows += [(1000 + i, " ".join(["w"] * (i % 50)), "en", "hot", 0, 0.5, "x", 1) for i in range(3000)]
    rows += [(7, "one two three", "en", "hot", 0, 0.5, "x", 1)] * 500
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    size = defaultdict(int)
    n = Counter()
    for r in rows:
        words = len(re.findall("[^\x20\x09-\x0D]+", r[1] or ""))
        size[r[3]] += words
        n[r[0], words] += 1
    order = sorted((s for s in size if s is not None)) + [None]
    goal = dict(zip(order, mix.targets([size[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5, 2)))
    got, _ = check_mix(df)
    assert Counter((r["doc_id"], r["size"]) for r in got) == n
    sums = defaultdict(int)
    for r in got:
        sums[r["source_size"], r["target"]] += r["taken"]
    want = Counter((size[s], goal[s]) for s in order)
    assert set(sums) == set(want)
    assert abs(sums[size["hot"], goal["hot"]] - goal["hot"]) <= 1
    again, _ = check_mix(df.repartition(3))
    assert Counter(map(str, got)) == Counter(map(str, again))
    other, _ = check_mix(df, seed=2)
    assert Counter(map(str, got)) != Counter(map(str, other))
    assert mix.mix_sources(empty).count() == 0


def test_mix_one_hot_id(spark):
    """Copies of one row under one id, and rows without an id: exactly the needed number is taken."""
    rows = [(5, "a b c d", "en", "s", 0, 0.5, "x", 1)] * 400 + [(None, "a b c d", "en", "s", 0, 0.5, "x", 1)] * 200
    rows += [(k, "x", "en", "t", 0, 0.5, "x", 1) for k in range(100)]
    got, by = check_mix(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert len(got) == 700
    for (_, target), rs in by.items():
        assert abs(sum(r["taken"] for r in rs) - target) <= max(r["size"] for r in rs) / 2


# --- collocations ----------------------------------------------------------------------------

def brute_collocations(rows, longest=5, least=100, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, g in f.items():
        cand = {p: a for p, a in g.items() if len(p) >= 2 and a >= least}
        gone = set()
        for q, b in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    if b * 100 >= 100 * cand[q[i:i + m]]:
                        gone.add(q[i:i + m])
        scored = []
        for p, a in cand.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (g[p[:k]] * g[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), g[p[:k]], g[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got_collocations(df, **kw):
    return sorted(tuple(r) for r in col.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


LANGS = ["en", None, "und", "fr", ""]


def spoken(spark, rows):
    data = [(i, t, LANGS[k % 5], "s", 0, 0.5, "x", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3), [(r[2], r[1]) for r in data]


@pytest.mark.parametrize("shard,rng", [(1 << 23, 1 << 23), (300, 200)])
def test_collocations(spark, empty, shard, rng):
    r = random.Random(3)
    words = ["The", "of", "new", "york", "é", "日本", "a\x00b", "CITY", "x"]
    rows = ROWS + [(k, " ".join(r.choice(words) + r.choice(["", "", "", ",", "\t", ".\n", "?!"]) for _ in range(r.randrange(60)))) for k in range(120)]
    rows += [(k, "new york city hall of the") for k in range(30)]
    df, plain = spoken(spark, rows)
    for least, top in ((3, 2000), (9, 5)):
        want = brute_collocations(plain, least=least, top=top)
        assert got_collocations(df, least=least, top=top, shard_bytes=shard, range_bytes=rng) == want and want
    if shard > 1000:
        assert got_collocations(empty) == []


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_collocations_other_lengths(spark, longest):
    df, plain = spoken(spark, ROWS)
    assert got_collocations(df, longest=longest, least=2, shard_bytes=4000, range_bytes=2000) == brute_collocations(plain, longest, 2)


def test_exact_ratio(spark):
    big = 9_000_000_000_000
    rows = [(big, big * 3, big + 1, big + 2), (7, big, 3, 1), (100, 10**17, 10**9, 10**9)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long").select("*", col.exact_ratio(1000, "a", "n", "l", "r").alias("s"))
    assert [r["s"] for r in df.collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]
