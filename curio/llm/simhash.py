"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes (position, value). Two fingerprints that differ in at most
three bits differ in at most three bytes, so they share at least 8 - 3 = 5 positional bytes. Any five of
the eight positions hold three of one half, so the pair meets in at least one posting list of three
bytes of a half (2 x C(4,3) = 8 lists per fingerprint, 24 bits each). Within a list the shared
positional bytes of each pair are tallied, pairs below the guaranteed minimum are dropped, the rest is verified by
counting differing bits. A list's verified pairs leave the task as stars of their local components
(as many rows as fingerprints at most). Equal fingerprints are one class before any list is built, and a list
longer than ``BLOCK`` is dealt out as pairs of blocks, so no task holds an unbounded list.

Edge cases: a null text counts as empty; no words give fingerprint zero, which is linked like any
other; fewer words than ``width`` give one shingle. Rows that share an id are rows of their own. A null id is never a
component's smallest id unless the component has no other. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_bytes, text_or_empty, written
from .graph import connected_components

WIDTH, MAX_BITS = 3, 3
#: Fingerprints of one posting list compared at once in a task; longer lists are dealt out in block pairs.
BLOCK = 1024
SEED = 42
#: Shingles turned into bit counts at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash of one text."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + width]) for i in range(len(w) - width + 1)] if len(w) > width else [b" ".join(w)]
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), CHUNK):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i:i + CHUNK]], dtype="<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(shingles), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(_id, _u, _fp): ``_u`` numbers the input rows."""
    src = df.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_u"), text_or_empty(text_col).alias("_t"))

    def run(batches):
        for b in sliced(batches, "_t"):
            fps = np.array([fingerprint(t, width) for t in text_bytes(b.column("_t"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_u"), pa.array(fps)], ["_id", "_u", "_fp"])

    return written(src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, _u long, _fp long"), "op10-rows")


def local_stars(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Verified links among the fingerprints of one posting list, as stars of their components."""
    n = len(fps)
    raw = fps.view(np.uint8).reshape(-1, 8)
    left, out = np.arange(n), []
    while len(left):
        root, members, frontier = left[0], [left[0]], left[:1]
        left = left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for i in frontier:
                rest = np.flatnonzero(~near)
                tally = (raw[left[rest]] == raw[i]).sum(axis=1)
                rest = rest[tally >= 8 - max_bits]
                near[rest[np.bitwise_count(fps[left[rest]] ^ fps[i]) <= max_bits]] = True
            frontier = left[near]
            members.extend(frontier)
            left = left[~near]
        out += [(int(fps[root]), int(fps[m])) for m in members[1:]]
    return out


def links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) links that join the distinct fingerprints within ``max_bits`` bits into components."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the posting lists guarantee links of at most three bits")
    byte = lambda j: F.shiftright("_fp", 8 * j).bitwiseAND(255)
    lists = [g for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for g in combinations(half, 3)]
    keys = [sum(((byte(j) * (1 << 8 * k)) for k, j in enumerate(g)), F.lit(i << 24)).cast("long") for i, g in enumerate(lists)]
    postings = classes.select("_fp", F.explode(F.array(*keys)).alias("_key"))
    sizes = postings.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1")
    sized = postings.join(sizes, "_key").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    dealt = (sized.withColumn("_i", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .select("_key", F.least("_i", "_j").alias("_lo"), F.greatest("_i", "_j").alias("_hi"), "_fp"))
    group = ["_key", "_lo", "_hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        held: list[np.ndarray] = []  # of the list that may go on in the next batch
        held_key = None
        for b in batches:
            k = np.stack([b.column(c).to_numpy().astype(np.int64) for c in group], axis=1)
            fps = b.column("_fp").to_numpy().view(np.uint64)
            if not len(fps):
                continue
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            edges: list[tuple[int, int]] = []
            for part, key in zip(np.split(fps, cuts), k[np.r_[0, cuts]].tolist()):
                if key != held_key:
                    if held:
                        edges += local_stars(np.concatenate(held), max_bits)
                    held, held_key = [], key
                held.append(part)
            yield batch(edges)
        if held:
            yield batch(local_stars(np.concatenate(held), max_bits))

    def batch(edges):
        e = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id, kept): ``kept`` marks one row of each component, the smallest id."""
    rows = with_fingerprints(df, id_col, text_col, width)
    classes = written(rows.groupBy("_fp").agg(F.min(F.struct(F.col("_id").isNull().alias("_no"), "_id", "_u")).alias("_first")),
                      "op10-classes")
    roots = connected_components(links(classes.select("_fp"), max_bits))
    rooted = (classes.join(roots, classes["_fp"] == roots["node"], "left")
              .select("_fp", "_first", F.coalesce("root", "_fp").alias("_root")))
    best = rooted.groupBy("_root").agg(F.min("_first").alias("_best"))
    classes = written(rooted.join(best, "_root").select("_fp", "_best"), "op10-components")
    return (rows.join(classes, "_fp")
            .select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                    F.col("_best._id").alias("component_id"), (F.col("_u") == F.col("_best._u")).alias("kept"), "_u"))
