"""Token ids in length-delimited binary records with a separate offset index.

A shard file is a run of frames: payload length (8 bytes), masked CRC-32C of these 8 bytes, payload,
masked CRC-32C of the payload; all numbers are little-endian. A payload is a flag byte (1: has an id), the document id (8 bytes), the width
of an id in bytes (2 or 4), then the token ids. Documents are range-partitioned by id, so shards and
the documents in them are in ascending id order. A task writes its shard under a name of its own attempt and then
renames it, so a retried or speculative task leaves one whole file. The index is a Parquet table
(shard, place, id, offset, length, n_tokens): a shuffled reader seeks any record with it.

Texts are encoded with a table of distinct chunks (see ``BpeTable``), exactly as the library does.

Edge cases: a null text counts as empty (the end id only). A null id is stored as such and sorts
first. Rows that share an id keep the order of the input. An empty table writes no shard and reads no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from itertools import chain, count
from pathlib import Path
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import shard_count, sliced, text_or_empty

SHARD_BYTES = 16 << 20
TABLE_SIZE = 400_000
POLY = 0x82F63B78  # CRC-32C, reflected
STEP = 64  # bytes that one vector step of the checksum takes from every record


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLY), t >> 1)
    return t


def _shift_tables(step: int, table: np.ndarray) -> list[np.ndarray]:
    """What ``step`` zero bytes make of each byte of a checksum."""
    out = []
    for k in range(4):
        c = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
        for _ in range(step):
            c = table[c & 255] ^ (c >> np.uint32(8))
        out.append(c)
    return out


TABLE = _byte_table()
SHIFT = _shift_tables(STEP, TABLE)


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings (4 bytes or more each) at once.

    Leading zeros do not change a checksum that starts at zero, so strings are padded in front to whole steps;
    the usual start value is the same as inverting the first four bytes.
    """
    if not parts:
        return np.zeros(0, dtype=np.uint32)
    size = np.array([len(p) for p in parts], dtype=np.int64)
    blocks = -(-size // STEP)
    first = np.r_[0, np.cumsum(blocks)]
    buf = np.zeros(int(first[-1]) * STEP, dtype=np.uint8)
    ends = first[1:] * STEP
    for p, e in zip(parts, ends.tolist()):
        buf[e - len(p):e] = np.frombuffer(p, dtype=np.uint8)
    start = ends - size
    for k in range(4):
        buf[start + k] ^= 255
    cols = np.ascontiguousarray(buf.reshape(-1, STEP).T)
    c = np.zeros(cols.shape[1], dtype=np.uint32)
    for col in cols:
        c = TABLE[(c ^ col) & 255] ^ (c >> np.uint32(8))
    order = np.argsort(-blocks, kind="stable")
    at, left = first[:-1][order], blocks[order]
    total = np.zeros(len(parts), dtype=np.uint32)
    for i in range(int(left[0])):
        n = int(np.searchsorted(-left, -i, side="left"))  # records with more than i blocks
        t = total[:n]
        total[:n] = SHIFT[0][t & 255] ^ SHIFT[1][(t >> 8) & 255] ^ SHIFT[2][(t >> 16) & 255] ^ SHIFT[3][t >> 24] ^ c[at[:n] + i]
    out = np.empty_like(total)
    out[order] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    c = crc.astype(np.uint32)
    return ((c >> np.uint32(15)) | (c << np.uint32(17))) + np.uint32(0xA282EAD8)


def _byte_letters() -> list[str]:
    """The character that a byte-level model shows for each byte: itself if visible, else the next one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = count(256)
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def strings(col: pa.Array) -> list[str]:
    return col.to_numpy(zero_copy_only=False).tolist()


class BpeTable:
    """Encodes texts with a ``tokenizers`` model through a table of distinct chunks.

    A text is cut at single spaces and before single newlines between two visible characters: a byte-level splitting
    pattern always begins a token there (and ends one after the newline), so each chunk can be encoded alone. A new chunk
    of letters is one part of that pattern and goes to the library's model directly. Others without
    white space are encoded many at a time, one to a line: the newline between two of them is
    always a token of its own. Texts that name an added token are encoded whole.
    """

    VISIBLE = "!-~¡-¬®-ɏ"
    CUT = re.compile(f"(?<=[{VISIBLE}])(?: (?=[{VISIBLE}])|(?=\n[{VISIBLE}]))")
    PLAIN = re.compile(f" ?[{VISIBLE}]+").fullmatch
    PART = re.compile(f"\n?[{VISIBLE}](?:[^ \n]*[{VISIBLE}])?").fullmatch
    HEAD = re.compile(f"[^ \n]*[{VISIBLE}]").fullmatch
    LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
    LATIN = re.compile(LETTERS).fullmatch
    LINES = 40

    def __init__(self, spec: str, end_id: int, table_size: int = TABLE_SIZE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.end = np.array([end_id], dtype="<u4").tobytes()
        self.first: dict[str, bytes] = {}  # chunks that begin a text
        self.rest: dict[str, bytes] = {}  # chunks that follow a space, without it, or that begin with a newline
        self.odd: dict[str, bytes] = {}  # chunks of the latter kind that a plain split may not cut out
        self.old: dict[str, bytes] = {}  # the last full ``rest``
        self.table_size = table_size
        d = json.loads(spec)
        pre = d.get("pre_tokenizer") or {}
        self.chunked = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                        and not d.get("normalizer") and not d["model"].get("dropout"))
        self.added = [a["content"] for a in d.get("added_tokens") or [] if a["content"]]
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        self.newline = self.ids("\n")
        self.shown = dict(enumerate(_byte_letters()))
        self.space, self.model = self.shown[32], self.tok.model

    def word(self, x: str) -> bool:
        """Letters only: with a space before, the splitting pattern makes one part of it, and parts it from marks after it."""
        return x.isalpha() and (x.isascii() or self.LATIN(x) is not None)

    def word_ids(self, x: str) -> bytes:
        """The ids of a space and a word, straight from the library's model: the word is one part, so it needs no split."""
        shown = x if x.isascii() else x.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(self.space + shown)]).tobytes()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, table: dict[str, bytes], new: list[str], before: str) -> None:
        """Encode chunks that follow ``before`` (a space or nothing) into ``table``."""
        if before:
            words = set(filter(self.word, new))
            table.update(zip(words, map(self.word_ids, words)))
            new = [c for c in new if c not in words]
        plain = [c for c in new if self.PLAIN(c)] if len(self.newline) == 1 else []
        groups = [plain[i:i + self.LINES] for i in range(0, len(plain), self.LINES)]
        for e, some in zip(self.tok.encode_batch_fast([before + ("\n" + before).join(g) for g in groups], add_special_tokens=False), groups):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.newline[0])
            raw, cuts = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            table.update(zip(some, [raw[4 * (a + 1):4 * b] for a, b in zip(cuts, cuts[1:])]))
        other = [c for c in new if c not in table]
        for c, e in zip(other, self.tok.encode_batch_fast([before + c for c in other], add_special_tokens=False)):
            table[c] = np.array(e.ids, dtype="<u4").tobytes()

    def add(self, new: set[str], odd: set[str], heads: set[str]) -> None:
        """Put chunks that are not in the tables yet into them: ``new`` into ``rest``, ``odd``, and ``heads`` into ``first``."""
        old = self.old
        moved = [x for x in new if x in old]
        self.rest.update((x, old[x]) for x in moved)
        new = new.difference(moved)
        odd = odd.difference(self.odd)
        parted = [(x, w, x[len(w):]) for x in new if len(w := x.rstrip(punctuation)) < len(x) and self.word(w)]
        new.difference_update([x for x, _, _ in parted])
        words = {w for _, w, _ in parted if w not in self.rest}
        self.rest.update((w, old[w]) for w in words if w in old)
        new.update(w for w in words if w not in old)
        begin = heads.union((x[1:] for x in chain(new, odd) if x[0] == "\n"), (m for _, _, m in parted))
        self.learn(self.first, [h for h in begin if h not in self.first], "")
        newline = self.newline.tobytes()
        for table, some in ((self.rest, new), (self.odd, odd)):
            table.update((x, newline + self.first[x[1:]]) for x in some if x[0] == "\n")
            self.learn(table, [x for x in some if x[0] != "\n"], " ")
        self.rest.update((x, self.rest[w] + self.first[m]) for x, w, m in parted)

    def parted(self, chunks: pa.Array, names: list[str]) -> tuple[np.ndarray, list[str], list[bool], np.ndarray, list[str]]:
        """Words apart from the marks after them; other chunks stay whole.

        Each chunk's place among the stems, the distinct stems, whether a stem is a word, each chunk's place among the
        distinct marks, and these (the first is empty).
        """
        bare = pc.utf8_rtrim(chunks, characters=punctuation)
        word = pc.match_substring_regex(bare, f"^{self.LETTERS}$")
        stem = pc.if_else(word, bare, chunks).dictionary_encode()
        stemmed = stem.indices.to_numpy().astype(np.int64)
        words = np.zeros(len(stem.dictionary), dtype=bool)
        words[stemmed[word.to_numpy(zero_copy_only=False)]] = True
        left = pc.subtract(pc.binary_length(chunks), pc.binary_length(stem.dictionary).take(stem.indices)).to_numpy()
        tails, marks = {"": 0}, np.zeros(len(names), dtype=np.int64)
        some = np.flatnonzero(left)
        marks[some] = [tails.setdefault(names[i][-k:], len(tails)) for i, k in zip(some.tolist(), left[some].tolist())]
        return stemmed, strings(stem.dictionary), words.tolist(), marks, list(tails)

    def apply(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text with the end id, little-endian unsigned 32-bit.

        All texts are cut by a plain split, marks at the end of words parted from them, and distinct stems looked up once;
        the ids are then taken by the chunks' places. Texts that a plain split may not cut go through ``careful``.
        """
        col = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        if not self.chunked:
            return [self.ids(t).tobytes() + self.end for t in col.to_pylist()]
        if not len(col):
            return []
        if len(self.rest) > self.table_size:
            self.old, self.rest = self.rest, {}
        if len(self.first) + len(self.odd) > self.table_size:
            self.first.clear()
            self.odd.clear()
        cut = pc.split_pattern(pc.replace_substring(col, "\n", " \n"), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        size, at = np.diff(bounds), bounds[:-1]
        distinct = cut.values.dictionary_encode()
        codes, names = distinct.indices.to_numpy(), strings(distinct.dictionary)
        stemmed, stems, words, marks, tails = self.parted(distinct.dictionary, names)
        inner = np.ones(len(codes), dtype=bool)
        inner[at] = False
        begin, used = codes[at], np.zeros(len(names), dtype=bool)
        used[codes[inner]] = True
        known = list(map(self.rest.get, stems))
        bad = np.zeros(len(stems), dtype=bool)
        bad[[i for i in np.unique(stemmed[used]).tolist() if known[i] is None and not words[i] and not self.PART(stems[i])]] = True
        bad_head = np.zeros(len(names), dtype=bool)
        bad_head[[i for i in np.unique(begin).tolist() if not self.HEAD(names[i])]] = True
        slow = np.logical_or.reduceat(bad[stemmed][codes] & inner, at) | bad_head[begin]
        for a in self.added:
            slow |= pc.match_substring(col, a).to_numpy(zero_copy_only=False)
        whole = np.repeat(~slow, size)
        used[:] = False
        used[codes[whole & inner]] = True
        heads = np.unique(begin[~slow])
        miss = [i for i in np.unique(stemmed[used]).tolist() if known[i] is None]
        first, old = self.first, self.old
        self.rest.update((x, old[x] if x in old else self.word_ids(x)) for x in (stems[i] for i in miss if words[i]))
        self.add({stems[i] for i in miss if not words[i]}, set(), {names[i] for i in heads.tolist()}.union(tails))
        for i in miss:
            known[i] = self.rest[stems[i]]
        inside = pc.binary_join_element_wise(pa.array(known, pa.large_binary()).take(pa.array(stemmed)),
                                             pa.array([first[m] if m else b"" for m in tails], pa.large_binary()).take(pa.array(marks)),
                                             pa.scalar(b"", pa.large_binary()))
        place = codes.astype(np.int64)
        place[at] = len(names) + np.searchsorted(heads, begin)
        values = pa.concat_arrays([inside, pa.array([first[names[i]] for i in heads.tolist()], pa.large_binary())])
        taken = values.take(pa.array(place[whole]))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1)[np.cumsum(np.r_[0, size[~slow]])].tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        fast = (b"".join((raw[i:j], self.end)) for i, j in zip(ends, ends[1:]))
        rest = iter(self.careful(col.filter(pa.array(slow)).to_pylist()))
        return [next(rest if s else fast) for s in slow.tolist()]

    def careful(self, texts: list[str]) -> list[bytes]:
        """``apply`` for texts that are cut one by one, or encoded whole."""
        heads, cut, odd, new = [], [], set(), set()
        for t in texts:
            h, *c = [None] if any(a in t for a in self.added) else self.CUT.split(t)
            heads.append(h)
            cut.append(c)
            for x in c:
                if not self.PART(x):
                    odd.add(x)
                elif x not in self.rest:
                    new.add(x)
        self.add(new, odd, {h for h in heads if h is not None})
        odd, rest = self.odd, self.rest
        return [b"".join((self.ids(t).tobytes() if h is None else self.first[h], *[rest[x] if x in rest else odd[x] for x in c], self.end))
                for t, h, c in zip(texts, heads, cut)]


_TABLES: dict[tuple, BpeTable] = {}


def bpe_table(spec: str, end_id: int) -> BpeTable:
    """The table of this worker process; later tasks go on with it."""
    key = (hash(spec), end_id)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = BpeTable(spec, end_id)
    return _TABLES[key]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def shard_path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:06d}.rec"


def frames(ids: list, tokens: list[bytes], width: int) -> list[bytes]:
    """One frame per document."""
    payloads = [struct.pack("<BqB", i is not None, i or 0, width)
                + (np.frombuffer(t, dtype="<u4").astype(f"<u{width}").tobytes() if width != 4 else t) for i, t in zip(ids, tokens)]
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    a, b = masked(crc32c(heads)).tolist(), masked(crc32c(payloads)).tolist()
    return [b"".join((h, struct.pack("<I", x), p, struct.pack("<I", y))) for h, x, p, y in zip(heads, a, payloads, b)]


def write_records(df: DataFrame, tokenizer_path: str, root: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode, write shard files and the index below ``root``; returns the index table."""
    spec = Path(tokenizer_path).read_text(encoding="utf-8")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("_u"), text_or_empty(text_col).alias("_t"))
    n = shard_count(df, text_col, shard_bytes)
    ordered = src.repartitionByRange(n, "id", "_u").sortWithinPartitions("id", "_u").drop("_u")

    def run(batches):
        ctx = TaskContext.get()
        shard = ctx.partitionId()
        bpe, out, offset, place, fs, tmp = None, None, 0, 0, None, None
        for b in sliced(batches, "_t"):
            if out is None:
                bpe = bpe_table(spec, end_id)
                fs, path = filesystem(root)
                fs.create_dir(path, recursive=True)
                tmp = f"{path}/.attempt-{shard}-{ctx.taskAttemptId()}"
                out = fs.open_output_stream(tmp)
            ids, tokens = b.column("id").to_pylist(), bpe.apply(b.column("_t"))
            recs = frames(ids, tokens, bpe.width)
            size = np.array([len(r) for r in recs], dtype=np.int64)
            out.write(b"".join(recs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), shard, dtype=np.int64)), pa.array(np.arange(place, place + len(ids), dtype=np.int64)),
                 pa.array(ids, pa.int64()), pa.array(offset + np.cumsum(size) - size), pa.array(size),
                 pa.array([len(t) // 4 for t in tokens], pa.int64())], ["shard", "place", "id", "offset", "length", "n_tokens"])
            offset, place = offset + int(size.sum()), place + len(ids)
        if out is not None:
            out.close()
            fs.move(tmp, shard_path(path, shard))

    index = ordered.mapInArrow(run, "shard long, place long, id long, offset long, length long, n_tokens long")
    index.write.parquet(f"{root}/index")
    return df.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


def parse_frames(buf: bytes) -> tuple[list[tuple[int | None, bytes]], int]:
    """(id, ids as 32-bit) of the whole frames in ``buf`` and how many bytes they take; checks both checksums."""
    at, heads, payloads, sums = 0, [], [], []
    while at + 12 <= len(buf):
        size = struct.unpack_from("<Q", buf, at)[0]
        if at + 16 + size > len(buf):
            break
        heads.append(buf[at:at + 8])
        payloads.append(buf[at + 12:at + 12 + size])
        sums.append((struct.unpack_from("<I", buf, at + 8)[0], struct.unpack_from("<I", buf, at + 12 + size)[0]))
        at += 16 + size
    if heads:
        want = np.array(sums, dtype=np.uint32)
        if (masked(crc32c(heads)) != want[:, 0]).any() or (masked(crc32c(payloads)) != want[:, 1]).any():
            raise ValueError("a record's checksum does not match")
    out = []
    for p in payloads:
        has, i, width = struct.unpack_from("<BqB", p)
        out.append((i if has else None, np.frombuffer(p, dtype=f"<u{width}", offset=10).astype("<u4").tobytes()))
    return out, at


def read_records(spark: SparkSession, root: str, chunk: int = 4 << 20) -> DataFrame:
    """(id, start, n_tokens, ids, shard, place) of every record, read from the shard files in order.

    ``start`` counts the ids of all documents before it: the shards' totals come from the index, one row per shard.
    """
    index = spark.read.parquet(f"{root}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("records"))
    base = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    shards = totals.withColumn("base", base)  # one row per shard file
    shards = shards.repartitionByRange(max(1, totals.count()), "shard")  # a task per file

    def run(batches):
        for b in batches:
            for shard, records, start in zip(*(b.column(c).to_pylist() for c in ("shard", "records", "base"))):
                fs, path = filesystem(root)
                place, buf = 0, b""
                with fs.open_input_stream(shard_path(path, shard)) as f:
                    while True:
                        more = f.read(chunk)
                        got, used = parse_frames(buf + more)
                        buf = (buf + more)[used:]
                        n = [len(t) // 4 for _, t in got]
                        starts = start + np.cumsum([0, *n])
                        start = int(starts[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i for i, _ in got], pa.int64()), pa.array(starts[:-1].astype(np.int64)), pa.array(n, pa.int64()),
                             pa.array([t for _, t in got], pa.binary()), pa.array(np.full(len(got), shard, dtype=np.int64)),
                             pa.array(np.arange(place, place + len(got), dtype=np.int64))], ["id", "start", "n_tokens", "ids", "shard", "place"])
                        place += len(got)
                        if not more:
                            break
                if buf or place != records:
                    raise ValueError(f"shard {shard}: {place} whole records of {records}")

    return shards.mapInArrow(run, "id long, start long, n_tokens long, ids binary, shard long, place long")


def records_folder(spark: SparkSession) -> str:
    """A new folder for record files below the shared checkpoint folder."""
    return scratch_path(spark, "records")
