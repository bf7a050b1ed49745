"""SentencePiece encoding and decoding with a distinct-chunk table.

When no piece of the model holds a whitespace marker after another character, no merge can cross
the place where a marked word begins. A text is then cut into marked words; each distinct one is
segmented (and decoded) once by the library and kept in a table, and a document's ids are the
table's entries joined back by position. The table belongs to one task; it is dropped when it
holds ``TABLE_SIZE`` words, so its memory is bounded, and a lost task only rebuilds its own.
A model without this property (or with a normaliser, or user-defined pieces) is applied to whole texts.

Edge cases: a null text counts as empty and gives the begin and end ids only. Repeated rows are
encoded alike. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, text_or_empty

MARK = "▁"
CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
TABLE_SIZE = 300_000
#: Text bytes encoded at a time; as lists of words they take about forty times that.
ENCODE_BYTES = 1 << 19


def cuts_at_markers(proto: bytes) -> bool:
    """Whether pieces cannot cross a whitespace marker and texts reach the model unchanged."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    m.ParseFromString(proto)
    n = m.normalizer_spec
    plain = (not n.precompiled_charsmap and not n.normalization_rule_tsv and n.add_dummy_prefix
             and not n.remove_extra_whitespaces and n.escape_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix)
    crossing = re.compile(f"[^{MARK}]{MARK}")
    return bool(plain and m.trainer_spec.model_type == m.trainer_spec.BPE
                and not any(crossing.search(p.piece) or p.type == p.USER_DEFINED for p in m.pieces))


class ChunkCodec:
    """Encodes and decodes texts through the table of distinct marked words."""

    def __init__(self, proto: bytes, bos: bool = True, eos: bool = True, table_size: int = TABLE_SIZE):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.chunked = cuts_at_markers(proto)
        self.head = np.array([self.sp.bos_id()] * bos, dtype="<u4").tobytes()
        self.tail = np.array([self.sp.eos_id()] * eos, dtype="<u4").tobytes()
        self.ids: dict[str, bytes] = {}
        self.texts: dict[str, str] = {}
        self.table_size = table_size

    def learn(self, chunks: list[str]) -> None:
        """Segment the words that the table lacks, each once. The library puts the first marker itself."""
        got = self.sp.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1)
        for c, ids in zip(chunks, got):
            if c == MARK:  # the library gives nothing for an empty text
                ids = [self.sp.piece_to_id(MARK)]
            self.ids[c] = np.array(ids, dtype="<u4").tobytes()
            self.texts[c] = self.sp.decode(ids)

    def apply(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """For each text its ids (little-endian unsigned 32-bit) and the decoded text."""
        if not self.chunked:
            ids = self.sp.encode(texts, num_threads=1)
            return ([self.head + np.array(i, dtype="<u4").tobytes() + self.tail for i in ids], [self.sp.decode(i) for i in ids])
        if len(self.ids) > self.table_size:
            self.ids.clear()
            self.texts.clear()
        cut = [CHUNKS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn([c for c in {c for chunks in cut for c in chunks} if c not in self.ids])
        ids, words = self.ids, self.texts
        return ([b"".join([self.head, *map(ids.__getitem__, c), self.tail]) for c in cut],
                # decoding drops a chunk's first marker; between chunks it is a space again
                [" ".join(map(words.__getitem__, c)) for c in cut])


def encode_batches(batches: Iterator[pa.RecordBatch], codec: ChunkCodec) -> Iterator[pa.RecordBatch]:
    """(_id, n_tokens, ids, decoded) of batches with _id and _t, a piece of ``ENCODE_BYTES`` at a time."""
    for b in sliced(batches, "_t", ENCODE_BYTES):
        ids, decoded = codec.apply(b.column("_t").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [b.column("_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
            ["_id", "n_tokens", "ids", "decoded"])


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True,
                 eos: bool = True) -> DataFrame:
    """(id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers in one binary value."""
    proto = Path(model_path).read_bytes()
    src = df.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_t"))

    def run(batches):
        yield from encode_batches(batches, ChunkCodec(proto, bos, eos))

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("_id", id_col)
