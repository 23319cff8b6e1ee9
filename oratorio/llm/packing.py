"""Packing of tokenised documents into sequences: concatenate and cut.

The token stream is all documents one after another, in the order of partitions and of rows in them.
The first pass tokenises, writes the ids with each row's start within its partition, and sums the
partitions' totals; their prefix sums give global starts. The second pass cuts each document at the
multiples of the sequence length, without moving a row. Only the last sequence is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_columns, table, written

SEQUENCE = 2048
END = 1
#: Chunks kept by a Python worker with their ids; when full, it starts anew.
CACHED = 600_000
#: Letters of ASCII and Latin-1, and ASCII punctuation but for the apostrophe, which may begin a suffix.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
#: The usual printable stand-ins for bytes in byte-level vocabularies, for the letters of PLAIN.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_stand_in = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _printable)}
BYTES = {c: "".join(_stand_in[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class Encoder:
    """Ids of texts by a tokenizers file whose pre-tokenizer drops white space.

    No token crosses white space, so a text is cut at ASCII white space and each distinct chunk is
    tokenised once as long as it is cached. If the file lower-cases, normalises to NFC, splits letters
    from the rest and has byte-level merges, a chunk of plain letters with punctuation behind it goes
    to the merges at once; all others go through the whole tokenizer. Ids are 16 bits wide here, or 32
    for larger vocabularies.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.cache: dict[bytes, bytes] = {}
        self.model = self.tokenizer.model
        self.marks = [t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path) as f:
            self.plain = _is_plain(json.load(f))

    def _ids(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(piece.translate(BYTES))]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        if self.plain and (m := PLAIN.fullmatch(chunk.decode("utf-8", "replace").lower())):
            out = b""
            for part in m.groups():
                if part:
                    key = part.encode()
                    if (own := self.cache.get(key)) is None:
                        own = self.cache[key] = self._ids(part)
                    out += own
            return out
        text = chunk.decode("utf-8", "replace")
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        end, out, cache = array(self.code, [END]).tobytes(), [], self.cache
        if len(cache) > CACHED:
            cache.clear()
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            # case matters only to added tokens, which are found before lower-casing
            chunks = (data.lower() if self.plain and not any(m in data for m in self.marks) else data).split()
            for c in set(chunks).difference(cache):
                cache[c] = self._chunk(c)
            out.append(b"".join(map(cache.__getitem__, chunks)) + end)
        return out


def _is_plain(spec: dict) -> bool:
    """Whether the file's normalizer and pre-tokenizer do to plain Latin letters, lower-cased, and to
    punctuation behind them nothing but part the two."""
    norm = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    split = next((x["pattern"].get("Regex", "") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x.get("type") == "Split"), "")
    return norm == ["NFC", "Replace", "Lowercase"] and pre == ["Split", "ByteLevel"] and split.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def tokenised(docs: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, part, start_in_part, n, ids): ids little-endian, 2 or 4 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = encoder.width
        for b in batches:
            for at in range(0, b.num_rows, 64):
                piece = b.slice(at, 64)
                ids = encoder.encode(piece.column(1).to_pylist())
                n = np.array([len(x) // width for x in ids], np.int64)
                starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(np.full(len(n), width, np.int32)), pa.array(ids, pa.binary())], ["doc_id", "part", "start_in_part", "n", "width", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return own_columns(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, part int, start_in_part bigint, n bigint, width int, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one a piece.

    Null texts count as empty: one token, the end. An empty table gives no rows; repeated rows are
    packed as often as they stand. What the driver sees is one total for each partition.
    """
    spark = docs.sparkSession
    ids = written(tokenised(docs, tokenizer_path, text, doc_id), "token-ids")
    totals = {r.part: r.n for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, at = {}, 0
    for part in sorted(totals):
        starts[part], at = at, at + totals[part]
    shared = spark.sparkContext.broadcast(starts)
    kind = docs.schema[doc_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = shared.value
        for b in batches:
            doc, pieces = [], []
            for i, part, own, n, width, data in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                first = offsets[part] + own
                wide = np.frombuffer(data, "<u2" if width == 2 else "<u4").astype("<u4").tobytes()
                low = first
                while low < first + n:
                    high = min(first + n, (low // sequence + 1) * sequence)
                    crc = zlib.crc32(memoryview(wide)[4 * (low - first) : 4 * (high - first)])
                    doc.append(i)
                    pieces.append((low - first, high - low, crc, n, low // sequence, low % sequence))
                    low = high
            columns = [pa.array(c, pa.int64()) for c in zip(*pieces, strict=True)] if pieces else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([pa.array(doc, b.schema.field(0).type), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ids.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by pack; nulls, empty and repeated rows as it says."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack. Null and empty texts are one token; repeated rows are packed as often as they
    stand; rows with a null doc_id keep it; extra columns are ignored; an empty table gives no rows."""
    return pack(docs, default_tokenizer())
