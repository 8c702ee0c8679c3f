"""Token files: one concatenated id array with Elias-Fano coded document boundaries.

A file is a Parquet table of segments. A segment's payload is self-contained::

    magic "TGE1" | header (fixed, little-endian) | boundaries | document ids | ids

Boundaries and document ids are non-decreasing sequences in Elias-Fano form:
low bits packed, high bits in unary, and a select table that samples the
position of every 256th one in 32 bits. No 64-bit offset table is kept; a
document's global start is its place in the segment plus the totals of the
segments and chunks before it.

Spark's own writer stores the segments, so a lost executor leaves no half
written file and any store that Spark can write will do.

Defined cases: null text is the empty text (its one id is the end id); null
``doc_id`` sorts first; rows of one ``doc_id`` are ordered by their ids'
bytes; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunk_number, sorted_runs, totals_before, with_text
from .tokens import encoder, with_end

MAGIC = b"TGE1"
HEADER = struct.Struct("<4sBIIQ")  # magic, bytes per id, documents, of them without id, ids
PART = struct.Struct("<qQIBII")  # first value, span, entries, low width, bytes of high bits, entries of the select table
SAMPLE = 256
SEGMENT_IDS = 1 << 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NTH = np.array([([b for b in range(8) if i >> b & 1] + [8] * 8)[:8] for i in range(256)], np.uint8)  # bit of the n-th one of a byte


class EliasFano:
    """A non-decreasing integer sequence in about 2 + log2(span / n) bits a value."""

    def __init__(self, first: int, span: int, n: int, width: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.first, self.span, self.n, self.width, self.high, self.low, self.samples = first, span, n, width, high, low, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n = len(v)
        if not n:
            return cls(0, 0, 0, 0, np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint32))
        first = int(v[0])
        v = (v - v[0]).astype(np.uint64)
        span = int(v[-1])
        width = max(0, (span // n).bit_length() - 1)
        places = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        low = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        return cls(first, span, n, width, np.packbits(bits, bitorder="little"),
                   np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def values(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[:self.n * self.width].reshape(self.n, self.width)
        return self.first + ((high << self.width) | (low.astype(np.int64) << np.arange(self.width)).sum(1))

    def select(self, i: int) -> int:
        """Place of the ``i``-th one among the high bits, from the nearest sampled place."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # ones still to pass after the one at ``place``
        byte = place >> 3
        here = int(self.high[byte]) >> (place & 7) << (place & 7)
        while left >= (ones := int(_ONES[here])):
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for bit in range(8):
            if here >> bit & 1:
                if not left:
                    return byte * 8 + bit
                left -= 1
        raise AssertionError

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i`` (ascending), by selects: bytes are counted from the sampled place before the first on."""
        if not len(i):
            return np.empty(0, np.int64)
        begin = int(self.samples[int(i[0]) // SAMPLE])
        high = self.high[begin >> 3:].copy()
        high[0] = high[0] >> (begin & 7) << (begin & 7)
        ones = np.cumsum(_ONES[high], dtype=np.int64)
        nth = np.asarray(i, np.int64) - int(i[0]) // SAMPLE * SAMPLE
        byte = np.searchsorted(ones, nth, "right")
        place = (begin >> 3 << 3) + byte * 8 + _NTH[high[byte], nth - (ones[byte] - _ONES[high[byte]])]
        low = np.zeros(len(i), np.int64)
        for k in range(self.width):
            bit = np.asarray(i, np.int64) * self.width + k
            low |= (self.low[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << k
        return self.first + ((place - i << self.width) | low)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, low = i * self.width, 0
        for k in range(self.width):
            low |= (int(self.low[at + k >> 3]) >> (at + k & 7) & 1) << k
        return self.first + ((self.select(i) - i << self.width) | low)

    def pack(self) -> bytes:
        return PART.pack(self.first, self.span, self.n, self.width, len(self.high), len(self.samples)) + self.high.tobytes() + self.low.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        first, span, n, width, nh, ns = PART.unpack_from(raw, at)
        at += PART.size
        high = np.frombuffer(raw, np.uint8, nh, at)
        nl = (n * width + 7) // 8
        low = np.frombuffer(raw, np.uint8, nl, at + nh)
        return cls(first, span, n, width, high, low, np.frombuffer(raw, "<u4", ns, at + nh + nl)), at + nh + nl + 4 * ns


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """``doc_ids`` ascending, missing ones first."""
    width = ids[0].dtype
    ends = np.cumsum([0, *map(len, ids)])
    missing = sum(d is None for d in doc_ids)
    head = HEADER.pack(MAGIC, width.itemsize, len(ids), missing, int(ends[-1]))
    return b"".join([head, EliasFano.of(ends).pack(), EliasFano.of(np.array(doc_ids[missing:], np.int64)).pack(), *[x.tobytes() for x in ids]])


class Segment:
    """Random access to a packed segment."""

    def __init__(self, raw: bytes):
        magic, width, self.n_docs, missing, self.n_ids = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.bounds, at = EliasFano.unpack(raw, HEADER.size)
        names, at = EliasFano.unpack(raw, at)
        self.doc_ids = [None] * missing + names.values().tolist()
        self.ids = np.frombuffer(raw, f"<u{width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds[i]:self.bounds[i + 1]]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, and write the segments in ascending ``doc_id`` order.

    Only ids are shuffled (two bytes each for a small vocabulary), once, by
    literal cuts of ``doc_id``.
    """
    d, n = chunk_number(with_text(docs, F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "chunk")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            at = 0
            for counts, ids in enc.encode_column(b.column("text")):
                bounds, ids = with_end(counts, ids, end_id)
                rows = b.select(["chunk", "doc_id"]).slice(at, len(counts))
                raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer((bounds * enc.width.itemsize).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([*rows.columns, raw], ["chunk", "doc_id", "ids"])
                at += len(counts)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = encoder(vocabulary).width
        chunk, number, base, names, held, size = None, 0, 0, [], [], 0

        def close():
            return pd.DataFrame({"chunk": [chunk], "segment": [number], "base": [base], "n_docs": [len(names)], "n_ids": [size], "payload": [pack_segment(names, held)]})

        for b in batches:
            for c, d, raw in zip(b["chunk"], b["doc_id"], b["ids"]):
                if held and (c != chunk or size >= SEGMENT_IDS):
                    yield close()
                    number, base, names, held, size = number + 1, base + size, [], [], 0
                if c != chunk:
                    chunk, number, base = c, 0, 0
                names.append(None if pd.isna(d) else int(d))
                held.append(np.frombuffer(raw, width))
                size += len(held[-1])
        if held:
            yield close()

    ids = d.select("chunk", "doc_id", "text").mapInArrow(encode, "chunk int, doc_id long, ids binary")
    (sorted_runs(ids, n, "chunk", F.asc_nulls_first("doc_id"), "ids")
     .mapInPandas(segments, "chunk int, segment int, base long, n_docs long, n_ids long, payload binary")
     .write.parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32. The only broadcast has one row per chunk."""
    files = spark.read.parquet(path)
    before = totals_before(files.groupBy("chunk").agg(F.sum("n_ids").alias("n")), "chunk", "n", "before")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for base, raw in zip(b["base"] + b["before"], b["payload"]):
                s = Segment(raw)
                nth = np.arange(s.n_docs)
                starts, ends = s.bounds.at(nth), s.bounds.at(nth + 1)
                yield pd.DataFrame({
                    "doc_id": pd.array(s.doc_ids, "Int64"), "start": base + starts, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(s.ids[a:z].astype("<u4").tobytes()) for a, z in zip(starts.tolist(), ends.tolist())]})

    rows = files.join(F.broadcast(before), "chunk").select("base", "before", "payload")
    return rows.mapInPandas(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long")
