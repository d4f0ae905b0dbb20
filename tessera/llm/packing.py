"""Best-fit packing: token pieces into sequences of at most `size` tokens.

Bounded-space online best-fit. A fixed number of bins is open; a bitset keyed by free space tells which free spaces
exist, so the tightest bin that takes a piece is found with two bit operations. When every bin is taken and a piece
fits none of them, the fullest one closes. A task streams its pieces through the bins and hands each on as soon as it
is placed, so its memory holds the open bins and one window of pieces, however many come; within a window the longest
come first, which fills bins better.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import lean, stored
from .wordpiece import coder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """At most `most` open bins of `size`; place(n) gives (bin, offset) for a piece of n."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.open = self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.size:
            raise ValueError(f"a piece of {n} does not fit bins of {self.size}")
        fitting = self.bits >> n
        if fitting:
            free = n + (fitting & -fitting).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.most:  # the fullest is the one with the least free space
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
            at, free = self.made, self.size
            self.made += 1
            self.open += 1
        left = free - n
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
        else:
            self.open -= 1
        return at, self.size - free

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        return at


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per piece of every document: (doc_id, piece, start, length, ids_crc32).

    A document is its ids and then end_id, so a null or empty text is one piece of length 1. Only documents of over
    `size` ids are cut. Rows that repeat are documents of their own; a null doc_id stays null.
    """

    def pieces(batches):
        import pyarrow as pa

        own, end = coder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            at = 0
            ids_of = b.column(0).to_pylist()
            for ids, lengths in own.batch(b.column(1)):
                raw, to = ids.tobytes(), 0
                for n in lengths.tolist():
                    one, to = raw[4 * to : 4 * (to + n)] + end, to + n
                    for p, s in enumerate(range(0, n + 1, size)):
                        cut = one[4 * s : 4 * (s + size)]
                        rows.append((ids_of[at], p, s, len(cut) // 4, zlib.crc32(cut)))
                    at += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(lean(pieces), PIECES)


def pack(pieces: DataFrame, size: int = 2048, open_bins: int = 1024, window: int = 2048, shard_tokens: int = 64_000_000) -> DataFrame:
    """pieces (doc_id, piece, length, ids_crc32, ...) with sequence_id long and offset long added.

    Sequences never exceed `size`; the pieces of one lie gapless from offset 0. Pieces are dealt in turn, by no key, to
    ceil(tokens / shard_tokens) tasks, each of which ends with open bins that are not full. Equal rows are pieces of
    their own. Columns of the input stay, but for those named sequence_id and offset, which are replaced. An empty
    table gives an empty table. Null or non-positive lengths, and those over `size`, are an error.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    # in an order that is the same whenever a task runs again
    ordered = pieces.repartition(max(1, -(-total // shard_tokens))).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bins, base = Bins(size, open_bins), TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, window):
                part = b.slice(at, window)
                lengths = part.column("length").to_pylist()
                seq, off = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
                for i in sorted(range(len(lengths)), key=lambda i: -(lengths[i] or 0)):
                    seq[i], off[i] = bins.place(lengths[i] or 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base + seq), pa.array(off)], [*part.schema.names, "sequence_id", "offset"])

    return ordered.mapInArrow(run, StructType([*ordered.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, **limits) -> DataFrame:
    """token_pieces() of docs, packed by pack(): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Of docs, doc_id and text alone are read. A null or empty text is a piece of one token; an empty table gives an
    empty table.
    """
    return pack(token_pieces(docs, tokenizer, end_id, size), size, **limits)
