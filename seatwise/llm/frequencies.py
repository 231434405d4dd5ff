"""Document frequencies of hashed features, and bitmaps: tables of a fixed size.

As in the hashing trick, a shingle stands for its bucket among ``2 ** BITS``.  The table
covers all documents and has the same size at every scale; a bucket's count is an upper
bound of the count of each shingle in it.  With n distinct shingles in a mean document, a
bucket holds a share of about ``n / 2 ** BITS`` of the documents by chance, whatever
their number, so shares well above that are those of frequent shingles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import NON_ALNUM, Texts, distinct_per_text, shingle_hashes, slices

BITS = 20
BLOCKS = 64           # parts of the table, so that its sums are found by several tasks
HASH_BITS = 56        # of the hashes that distinct_per_text gives
FLAG_BITS = 26        # bits of a bitmap: 8 MiB
FLAG_BLOCK = 1 << 16  # bytes of a part of a bitmap


def text_shingles(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, count) of the distinct k-word shingles of a slice of texts."""
    t = Texts(column, lower=True)
    start, end, owner = t.pieces(NON_ALNUM)
    return distinct_per_text(*shingle_hashes(t.hashes(start, end), owner, len(t), k))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(HASH_BITS - BITS)).astype(np.int64)


def shingle_frequencies(docs: DataFrame, text: str = "text", k: int = 5) -> tuple[np.ndarray, int]:
    """Documents per bucket (a table of ``2 ** BITS`` counts) and the number of documents
    that have a shingle."""
    size = 2 ** BITS // BLOCKS

    def count(batches):
        total, n = np.zeros(2 ** BITS, dtype=np.uint32), 0
        for b in batches:
            for _, part in slices(b.column(0)):
                h, of, _ = text_shingles(part, k)
                np.add.at(total, bucket(h), np.uint32(1))
                n += int(np.count_nonzero(np.diff(of, prepend=-1)))       # of is sorted
        if n:
            parts = [total[i * size:(i + 1) * size].tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary()),
                                              pa.array([n] + [0] * (BLOCKS - 1), pa.int64())], names=["block", "counts", "n"])

    def add(batches):
        # a task may hold several blocks; each is a running sum of fixed size
        sums, n = {}, 0
        for b in batches:
            for block, counts, docs_ in zip(*(c.to_pylist() for c in b.columns)):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, dtype=np.uint32).astype(np.uint64)
                n += docs_
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary()),
                                              pa.array([n] + [0] * (len(sums) - 1), pa.int64())], names=["block", "counts", "n"])

    schema = "block int, counts binary, n long"
    rows = (docs.select(F.col(text).cast("string")).mapInArrow(count, schema)
            .repartition("block").mapInArrow(add, schema).collect())
    table = np.zeros(2 ** BITS, dtype=np.uint64)
    for r in rows:
        table[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(bytes(r["counts"]), dtype=np.uint64)
    return table, sum(r["n"] for r in rows)


def bitmap(numbers: DataFrame, bits: int = FLAG_BITS) -> np.ndarray:
    """Bitmap of a column of longs (their low bits), made in the tasks in fixed memory.  Only
    its blocks that have a bit are shuffled, and each block is merged by a task of its own.  A
    superset filter of fixed size, whatever the number of rows."""
    numbers, size = numbers.toDF("number"), 1 << (bits - 3)
    width = min(FLAG_BLOCK, size)

    def rows_of(blocks):
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks.values()], pa.binary())],
                                          names=["block", "flags"])

    def mark(batches):
        flags = np.zeros(size, dtype=np.uint8)
        for b in batches:
            at = np.unique(b.column(0).drop_null().to_numpy() & (2 ** bits - 1))
            if len(at):
                byte = at >> 3
                first = np.flatnonzero(np.diff(byte, prepend=-1))
                flags[byte[first]] |= np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), first)
        blocks = flags.reshape(-1, width)
        some = {int(i): blocks[i] for i in np.flatnonzero(blocks.any(axis=1))}
        if some:
            yield rows_of(some)

    def merge(batches):
        merged = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(x.as_buffer(), dtype=np.uint8)
                merged[i] = merged[i] | x if i in merged else x.copy()
        if merged:
            yield rows_of(merged)

    schema = "block int, flags binary"
    flags = np.zeros((size // width, width), dtype=np.uint8)
    for r in numbers.mapInArrow(mark, schema).repartition("block").mapInArrow(merge, schema).collect():
        flags[r["block"]] = np.frombuffer(bytes(r["flags"]), dtype=np.uint8)
    return flags.reshape(-1)


def flagged(flags: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers may be in a bitmap."""
    at = (numbers & numbers.dtype.type(len(flags) * 8 - 1)).astype(np.int64)
    return (flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
