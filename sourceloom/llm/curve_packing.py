"""Packing along a space-filling curve.

Each document's token counts, hashed to buckets, are projected to four dimensions by a fixed random matrix and scaled to unit
length, so documents of like wording lie near each other.  A Hilbert curve through that space gives each document one key.
Documents are range-sorted by the key and laid end to end; the run is cut every ``capacity`` ids, so neighbours along the
curve share sequences and only the last sequence of all has padding.

The ids are written once in the shared folder.  Only (row, key, length) is range-sorted: positions are running sums within
the sorted ranges plus the totals of the ranges before, and they are joined back to the ids by row.

Cases: null text is empty and has only the end id; null and repeated doc_ids are packed row by row; a document longer than a
sequence is cut over several; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import keep, remove
from .tokens import Encoder

CAPACITY, DIMENSIONS, BITS, BUCKETS = 4096, 4, 12, 256
OUT_IDS = 1 << 20  # sent on at a time
PIECE = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve positions of integer points (rows) with ``bits`` bits a coordinate (the transposed form of J. Skilling)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(BUCKETS)


def bucket_counts(ids: np.ndarray) -> np.ndarray:
    """A document's token counts hashed to buckets, scaled to unit length."""
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
    count = np.bincount(bucket, minlength=BUCKETS).astype(np.float64)
    return count / np.sqrt(count @ count)


def curve_keys(vectors: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The Hilbert keys of documents' vectors (rows)."""
    place = np.tanh(4 * (vectors @ matrix))
    return hilbert_key(np.clip(((place + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1))


def _tokenize(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, matrix, end = Encoder.of(tokenizer), projection(), np.array([end_id], dtype="<u4").tobytes()
        docs, vectors, sizes, ids = [], [], [], []

        def out() -> pa.RecordBatch:
            keys = curve_keys(np.stack(vectors), matrix)
            made = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "key", "tokens", "ids"])
            for held in (docs, vectors, sizes, ids):
                held.clear()
            return made

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = np.frombuffer(encoder.encode(text.as_py()) + end, dtype="<u4")
                docs.append(doc)
                vectors.append(bucket_counts(raw))
                sizes.append(len(raw))
                ids.append(raw.astype("<u2" if raw.max() < 1 << 16 else "<u4").tobytes())
                held += len(raw) + BUCKETS  # what a row holds beside its ids counts too
                if held > OUT_IDS:
                    yield out()
                    held = 0
        if docs:
            yield out()

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("tokens").to_numpy()
        ends = total + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(size), part, dtype=np.int32)), batch.column("row"), batch.column("tokens"), pa.array(ends - size)], names=["part", "row", "tokens", "local"])
        total = int(ends[-1]) if len(ends) else total


def _cut(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in PIECE]
        held = 0

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:6]), pa.array(rows[6], pa.binary())], names=PIECE)
            for column in rows:
                column.clear()
            return made

        for batch in batches:
            docs, places, sizes = (batch.column(c).to_pylist() for c in ("doc_id", "place", "tokens"))
            for doc, place, size, raw in zip(docs, places, sizes, batch.column("ids"), strict=True):
                raw = raw.as_buffer()
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * size else "<u4").astype("<u4")
                start = 0
                while start < size:
                    sequence, offset = divmod(place + start, capacity)
                    n = min(size - start, capacity - offset)
                    for column, value in zip(rows, (doc, start, n, size, sequence, offset, ids[start : start + n].tobytes()), strict=True):
                        column.append(value)
                    start += n
                held += size
                if held > OUT_IDS:
                    yield out()
                    held = 0
        yield out()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    coded, _ = keep(docs.select("doc_id", "text").mapInArrow(_tokenize(tokenizer, end_id), "doc_id long, key long, tokens long, ids binary").withColumn("row", F.monotonically_increasing_id()), "coded")
    thin = coded.select("key", "doc_id", "row", "tokens").repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    local, local_path = keep(thin.select("row", "tokens").mapInArrow(_positions, "part int, row long, tokens long, local long"), "positions")
    totals = {r.part: r.n for r in local.groupBy("part").agg(F.sum("tokens").alias("n")).collect()}  # a row per range
    bases, base = [], 0
    for part in sorted(totals):
        bases.append((part, base))
        base += totals[part]
    before = docs.sparkSession.createDataFrame(bases, "part int, base long")
    placed, _ = keep(local.join(F.broadcast(before), "part").select("row", (F.col("base") + F.col("local")).alias("place")), "placed")
    remove(docs.sparkSession, local_path)
    return coded.join(placed.hint("merge"), "row").select("doc_id", "place", "tokens", "ids").mapInArrow(_cut(capacity), "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
