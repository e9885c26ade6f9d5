"""Sorted 64-bit values with counts, packed for a shuffle and dealt by bucket.

A packed block holds the differences of neighbouring values as byte planes: their high planes are
mostly zero, which the shuffle's compression takes away.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope.llm.frames import whole_text

SCHEMA = "bucket int, kind int, block binary"
#: Larger blocks are split, so that no Arrow batch of them grows large.
BLOCK_VALUES = 1 << 18


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values and their counts as bytes."""
    steps = np.diff(values, prepend=values[:1]).astype(np.uint64)
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    many = counts[counts >= 255].astype(np.uint64)
    head = np.array([len(values), planes, int(values[0]) if len(values) else 0], np.uint64)
    low = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return b"".join([head.tobytes(), low.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), many.tobytes()])


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values and counts that were packed."""
    n, planes, first = (int(x) for x in np.frombuffer(block, np.uint64, 3))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = 24 + n * planes
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(block, np.uint8, n * planes, 24).reshape(planes, n).T
    counts = np.frombuffer(block, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(block, np.uint64, -1, at + n).astype(np.int64)
    return np.uint64(first) + np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), counts


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, ascending, its counts added up."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


def batch(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, kind, block) as Arrow batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 1 << 23:
            yield _record(held)
            held, size = [], 0
    if held:
        yield _record(held)


def _record(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, blocks = zip(*rows, strict=True)
    columns = [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "block"])


def deal(buckets: np.ndarray, values: np.ndarray, counts: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Packed rows per bucket; the values are ascending within each bucket, the buckets ascending."""
    for bucket, start, stop in runs(buckets):
        for at in range(start, stop, BLOCK_VALUES):
            end = min(stop, at + BLOCK_VALUES)
            yield bucket, kind, pack(values[at:end], counts[at:end])


def runs(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of equal neighbours."""
    if len(buckets):
        first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        yield from zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True)


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows of each bucket together and in the order of their kind, one task per bucket."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its (kind, block) rows) from gathered rows, as a stream."""

    def rows():
        for part in batches:
            columns = (part.column("bucket").to_pylist(), part.column("kind").to_pylist(), part.column("block"))
            for bucket, kind, block in zip(*columns, strict=True):
                yield bucket, kind, block.as_buffer()

    for bucket, group in groupby(rows(), lambda r: r[0]):
        yield bucket, ((kind, block) for _, kind, block in group)


def text_bytes(docs: DataFrame, text_column: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(whole_text(text_column)).cast("long"))).first()[0] or 0


def power_of_two(least: float) -> int:
    """The smallest power of two from `least` on."""
    n = 1
    while n < least:
        n *= 2
    return n
