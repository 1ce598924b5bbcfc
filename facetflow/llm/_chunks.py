"""Texts packed to chunks of a few MB, and sorted hashes as compact binaries.

A chunk is one row that holds the texts of many documents, compressed. What a task derives from a chunk can be sent as a
few binary rows by ranges of hashes and answered in the chunk's order, instead of as a row a hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from facetflow.llm._words import as_bytes

CHUNK_BYTES = 6 << 20
PACKED = "kind int, chunk long, ids array<long>, ranks array<long>, sizes array<int>, texts binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])
_U = np.uint64


def packed(rows: DataFrame) -> DataFrame:
    """PACKED chunks of ``rows`` (doc_id, rank, text, kind): the rows of a task by kind, about CHUNK_BYTES each.

    Chunks have ids of their own once the result is settled; computed again they may hold other rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        size: dict[int, int] = {}
        n = TaskContext.get().partitionId() << 24

        def out(kind: int) -> pa.RecordBatch:
            nonlocal n
            n += 1
            size[kind] = 0
            parts = waiting.pop(kind)
            sizes = np.concatenate([p[2] for p in parts])
            raw = int(sizes.sum()).to_bytes(8, "little") + pa.compress(b"".join(p[3] for p in parts), "zstd", asbytes=True)
            lists = [[x for p in parts for x in p[c].to_pylist()] for c in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(kind), n, *lists, sizes, raw), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            kinds = np.asarray(batch.column(3))
            for kind in np.unique(kinds):
                of = batch.filter(pa.array(kinds == kind))
                data, at = as_bytes(of.column(2))
                i = 0
                while i < of.num_rows:
                    j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES - size.get(kind, 0), "right")) - 1)
                    waiting.setdefault(kind, []).append((of.column(0).slice(i, j - i), of.column(1).slice(i, j - i), np.diff(at[i : j + 1]).astype(np.int32), data[at[i] : at[j]].tobytes()))
                    size[kind] = size.get(kind, 0) + int(at[j] - at[i])
                    if size[kind] >= CHUNK_BYTES or j < of.num_rows:
                        yield out(kind)
                    i = j
        for kind in list(waiting):
            yield out(kind)

    return rows.mapInArrow(run, PACKED)


def texts_of(sizes: np.ndarray, raw: bytes) -> pa.Array:
    """The texts of a chunk."""
    at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(at), pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd")])


def planes(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that compression takes out the planes of zeros."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T).tobytes()


def of_planes(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, len(raw) // width).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences; the first of a range is a difference from 0."""
    return planes(np.diff(keys, prepend=_U(0)))


def of_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(of_planes(raw, np.uint64), dtype=np.uint64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[list[int], list[slice]]:
    """Buckets, which are equal ranges of hashes, that sorted keys fall in, and where the keys of each lie."""
    own, first = np.unique(((keys >> _U(32)) * _U(buckets)) >> _U(32), return_index=True)
    return own.astype(np.int64).tolist(), [slice(a, b) for a, b in zip(first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True)]
