"""Compressed columns of numbers, for shuffles of many hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from palisade.llm import common
from palisade.llm.hashing import U, flat

#: Words that one flush covers, and what is left of the document that fills it; it bounds a task's memory.
FLUSH_WORDS = 500_000
#: Bytes of input for each bucket of the hash space; it bounds what a task holds of one bucket.
BUCKET_BYTES = 4 << 20


def buckets_for(docs: DataFrame) -> int:
    """Buckets of the hash space for ``docs``: by the bytes that Spark expects, but not out of proportion to the shuffle partitions.

    Any number gives the same result; estimates behind joins can be far too high.
    """
    spark = docs.sparkSession
    expected = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(2 * common.partitions(spark), expected // BUCKET_BYTES), 64 * common.partitions(spark))


def trim() -> None:
    """Give freed memory back to the system: workers live on between tasks, and the allocator would keep it."""
    pa.default_memory_pool().release_unused()
    if (give := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        give(0)


#: What a worker keeps between tasks, by its owner.
HELD: dict[str, object] = {}


def enter(owner: str) -> None:
    """To be called as a task begins: workers serve one operator after another, so what others keep is dropped."""
    gone = [k for k in HELD if k != owner]
    for k in gone:
        del HELD[k]
    if gone:
        gc.collect()
    trim()


#: Bytes of a group's blobs from which memory is given back after it.
_TRIM_BYTES = 2 << 20


def trimmed(function: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that gives freed memory back at its end."""

    def run(table: pa.Table) -> pa.Table:
        if HELD:
            enter("groups")
        out = function(table)
        if table.nbytes >= _TRIM_BYTES:
            trim()
        return out

    return run


def trimmed_pair(function: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a function of two groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if HELD:
            enter("groups")
        out = function(left, right)
        if left.nbytes + right.nbytes >= _TRIM_BYTES:
            trim()
        return out

    return run


_PRESS, _OPEN = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Byte planes, compressed: the planes of small numbers' high bytes vanish."""
    return _PRESS.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(_OPEN.decompress(blob), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def count(blob: bytes, dtype: type) -> int:
    """The number of values in a blob."""
    return zstandard.frame_content_size(blob) // np.dtype(dtype).itemsize


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values by their differences."""
    return pack(np.diff(values, prepend=U(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, U), dtype=U)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal parts of the hash space begins among sorted hashes."""
    edges = np.searchsorted(sorted_hashes >> U(32), (np.arange(buckets + 1, dtype=U) * U(1 << 32)) // U(buckets))
    edges[-1] = len(sorted_hashes)
    return edges


def flushes(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """Batches of (doc_id, text hash, word hashes) gathered into flushes of ``most`` words: name, ids, text hashes, words, lengths.

    The name is made of the partition and a count, so a task that runs again gives the same one.
    """
    from pyspark import TaskContext

    enter("flushes")
    part = TaskContext.get().partitionId()
    ids, ths, words, lengths, held, k = [], [], [], [], 0, 0
    for batch in batches:
        values, counts = flat(batch.column(2))
        ends = np.cumsum(counts)
        row = word = 0
        while row < len(counts):
            stop = min(int(np.searchsorted(ends, word + most - held)) + 1, len(counts))
            last = int(ends[stop - 1])
            ids.append(batch.column(0).slice(row, stop - row))
            ths.append(batch.column(1).slice(row, stop - row))
            words.append(values[word:last].copy())
            lengths.append(counts[row:stop])
            held, row, word = held + last - word, stop, last
            if held >= most:
                yield f"{part}-{k}", pa.concat_arrays(ids), pa.concat_arrays(ths), np.concatenate(words), np.concatenate(lengths)
                ids, ths, words, lengths, held, k = [], [], [], [], 0, k + 1
    if ids:
        yield f"{part}-{k}", pa.concat_arrays(ids), pa.concat_arrays(ths), np.concatenate(words), np.concatenate(lengths)
    del ids, ths, words, lengths
    trim()
