"""Helpers that the text operators share: shared-folder tables, Arrow word splitting, 64-bit hashing on numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` everywhere; a null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.joins import counted_join  # noqa: F401
from ..plans.storage import forget, shared_dir, written  # noqa: F401

MIX1 = np.uint64(0xFF51AFD7ED558CCD)
MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give free memory of this worker back to the system: workers live on, and so would what one task has needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, which releases memory at the end of its task."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def row_key(*cols: str):
    """128 bits that stand for a row's values, nulls told apart from any text; two long columns rk1 and rk2."""
    parts = [p for c in cols for p in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("rk1"), F.xxhash64(F.lit(77), *reversed(parts)).alias("rk2")]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: offsets (n + 1), the code of each word, and the distinct words that the codes number.

    lower folds A-Z only, and then words that differ in case have codes of their own but equal words. Splitting, folding and numbering run in Arrow, not in Python.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        seen = np.concatenate(([0], np.cumsum(full)))
        starts, flat = seen[starts], flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = pc.ascii_lower(coded.dictionary) if lower else coded.dictionary
    return starts, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), words


def hashes_of(words: pa.Array, seed: int = 0) -> np.ndarray:
    """xxh3 of each distinct word, as unsigned 64-bit integers."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * MIX1
        x = (x ^ (x >> np.uint64(29))) * MIX2
        return x ^ (x >> np.uint64(32))


def gram_hashes(starts: np.ndarray, hashed: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each document: (document of each window, hash of each window).

    short: a document with fewer words, but one at least, gives its whole sequence as one window.
    """
    docs = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    total = len(hashed)
    at = np.arange(total)
    whole = at + n <= starts[1:][docs] if total else np.zeros(0, bool)
    at = at[whole]
    with np.errstate(over="ignore"):
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out = mix(out * ODD + hashed[at + k])
        owner = docs[at]
        if short:
            sizes = np.diff(starts)
            few = np.flatnonzero((sizes > 0) & (sizes < n))
            extra = sizes[few].astype(np.uint64)
            for k in range(n - 1):
                has = sizes[few] > k
                step = mix(extra * ODD + hashed[np.minimum(starts[few] + k, max(total - 1, 0))]) if total else extra
                extra = np.where(has, step, extra)
            owner, out = np.concatenate((owner, few)), np.concatenate((out, extra))
    return owner, out


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One binary cell per slice of values; offsets count values."""
    data = np.ascontiguousarray(values)
    at = (np.asarray(offsets, np.int64) * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Parts of a batch whose texts hold about limit bytes at most, one row at least."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, side="right")))
        # Copied: some Arrow kernels misread arrays that begin at an offset.
        yield batch if to - at == batch.num_rows else batch.take(pa.array(np.arange(at, to)))
        at = to
