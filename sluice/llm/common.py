"""Shared helpers: tables, durable scratch space, and word handling.

Words are maximal runs of bytes outside ``0x20`` and ``0x09-0x0D``; that is
what ``bytes.split()`` yields, and what :func:`split_words` finds with numpy.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sluice.sources.shared import durable as durable
from sluice.sources.shared import shared_dir as shared_dir

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LANE_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sluice-{uuid.uuid4().hex}/{name}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Spark resolves it to."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of :func:`scratch_path` with what it holds."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; file sizes for a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_batches(batches, column: int = -1, rows: int = 4096, size: int = 2 << 20):
    """Slices of at most ``rows`` rows and about ``size`` bytes of a string or binary column; a longer row is one by itself."""
    for batch in batches:
        lo, n = 0, batch.num_rows
        texts = batch.column(column % batch.num_columns)
        ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < n:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, min(n, lo + rows, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def whole_keys(batches, limit: int = 8 << 20):
    """Batches of about ``limit`` bytes, or one key, from batches sorted by their first column, an integer; no key is split."""
    held, size, least = [], 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column(0).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
        size = held[0].nbytes
        # a key larger than the limit isn't copied again for each batch
        least = max(limit, 2 * size)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; equal inputs stay equal, all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def text_chunks(texts: pa.Array, target: int = 4 << 20):
    """(first row, bytes, offsets) of consecutive rows of about ``target`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, raw_offsets, data = texts.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    if texts.null_count:
        texts = pa.array([x or b"" for x in texts.to_pylist()], type=pa.large_binary())
        _, raw_offsets, data = texts.buffers()
        offsets = np.frombuffer(raw_offsets, dtype=np.int64)[: n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the number of words before it."""
    n = len(buf)
    word = ~_IS_SEPARATOR[buf]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts, ends = word.copy(), word.copy()
    if n:
        starts[1:] &= ~word[:-1] | first[1:n]
        ends[:-1] &= ~word[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time."""
    length = ends - starts
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(buf) + 1,), strides=(1,))
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows, at = np.arange(len(starts)), 0
    while len(rows):
        part = lanes[starts[rows] + at] & _LANE_MASKS[np.minimum(length[rows] - at, 8)]
        h[rows] = mix64(h[rows] ^ part)
        at += 8
        rows = rows[length[rows] > at]
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for an odd base."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, np.uint64(b))
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]
