"""Packing: fill windows by non-negative least squares on the length histogram.

A document's ids, with an end id, are cut into whole windows and one shorter
tail.  Tails are packed in groups of up to ``group`` consecutive documents of a
partition:

1. the histogram h of tail lengths is taken;
2. all combinations of at most three lengths that fill a window exactly are
   enumerated (columns of A) and their repeat counts x >= 0 are fitted to
   min |Ax - h| by coordinate descent, many orthogonal columns at a time, until
   the error stops falling;
3. the counts are rounded down, then up by largest remainder, never beyond the
   tails that exist; a combination whose count rounds to 0 isn't used;
4. what is left is packed greedily, longest first, each into the fullest window it
   fits.  The emptiest of these windows are cut up to fill the gaps of the others;
   the last, incomplete one is cut into powers of two, which need no padding.

No step moves rows between tasks, so the plan is a single narrow stage, a task
holds one group's tails at most, and a lost task is simply run again.

Null text counts as empty (its end id alone is packed), null ids stay null,
repeated rows are packed each by itself, and an empty table gives no rows.
Texts are encoded in pieces of some MB, a longer one by itself.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import small_batches
from sluice.llm.tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=4)
def combinations(window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, a < window, that sum to ``window``; 0 stands for none."""
    b, c = np.meshgrid(np.arange(1, window // 2 + 1), np.arange(0, window // 3 + 1), indexing="ij")
    b, c = b.ravel(), c.ravel()
    a = window - b - c
    keep = (a >= b) & (b >= c)
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit_counts(histogram: np.ndarray, window: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Combinations of lengths that occur, and their fitted repeat counts."""
    h = histogram.astype(np.float64)
    h[0] = 0
    there = h > 0
    there[0] = True
    cols = combinations(window)
    cols = cols[there[cols].all(axis=1)]
    x = np.zeros(len(cols))
    if not len(cols):
        return cols, x
    some = (cols > 0).astype(np.float64)
    times = 1.0 + (cols[:, 1] == cols[:, 0]) + (cols[:, 1] == cols[:, 2])
    # |A_j|^2: a length that comes twice in a combination counts four times
    norm = np.where(times == 3, 9.0, some.sum(axis=1) + 2.0 * (times == 2))
    rest, error = h.copy(), np.inf
    for _ in range(rounds):
        now = float(rest @ rest)
        if now <= 0.25 * there.sum() or now > 0.998 * error:
            break
        error = now
        step = np.maximum((rest[cols] * some).sum(axis=1) / norm, -x)
        gain = step * step * norm
        best = np.argsort(-gain)[:4096] if len(gain) <= 4096 else np.argpartition(-gain, 4096)[:4096]
        best = best[np.argsort(-gain[best], kind="stable")]
        used, chosen = set(), []
        for j, (p, q, r) in zip(best.tolist(), cols[best].tolist(), strict=True):
            # columns without a common length are orthogonal, so each step is the best one
            if p not in used and q not in used and r not in used:
                chosen.append(j)
                used |= {p, q, r} - {0}
        chosen = np.array(chosen)
        x[chosen] += step[chosen]
        rest -= np.bincount(cols[chosen].ravel(), weights=(some[chosen] * step[chosen, None]).ravel(), minlength=window + 1)
    return cols, x


def round_counts(cols: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram can pay for: the parts below 1 by largest remainder."""
    left = histogram.astype(np.int64).tolist()
    whole = np.floor(x + 1e-9)
    out = np.zeros(len(x), dtype=np.int64)
    by_remainder = np.argsort(-(x - whole), kind="stable")
    more = by_remainder[: int(round(x.sum() - whole.sum()))]
    for order, want in ((np.argsort(-x, kind="stable"), whole), (more, np.ones(len(x)))):
        order = order[want[order] > 0]
        for j, (a, b, c), k in zip(order.tolist(), cols[order].tolist(), want[order].astype(np.int64).tolist(), strict=True):
            for v in (a, b, c):
                if v:
                    k = min(k, left[v] // ((a == v) + (b == v) + (c == v)))
            if k:
                for v in (a, b, c):
                    left[v] -= k * (v > 0)
                out[j] += k
    return out


def _fullest(rest: np.ndarray, lengths: np.ndarray, window: int) -> list[list[int]]:
    """Tails by window: each, longest first, goes to the fullest window that it fits."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(window + 1)]
    mask = 0
    for t, v in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
        fits = mask >> v
        if fits:
            free = v + (fits & -fits).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[at].append(t)
        else:
            free, at = window, len(bins)
            bins.append([t])
        by_free[free - v].append(at)
        mask |= 1 << (free - v)
    return bins


Pieces = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(tail, first id in it, length, sequence, offset) of every piece, as parallel arrays, and the number of sequences."""
    histogram = np.bincount(lengths, minlength=window + 1)
    cols, x = fit_counts(histogram, window)
    by_length = np.argsort(lengths, kind="stable")
    first = np.concatenate([[0], np.cumsum(histogram)])
    taken = [0] * (window + 1)
    counts = round_counts(cols, x, histogram)
    parts: list[Pieces] = []
    n = 0

    def whole(tails: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> None:
        parts.append((tails, np.zeros(len(tails), dtype=np.int64), lengths[tails], sequence, offset))

    used = np.flatnonzero(counts)
    for combination, k in zip(cols[used].tolist(), counts[used].tolist(), strict=True):
        offset = 0
        for v in combination:
            if v:
                lo = first[v] + taken[v]
                whole(by_length[lo : lo + k], np.arange(n, n + k), np.full(k, offset))
                taken[v] += k
                offset += v
        n += k
    rest = np.concatenate([by_length[first[v] + taken[v] : first[v + 1]] for v in range(window, 0, -1)])
    bins = _fullest(rest, lengths, window)
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    order = np.argsort(-fill, kind="stable")
    free, content = window - fill[order], fill[order]
    # the first windows stay, the others are cut up to fill their gaps
    gaps, below = np.concatenate([[0], np.cumsum(free)]), np.concatenate([np.cumsum(content[::-1])[::-1], [0]])
    keep = int(np.flatnonzero(gaps <= below)[-1])
    open_at: list[tuple[int, int, int]] = []
    for i in order[:keep].tolist():
        tails = np.array(bins[i])
        ends = np.cumsum(lengths[tails])
        whole(tails, np.full(len(tails), n), ends - lengths[tails])
        if ends[-1] < window:
            open_at.append((n, int(ends[-1]), int(window - ends[-1])))
        n += 1
    line = [t for i in order[keep:].tolist() for t in bins[i]]
    if line:
        pieces, n = lay_out(np.array(line), lengths, window, n, open_at)
        parts.append(pieces)
    if not parts:
        return *(np.zeros(0, dtype=np.int64),) * 5, n
    return *(np.concatenate([p[i] for p in parts]) for i in range(5)), n


def lay_out(rest: np.ndarray, lengths: np.ndarray, window: int, n: int, gaps: list[tuple[int, int, int]]) -> tuple[Pieces, int]:
    """Lays tails end to end and cuts the line at the ends of gaps (sequence, offset, size), then of full windows, and its end at powers of two."""
    ends = np.cumsum(lengths[rest])
    total = int(ends[-1])
    filled = sum(size for _, _, size in gaps)
    sizes = [size for _, _, size in gaps] + [window] * ((total - filled) // window)
    at, power = sum(sizes), 1 << window.bit_length()
    while at < total:
        while at + power > total:
            power //= 2
        at += power
        sizes.append(power)
    fresh = len(sizes) - len(gaps)
    segment = np.array([s for s, _, _ in gaps] + list(range(n, n + fresh)))
    base = np.array([o for _, o, _ in gaps] + [0] * fresh)
    cuts = np.cumsum(sizes)
    bounds = np.union1d(ends, cuts)
    starts = np.concatenate([[0], bounds[:-1]])
    which = np.searchsorted(ends, starts, side="right")
    at_cut = np.searchsorted(cuts, starts, side="right")
    opened = np.concatenate([[0], cuts])[at_cut]
    return (rest[which], starts - (ends - lengths[rest])[which], bounds - starts, segment[at_cut], base[at_cut] + starts - opened), n + fresh


def pack(docs: DataFrame, *, window: int = 1024, end_id: int = 0, vocabulary: str | None = None, group: int = 32_768, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document; ``with_ids`` adds its packed ids (little-endian unsigned 32-bit)."""
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        width = enc.dtype.itemsize
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        rows: list[tuple] = []
        tails: list[tuple] = []

        def piece(doc, start, ids, total, seq, offset):
            packed = np.frombuffer(ids, dtype=enc.dtype).astype("<u4").tobytes()
            rows.append((doc, start, len(ids) // width, zlib.crc32(packed), total, seq, offset, *([packed] if with_ids else [])))

        def flush_tails():
            nonlocal sequence
            if tails:
                lengths = np.array([len(t[2]) // width for t in tails], dtype=np.int64)
                *arrays, n = place(lengths, window)
                for t, s, m, q, o in zip(*(a.tolist() for a in arrays), strict=True):
                    doc, start, ids, total = tails[t]
                    piece(doc, start + s, ids[s * width : (s + m) * width], total, sequence + q, o)
                sequence += n
                tails.clear()

        names = [*(c.split()[0] for c in SCHEMA.split(", ")), *(["ids"] if with_ids else [])]
        types = [pa.int64()] * 7 + [pa.binary()] * with_ids

        def out():
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in small_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text) + end
                total = len(ids) // width
                whole = total - total % window
                for start in range(0, whole, window):
                    piece(doc, start, ids[start * width : (start + window) * width], total, sequence, 0)
                    sequence += 1
                if whole < total:
                    tails.append((doc, whole, ids[whole * width :], total))
                    if len(tails) >= group:
                        flush_tails()
                if len(rows) >= 20_000:
                    yield out()
        flush_tails()
        yield out()

    schema = SCHEMA + (", ids binary" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Sequences of ids from pieces with ids: (sequence_id, length, ids binary); a sequence is one window at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
