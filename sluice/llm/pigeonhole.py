"""Links of 64-bit fingerprints within a few bits, by a generalised pigeonhole search.

1. Bits are put into parts so that correlated bits share one, by the 64 x 64
   matrix of joint counts over all fingerprints.
2. If thresholds t_i sum to k - parts + 1, two fingerprints within k bits differ
   by at most t_i in some part i (t_i = -1: the part isn't used).  Every
   fingerprint has thresholds of its own, chosen by dynamic programming over the
   parts on the number of candidates that each is estimated to bring.  The
   estimate is a histogram of part values with a cell for each fingerprint, up to
   one for each value (some 2 million a part); values that share a cell make it
   too high.  It decides what is cheap, never what is found.
3. Every fingerprint is filed under its value in each part and probes the values
   within its thresholds.  Probes and entries meet by (part, value).  A value
   with many entries has shares: a probe goes to one, an entry to all.
4. A task compares probes and entries of a value in blocks and returns of the
   links that hold a spanning forest: fewer links than fingerprints, not all
   pairs of a group.
"""

from __future__ import annotations

from itertools import combinations as choose

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import mix64, whole_keys

#: Parts, least bits of the histogram's cells, entries of a share aimed at, and what a probe costs beside a comparison.
PARTS, CELL_BITS, SHARE, PROBE_COST = 3, 16, 2048, 4.0
BLOCK = 2048
#: Columns that travel with an entry or a probe: the fingerprint, then what a caller adds.
NAMES = ("fp", "node", "check")


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def joint_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and of those with bits i and j set."""

    def run(batches):
        n, joint = 0, np.zeros((64, 64))
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                bits = _bits(_unsigned(batch.column(0).slice(lo, 8192))).astype(np.float32)
                n += len(bits)
                joint += bits.T @ bits
        if n:
            cells = np.concatenate([[n], joint.ravel()]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "n"])

    found = fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(1 + 64 * 64)
    for r in found:
        cells[r.cell] = r.n
    return int(cells[0]), cells[1:].reshape(64, 64)


def group_bits(n: int, joint: np.ndarray, parts: int) -> list[list[int]]:
    """Bits by part: each part takes the bits most correlated with those it has."""
    share = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((joint / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = list(range(64)), []
    for p in range(parts):
        size = 64 // parts + (p >= parts - 64 % parts)
        part = [max(free, key=lambda b: (related[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (related[b, part].sum(), -b))
            part.append(b)
            free.remove(b)
        out.append(sorted(part))
    return out


def values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for i, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def _cell(part: int, value: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The histogram's cell of a value of ``width`` bits: its own where there are as many cells as values."""
    if bits >= width:
        return value.astype(np.int64)
    return (mix64(value + np.uint64((part + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64)


def cell_bits(n: int, parts: list[list[int]]) -> int:
    return min(max(map(len, parts)), max(CELL_BITS, n.bit_length()))


def histogram(fps: DataFrame, parts: list[list[int]], bits: int) -> np.ndarray:
    """Fingerprints by part and cell."""

    def run(batches):
        sums = np.zeros((len(parts), 1 << bits), dtype=np.int64)
        for batch in batches:
            f = _unsigned(batch.column(0))
            for p, part in enumerate(parts):
                sums[p] += np.bincount(_cell(p, values(f, part), len(part), bits), minlength=1 << bits)
        at = np.flatnonzero(sums)
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums.ravel()[some])], names=["cell", "n"])

    found = fps.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(parts) << bits, dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, 1 << 30).astype(np.int32).reshape(len(parts), -1)


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in choose(range(width), radius)], dtype=np.uint64)


def allocate(costs: np.ndarray, goal: int) -> np.ndarray:
    """Thresholds (rows: parts, columns: fingerprints) of least cost that sum to ``goal``.

    ``costs[p, t + 1]`` are the costs of threshold t in part p for each fingerprint.
    """
    parts, choices, n = costs.shape
    sums = range(-parts, goal + parts + 1)
    best = {0: np.zeros(n)}
    picked: list[dict[int, np.ndarray]] = []
    for p in range(parts):
        new: dict[int, np.ndarray] = {}
        pick: dict[int, np.ndarray] = {}
        for s, before in best.items():
            for t in range(-1, choices - 1):
                if s + t not in sums:
                    continue
                cost = before + costs[p, t + 1]
                if s + t not in new:
                    new[s + t], pick[s + t] = cost, np.full(n, t)
                else:
                    better = cost < new[s + t]
                    new[s + t] = np.where(better, cost, new[s + t])
                    pick[s + t] = np.where(better, t, pick[s + t])
        best = new
        picked.append(pick)
    out = np.zeros((parts, n), dtype=np.int64)
    left = np.full(n, goal)
    for p in range(parts - 1, -1, -1):
        for s, t in picked[p].items():
            at = left == s
            out[p, at] = t[at]
        left = left - out[p]
    return out


def _deal(parts: list[list[int]], counts, k: int, bits: int, first: int = 0, aim: int = SHARE):
    """Entries and probes; further long columns travel along, and parts are numbered from ``first``."""
    goal = k - len(parts) + 1
    # wider thresholds cost more than they save, and their balls much memory
    radius = min(k, max(2, -(-goal // len(parts)) + 1))
    balls = [[ball(len(part), r) for r in range(radius + 1)] for part in parts]

    def shares(estimate: np.ndarray) -> np.ndarray:
        return 1 + estimate // aim

    def batch_of(part, value, share, probes, own):
        part += first
        deal = mix64(value * np.uint64(0x9E3779B97F4A7C15) + np.uint64(part) + (share.astype(np.uint64) << np.uint64(48))).view(np.int64)
        n = len(value)
        columns = [deal, np.full(n, part, dtype=np.int32), value.view(np.int64), np.full(n, probes), *(c.view(np.int64) for c in own)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["deal", "part", "value", "probes", *NAMES[: len(own)]])

    def run(batches):
        estimates = counts.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                columns = [_unsigned(c.slice(lo, 4096)) for c in batch.columns]
                fps = columns[0]
                own = [values(fps, part) for part in parts]
                costs = np.zeros((len(parts), radius + 2, len(fps)))
                near = []
                for p in range(len(parts)):
                    rings = [estimates[p][_cell(p, own[p][:, None] ^ ring, len(parts[p]), bits)].astype(np.int64) for ring in balls[p]]
                    near.append(rings)
                    total = np.zeros(len(fps))
                    for t, ring in enumerate(rings):
                        total = total + ring.sum(axis=1) + PROBE_COST * ring.shape[1]
                        costs[p, t + 1] = total
                chosen = allocate(costs, goal)
                for p in range(len(parts)):
                    n = shares(near[p][0][:, 0])
                    rows = np.repeat(np.arange(len(fps)), n)
                    share = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                    yield batch_of(p, own[p][rows], share, False, [c[rows] for c in columns])
                    for r, ring in enumerate(near[p]):
                        # a value that only the fingerprint itself has, or none, has no partner
                        row, at = np.nonzero((chosen[p] >= r)[:, None] & (ring > (r == 0)))
                        if len(row):
                            share = (mix64(fps[row]) % shares(ring[row, at]).astype(np.uint64)).astype(np.int64)
                            yield batch_of(p, own[p][row] ^ balls[p][r][at], share, True, [c[row] for c in columns])

    return run


def forest(probes: np.ndarray, entries: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links between probes and entries, as few as hold each connected group together."""
    nodes, place = np.unique(np.concatenate([probes, entries]), return_inverse=True)
    label = np.arange(len(nodes))
    q_at, d_at = place[: len(probes)], place[len(probes) :]
    out = []
    for lo in range(0, len(probes), BLOCK):
        for start in range(0, len(entries), BLOCK):
            block = entries[start : start + BLOCK]
            close = np.bitwise_count(probes[lo : lo + BLOCK, None] ^ block[None, :]) <= k
            for i in np.flatnonzero(close.any(axis=1)).tolist():
                q = q_at[lo + i]
                linked = d_at[start : start + BLOCK][close[i]]
                groups, first = np.unique(label[linked], return_index=True)
                new = groups != label[q]
                if new.any():
                    out += [(int(nodes[q]), int(nodes[d])) for d in linked[first[new]].tolist()]
                    label[np.isin(label, groups)] = label[q]
    return out


def _meet(k: int):
    def run(batches):
        for batch in whole_keys(batches):
            deal, part, value, probes, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp, probes = fp.view(np.uint64), probes.astype(bool)
            order = np.lexsort((probes, value, part, deal))
            deal, part, value, probes, fp = (x[order] for x in (deal, part, value, probes, fp))
            new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
            first = np.flatnonzero(new)
            stop = np.concatenate([first[1:], [len(deal)]])
            asking = np.add.reduceat(probes.astype(np.int64), first)
            out = []
            for a, b, n in zip(first.tolist(), stop.tolist(), asking.tolist(), strict=True):
                # entries come before probes
                if n and b - a - n and not (b - a == 2 and fp[a] == fp[a + 1]):
                    out += forest(np.unique(fp[b - n : b]), np.unique(fp[a : b - n]), k)
            if out:
                links = np.array(out, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, k: int = 2, parts: int = PARTS) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints ``fps`` (one long column) that are within ``k`` bits."""
    n, joint = joint_counts(fps)
    grouped = group_bits(n, joint, parts)
    bits = cell_bits(n, grouped)
    counts = fps.sparkSession.sparkContext.broadcast(histogram(fps, grouped, bits))
    dealt = fps.mapInArrow(_deal(grouped, counts, k, bits), "deal long, part int, value long, probes boolean, fp long")
    return dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(_meet(k), "a long, b long")
