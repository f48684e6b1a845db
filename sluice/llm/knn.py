"""Exact top-k by inner product as a Voronoi k-nearest-neighbour join.

Vectors are rounded to integers.  With one more component, sqrt(M - |x|^2) for
data (M: the greatest |x|^2) and 0 for queries, all data have the same norm and
the largest inner products are the smallest Euclidean distances.  Then:

1. *Pivots* are the vectors with the least hashes, a documented bounded sample:
   an eighth of the square root of the rows, at least 64 and at most ``PIVOTS``.
   Every row goes to the cell of its nearest pivot.
2. *Summaries*: of each cell, the number and greatest distance of its queries and
   of its data, and the ``k`` least distances of its data to the pivot.
3. *Bounds*: a query of cell i is within U_i + |p_i p_j| + |p_j x| of x in cell j; the
   k-th least of these over all summaries bounds the distance of its k-th
   neighbour, theta_i.  So group i needs the data of cell j only if
   |p_i p_j| - U_i - R_j is at most theta_i.  The same with a query's own distances to
   the pivots tells which of these cells that query needs.
4. *Replication*: data stay in their cell, once each, and a query goes to the cells
   that it needs, as there are far fewer queries than data.  A cell's data are
   split into shares of about ``SHARE`` rows by the hash of their id.  Only where a
   cell has over ``CHUNK`` queries are these split too, and its data repeated for
   each part.
5. *Local search*: a task compares blocks of queries and data by matrix product
   and keeps k rows a query; these are merged at the end.

Bounds are widened by more than the rounding of floating point, so none is
lost to it, ties included.  Shorter vectors count as padded with zeros.  A vector
that is null or holds a null or non-finite component takes no part, nor does a
null id.  Of rows that repeat an id, those of the same score count once, and a
query's own row is each with its id.  An empty table or one without queries gives
no rows.  Other columns are ignored.
"""

from __future__ import annotations

import heapq
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that are pivots at most; data rows and queries compared at once; rows of a share and queries of a part aimed at.
PIVOTS, BLOCK, QUERIES, SHARE, CHUNK = 1024, 4096, 512, 16_384, 16_384
_NONE = -(1 << 62)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 x), padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    most = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T) + (extra[:, None] - pivot_extra) ** 2
    return np.sqrt(np.maximum(squares, 0))


def _scattered(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _first(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query by score and id, each (query, score, id) once."""
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    new = np.ones(len(query), dtype=bool)
    new[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
    query, score, ids = query[new], score[new], ids[new]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < k
    return query[keep], score[keep], ids[keep]


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, score, id) of the k best of a block for each query."""
    scores = _products(q, x)
    scores[q_ids[:, None] == ids[None, :]] = _NONE
    n, want = len(ids), min(k, len(ids))
    while True:
        least = np.partition(scores, n - want, axis=1)[:, n - want]
        row, at = np.nonzero((scores >= least[:, None]) & (scores != _NONE))
        found = _first(row, scores[row, at], ids[at], k)
        # repeated rows may fill the first places
        if want == n or np.bincount(found[0], minlength=len(q_ids)).min() >= k:
            return found
        want = min(4 * want, n)


def top_k(vectors: DataFrame, *, is_query: str = "vec_id % 50 = 0", k: int = 5, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products with other rows, ties to smaller ids."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.floor(256.0 * x).cast("double") * F.floor(256.0 * x).cast("double"))
    shape = rows.agg(F.max(F.size("embedding")).alias("width"), F.max(norm).alias("most"), F.count("*").alias("n")).first()
    width, most = shape["width"] or 0, shape["most"] or 0.0
    pivots = pivots or min(PIVOTS, max(64, isqrt(shape["n"]) // 8))
    sample = [np.array(r.embedding) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(pivots).collect()]
    schema = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return spark.createDataFrame([], schema)
    points = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        points[i, : len(v)] = np.floor(256.0 * v)
    extras = np.sqrt(np.maximum(most - (points * points).sum(axis=1), 0))
    slack = 1e-6 * (1.0 + np.sqrt(most))
    # components are whole numbers, as small as the longest vector allows
    kind = np.dtype("<i2" if most < 2.0**30 else "<i4" if most < 2.0**62 else "<f8")
    n = len(points)

    def data_distances(x: np.ndarray) -> np.ndarray:
        return _distances(x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0)), points, extras)

    def query_distances(x: np.ndarray) -> np.ndarray:
        return _distances(x, np.zeros(len(x)), points, extras)

    def pieces(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                yield part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), width), part.column(2).to_numpy(zero_copy_only=False).astype(bool)

    def summarise(batches):
        count, reach = np.zeros(n, dtype=np.int64), np.zeros(n)
        data, extent = np.zeros(n, dtype=np.int64), np.zeros(n)
        near: list[list[tuple[float, int]]] = [[] for _ in points]
        for ids, x, query in pieces(batches):
            d = data_distances(x)
            home = d.argmin(axis=1)
            own = d[np.arange(len(x)), home]
            np.maximum.at(extent, home, own)
            for j in np.unique(home).tolist():
                mine = np.flatnonzero(home == j)
                data[j] += len(mine)
                found = near[j] + heapq.nsmallest(k + 1, zip(own[mine].tolist(), ids[mine].tolist(), strict=True))
                # rows of one id count once, so that the bound isn't too low
                near[j] = sorted((d, i) for i, d in dict((i, d) for d, i in sorted(found, reverse=True)).items())[: k + 1]
            q = query_distances(x[query])
            cell = q.argmin(axis=1)
            np.add.at(count, cell, 1)
            np.maximum.at(reach, cell, q[np.arange(len(q)), cell])
        some = np.flatnonzero(data + count)
        columns = [some, data[some], extent[some], count[some], reach[some], [[{"d": d, "id": i} for d, i in near[j]] for j in some.tolist()]]
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["cell", "data", "extent", "queries", "reach", "near"])

    marked = rows.withColumn("query", F.expr(is_query))
    partial = marked.mapInArrow(summarise, "cell int, data long, extent double, queries long, reach double, near array<struct<d: double, id: long>>")
    # k + 1 distances a cell from each task become k + 1 a cell
    merged = partial.select("cell", F.inline("near")).groupBy("cell", "id").agg(F.min("d").alias("d"))
    ranked = merged.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d", "id")))
    sums = partial.groupBy("cell").agg(F.sum("data").alias("data"), F.max("extent").alias("extent"), F.sum("queries").alias("queries"), F.max("reach").alias("reach"))
    nearest = ranked.where(F.col("r") <= k + 1).groupBy("cell").agg(F.collect_list("d").alias("near"))
    data, queries, extent, reach = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n)
    for r in sums.collect():
        data[r.cell], extent[r.cell], queries[r.cell], reach[r.cell] = r["data"], r["extent"], r["queries"], r["reach"]
    known_cell, known = [], []
    for r in nearest.collect():
        known_cell += [r.cell] * len(r["near"])
        known += r["near"]
    known_cell, known = np.array(known_cell, dtype=np.int64), np.array(known)
    between = _distances(points, extras, points, extras)

    def kth(upper: np.ndarray) -> np.ndarray:
        """The bound from rows of distances; a query may be among the data itself, so one more is counted."""
        return np.partition(upper, k, axis=1)[:, k] + slack if upper.shape[1] > k else np.full(len(upper), np.inf)

    theta = reach + kth(between[:, known_cell] + known)
    needs = (between - reach[:, None] - extent <= theta[:, None] + slack) & (queries > 0)[:, None] & (data > 0)
    shares = np.maximum(1, -(-data // SHARE))
    chunks = np.maximum(1, -(-(needs * queries[:, None]).sum(axis=0) // CHUNK))

    def replicate(batches):
        for ids, x, query in pieces(batches):
            home = data_distances(x).argmin(axis=1)
            times = chunks[home]
            row = np.repeat(np.arange(len(x)), times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            cell = home[row]
            share = _scattered(ids[row]) % shares[cell]
            asking = np.flatnonzero(query)
            d = query_distances(x[asking])
            group = d.argmin(axis=1)
            bound = np.minimum(theta[group], kth(d[:, known_cell] + known))
            q_row, q_cell = np.nonzero(needs[group] & (d - extent <= bound[:, None] + slack))
            times = shares[q_cell]
            q_row, q_cell = np.repeat(asking[q_row], times), np.repeat(q_cell, times)
            q_share = np.arange(len(q_row)) - np.repeat(np.cumsum(times) - times, times)
            q_part = _scattered(ids[q_row]) % chunks[q_cell]
            rows_, cells = np.concatenate([row, q_row]), np.concatenate([cell, q_cell])
            deal = (cells << 40) + (np.concatenate([share, q_share]) << 20) + np.concatenate([part, q_part])
            asks = np.arange(len(rows_)) >= len(row)
            raw = [v.tobytes() for v in x.astype(kind)]
            for a in range(0, len(rows_), 8192):
                b = slice(a, a + 8192)
                columns = [deal[b], asks[b], ids[rows_[b]], [raw[i] for i in rows_[b].tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["deal", "asks", "vec_id", "vector"])

    def solve(batches):
        # rows come sorted by deal, queries first
        deal, asks, waiting, found = None, ([], []), ([], []), []

        def compare():
            if waiting[0] and asks[0]:
                ids, x = (np.concatenate(c) for c in waiting)
                q_ids, q = (np.concatenate(c) for c in asks)
                asks[0][:], asks[1][:] = [q_ids], [q]
                for lo in range(0, len(q_ids), QUERIES):
                    own = q_ids[lo : lo + QUERIES]
                    for at in range(0, len(ids), BLOCK):
                        row, score, name = _best(own, q[lo : lo + QUERIES], ids[at : at + BLOCK], x[at : at + BLOCK], k)
                        found.append((own[row], score, name))
            waiting[0].clear(), waiting[1].clear()
            if len(found) > 256:
                found[:] = [_first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)]

        def out():
            query, score, name = _first(*(np.concatenate(c) for c in zip(*found, strict=True)), k)
            found.clear()
            for lo in range(0, len(query), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 50_000]) for c in (query, name, score)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            deals = batch.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(deals)) + 1, [len(deals)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if deals[a] != deal:
                    compare()
                    if found:
                        yield from out()
                    deal = deals[a]
                    asks[0].clear(), asks[1].clear()
                part = batch.slice(a, b - a)
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=kind).reshape(len(part), width).astype(np.float64)
                ids, asking = part.column(2).to_numpy(), part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for into, rows_ in ((asks, asking), (waiting, ~asking)):
                    if rows_.any():
                        into[0].append(ids[rows_])
                        into[1].append(x[rows_])
                if sum(map(len, waiting[0])) >= BLOCK:
                    compare()
        compare()
        if found:
            yield from out()

    dealt = marked.mapInArrow(replicate, "deal long, asks boolean, vec_id long, vector binary").repartition("deal").sortWithinPartitions("deal", F.desc("asks"))
    found = dealt.mapInArrow(solve, "query_id long, vec_id long, score long").distinct()
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE_SQL = r"""
WITH x AS (SELECT DISTINCT vec_id, [floor(256 * v::DOUBLE)::BIGINT FOR v IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([v FOR v IN embedding IF v IS NULL OR NOT isfinite(v)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
