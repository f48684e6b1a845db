"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its id.  Sizes are summed by source and
hash bucket; the running sum along the buckets tells in which bucket a source's
budget ends, and all documents below that bucket are taken.  Only the boundary
bucket is refined: by further hash bits while it is large, and at the end
document by document in hash order, taking each that still fits.  Nothing is
sorted but that last bucket of a few hundred documents.

Where a document of the boundary bucket is left out, budget is left for smaller
ones above it: a next threshold is found in the same way among those that fit
what is left, until none does.  The result is that of going through a source in
hash order and taking each document that fits, so less is missing from a target
than any document that was left out.

A target above a source's size takes the whole source once for each time it
fits and a threshold's part of it again.

Null text has size 0; a null source is a source of its own; null ids hash like
an empty id; documents that repeat an id (with the same source and size) are
taken or left together; an empty table gives no rows.  Other columns are
ignored by :func:`mix`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable
from sluice.llm.quality import words

HASH_BITS = 60
#: Hash bits of one histogram (2**12 rows a source), and documents aimed at in the last bucket.
LEVEL_BITS, LAST_BUCKET = 12, 128
#: Sources up to which their rows (and some 256 documents of each) are broadcast; beyond, the planner decides by size.
FEW_SOURCES = 1000
#: Single documents taken up to which they are broadcast (some 100 bytes each).
FEW_TAKEN = 1 << 16
#: Of a word: what a target may lack of a whole number by rounding.
SLACK = 1e-6


def hashed(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, cap: float) -> dict[str | None, float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess goes to the others by weight."""
    out: dict[str | None, float] = {}
    free = list(sizes)
    while free:
        rest = total - sum(out.values())
        weight = sum(weights[s] for s in free)
        full = [s for s in free if rest * weights[s] / weight > cap * sizes[s]]
        if not full:
            return out | {s: rest * weights[s] / weight for s in free}
        out |= {s: float(cap * sizes[s]) for s in full}
        free = [s for s in free if s not in full]
    return out


def cycled_weights(sources: list[str | None], cycle: tuple[float, ...] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights in turn for the sources in order of code points, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, (s or "").encode()))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def _bits(documents: int) -> int:
    """Hash bits after which about LAST_BUCKET to twice as many documents share a bucket."""
    return max(0, min(HASH_BITS, (documents // LAST_BUCKET).bit_length() - 1))


@dataclass
class _Source:
    """A source on its way: the words left to take, and the last of its 2**bits buckets that is decided."""

    source: str | None
    size: int
    target: float
    whole: int
    left: int
    bits: int
    done: int = -1
    #: Of the present threshold: what was left before it, its bucket, and the bits of that bucket known so far.
    budget: int = 0
    edge: int = 0
    used: int = 0

    def open(self) -> bool:
        return self.left > 0 and self.done < (1 << self.bits) - 1


def _above(h: str, n: str) -> Column:
    return F.expr(f"shiftright({h}, {HASH_BITS} - {n})")


def _threshold(rest: DataFrame, sources: list[_Source], few: bool) -> DataFrame:
    """Moves each source to its next threshold; source, h, doc_id, size of what the boundary buckets take.

    ``rest`` has source, h, doc_id, size, n, where ``n`` rows are taken or left together.
    """
    spark = rest.sparkSession
    schema = "source string, budget long, left long, done long, bits int, used int, edge long"
    for s in sources:
        s.budget, s.edge, s.used = s.left, 0, 0

    def inside(some: list[_Source]) -> DataFrame:
        at = spark.createDataFrame([(s.source, s.budget, s.left, s.done, s.bits, s.used, s.edge) for s in some], schema).withColumnRenamed("source", "_s")
        free = (_above("h", "used") == F.col("edge")) & (_above("h", "bits") > F.col("done")) & (F.col("size") * F.col("n") <= F.col("budget"))
        return rest.join(F.broadcast(at) if few else at, F.col("source").eqNullSafe(F.col("_s")) & free)

    while refined := [s for s in sources if s.used < s.bits]:
        rows = inside(refined).withColumn("next", F.least(F.col("used") + LEVEL_BITS, F.col("bits")))
        sums = rows.withColumn("bucket", _above("h", "next")).groupBy("source", "left", "next", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
        # 2**LEVEL_BITS rows a source at most
        sums = sums.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
        last = F.max("bucket").over(Window.partitionBy("source"))
        edge = sums.withColumn("last", last).where((F.col("upto") > F.col("left")) | (F.col("bucket") == F.col("last")))
        edge = edge.groupBy("source", "next").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("below"))).alias("at"))
        found = {r.source: r for r in edge.collect()}
        for s in refined:
            if s.source in found:
                r = found[s.source]
                s.left, s.used, s.edge = s.left - r["at"]["below"], r["next"], r["at"]["bucket"]
            else:  # nothing fits what is left
                s.used, s.edge = s.bits, 1 << s.bits
    # one bucket of each source, document by document
    rim = inside(sources).groupBy("source", "left", "h", "doc_id", "size").agg(F.sum("n").alias("n"))
    rim = rim.groupBy("source", "left").agg(F.sort_array(F.collect_list(F.struct("h", "doc_id", "size", "n"))).alias("docs"))
    empty = F.struct(F.col("left"), F.array().cast("array<struct<h:bigint,doc_id:bigint,size:bigint>>").alias("got"))

    def step(a: Column, d: Column) -> Column:
        cost = d["size"] * d["n"]
        one = F.array(F.struct(d["h"].alias("h"), d["doc_id"].cast("long").alias("doc_id"), d["size"].alias("size")))
        return F.when(cost <= a["left"], F.struct((a["left"] - cost).alias("left"), F.concat(a["got"], one).alias("got"))).otherwise(a)

    rim = durable(rim.select("source", F.aggregate("docs", empty, step).alias("end")))
    left = {r.source: r["left"] for r in rim.select("source", "end.left").collect()}
    for s in sources:
        s.left, s.done = left.get(s.source, s.left), s.edge
    return rim.select("source", F.explode("end.got").alias("g")).select("source", "g.*")


def mix(docs: DataFrame, *, share: float = 1.5, cap: float = 2.0, cycle: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken.

    The driver gets one row per source and step.
    """
    spark = docs.sparkSession
    sized = durable(docs.select(F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"), hashed(F.col("doc_id")).alias("h")))
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    size = {r.source: int(r["size"]) for r in found}
    few = len(size) <= FEW_SOURCES
    goal = targets(size, cycled_weights(list(size), cycle), share * sum(size.values()), cap)
    state = []
    for r in found:
        whole = int(goal[r.source] // size[r.source]) if size[r.source] else 0
        # sizes are whole numbers, so budgets are
        left = math.floor(goal[r.source] - whole * size[r.source] + SLACK)
        state.append(_Source(r.source, size[r.source], goal[r.source], whole, left, _bits(r.n)))

    def beside(rows: DataFrame, schema: str, values: list[tuple], on: Column) -> DataFrame:
        """``rows`` with the values of their source, of which ``on`` holds."""
        other = spark.createDataFrame(values, "_s string, " + schema)
        return rows.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("_s")) & on)

    takes = [_threshold(sized.withColumn("n", F.lit(1).cast("long")), state, few)]
    ends = [(s.source, s.size, s.target, s.whole, s.bits, s.edge, s.budget) for s in state]
    if going := [s for s in state if s.open()]:
        above = (_above("h", "bits") > F.col("done")) & (F.col("size") > 0) & (F.col("size") <= F.col("left"))
        rest = beside(sized, "left long, done long, bits int", [(s.source, s.left, s.done, s.bits) for s in going], above)
        rest = durable(rest.groupBy("source", "h", "doc_id", "size", "bits").agg(F.count("*").alias("n")))
        ranges = []
        while going:
            before = [s.done for s in going]
            takes.append(_threshold(rest.drop("bits"), going, few))
            ranges += [(s.source, s.budget, after, s.edge) for s, after in zip(going, before, strict=True)]
            going = [s for s in going if s.open()]
        within = (F.col("size") * F.col("n") <= F.col("budget")) & (_above("h", "bits") > F.col("after")) & (_above("h", "bits") < F.col("until"))
        takes.append(beside(rest, "budget long, after long, until long", ranges, within).select("source", "h", "doc_id", "size"))
    got = durable(reduce(DataFrame.union, (t.select("source", "h", F.col("doc_id").cast("long").alias("doc_id"), "size") for t in takes)))
    got_few = got.count() <= FEW_TAKEN
    got = got.select(F.col("source").alias("_t"), F.col("h").alias("_h"), F.col("doc_id").alias("_d"), F.col("size").alias("_z"), F.lit(True).alias("fits"))
    hit = F.col("source").eqNullSafe(F.col("_t")) & (F.col("h") == F.col("_h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("size") == F.col("_z"))
    placed = beside(sized, "source_size long, target double, whole int, bits int, edge long, budget long", ends, F.lit(True))
    both = placed.join(F.broadcast(got) if got_few else got, hit, "left")
    below = (_above("h", "bits") < F.col("edge")) & (F.col("size") <= F.col("budget"))
    part = F.when(below | F.col("fits"), 1).otherwise(0)
    return both.select("doc_id", "source", "size", "source_size", "target", ((F.col("whole") + part) * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as :func:`mix` takes it; those without words go.

    Decisions depend on id, source and size alone, so they are joined back by these.
    """
    takes = mix(docs, **options).where("taken > 0").groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken"))
    takes = takes.select(F.col("doc_id").alias("_sl_id"), F.col("source").alias("_sl_source"), F.col("size").alias("_sl_size"), F.col("taken").alias("_sl_taken"))
    rows = docs.select(F.struct("*").alias("_sl_row"), F.size(words(F.col("text"))).cast("long").alias("_sl_n"))
    same = F.col("_sl_row.doc_id").eqNullSafe(F.col("_sl_id")) & F.col("_sl_row.source").eqNullSafe(F.col("_sl_source")) & (F.col("_sl_n") == F.col("_sl_size"))
    times = F.sequence(F.lit(1), (F.col("_sl_taken") / F.col("_sl_size")).cast("int"))
    return rows.join(takes, same).select("_sl_row", F.explode(times)).select("_sl_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n,
    [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM d GROUP BY source),
f AS (
  SELECT 0 AS i, source, source_size, n, w, NULL::DOUBLE AS capped, 1.5 * sum(source_size) OVER () AS total FROM s
  UNION ALL
  SELECT i + 1, source, source_size, n, w,
    CASE WHEN capped IS NULL AND rest * w / free > 2 * source_size THEN 2.0 * source_size ELSE capped END, total
  FROM (SELECT *, total - coalesce(sum(capped) OVER (), 0) AS rest, sum(CASE WHEN capped IS NULL THEN w END) OVER () AS free FROM f)
  WHERE i < 64),
t AS (SELECT *, coalesce(capped, rest * w / free)::DOUBLE AS target FROM (
    SELECT *, total - coalesce(sum(capped) OVER (), 0) AS rest, sum(CASE WHEN capped IS NULL THEN w END) OVER () AS free FROM f WHERE i = 64)),
b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.whole::BIGINT AS whole, floor(b.target - b.whole * b.source_size + 1e-6)::BIGINT AS budget
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT source, h, doc_id, size, count(*) AS k, budget, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size) AS i
  FROM p WHERE size > 0 GROUP BY source, h, doc_id, size, budget),
g AS (
  SELECT DISTINCT source, 0::BIGINT AS i, budget AS rest, false AS hit FROM r
  UNION ALL
  SELECT r.source, r.i, CASE WHEN r.size * r.k <= g.rest THEN g.rest - r.size * r.k ELSE g.rest END, r.size * r.k <= g.rest
  FROM g JOIN r ON r.source IS NOT DISTINCT FROM g.source AND r.i = g.i + 1)
SELECT p.doc_id, p.size, p.source_size, p.target, ((p.whole + CASE WHEN coalesce(g.hit, false) THEN 1 ELSE 0 END) * p.size)::BIGINT AS taken
FROM p LEFT JOIN r ON r.source IS NOT DISTINCT FROM p.source AND r.h = p.h AND r.doc_id IS NOT DISTINCT FROM p.doc_id AND r.size = p.size
LEFT JOIN g ON g.source IS NOT DISTINCT FROM r.source AND g.i = r.i
"""
