"""Connected components of links too many for one machine.

Alternating large-star and small-star steps (Kiveris et al., 2014) until the
links stop changing: then every node is linked to the least of its component.
A round is two aggregations and two joins over (node, node) rows.  Minima are
pre-aggregated before they are shuffled, and a node with very many links is
split by the adaptive join, since a join needs no key's rows together.

A caller may say how many links are few: one task joins those, without rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import durable


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a > b) with each node's neighbours moved to the least of them and itself."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links that aren't the least of their component, and that least one."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = label[a[apart]], label[b[apart]]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _joined(batches):
    columns = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if columns:
        found = joined(*(np.concatenate(x) for x in zip(*columns, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root"])


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) for each node of ``links`` (columns a, b of one type) that isn't its own root; root is the least.

    Up to ``few`` links, of longs, are joined by one task.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = durable(links)
    state = _state(links)
    if 0 < state[0] <= few:
        return durable(links.coalesce(1).mapInArrow(_joined, "node long, root long"))
    while state[0]:
        links = durable(_star(_star(links, large=True), large=False))
        now = _state(links)
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
