"""SimHash near-duplicates.

*Fingerprints.*  The hashes of a document's word shingles, repeats included,
vote on each of 64 bits: a bit is set if it is in over half of them.

*Links.*  Equal fingerprints are one node, counted before they are shuffled, so
that a group of copies of any size is one node.  Nodes within ``K`` bits are found
by the search of :mod:`sluice.llm.pigeonhole`, which returns links that hold
each group together instead of all its pairs.

*Classes.*  :mod:`sluice.llm.components` joins the links; a class is named by
its smallest document.

Null text has no words and the fingerprint 0, linked like any other.  A row with
a null id has a fingerprint but no class, and links nothing.  Rows that repeat
an id are nodes by their own texts.  Long texts are hashed some thousand shingles
at a time.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import pigeonhole
from sluice.llm.common import durable, small_batches
from sluice.llm.components import components

#: Differing bits of a link, words of a shingle, and shingles hashed at once.
K, SHINGLE, BLOCK = 2, 3, 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return _hash(b" ".join(words))
    votes, n = np.zeros(64, dtype=np.int64), len(words) - shingle + 1
    for lo in range(0, n, BLOCK):
        own = words[lo : lo + BLOCK + shingle - 1]
        line = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)) + 1)
        begin, end = [0, *ends[:-1].tolist()], (ends[shingle - 1 :] - 1).tolist()
        hashes = [_hash(line[a:b]) for a, b in zip(begin, end, strict=False)]
        votes += np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's bits) of every row."""

    def run(batches):
        for batch in small_batches(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, fp long")


def classes(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row; one row per document with its class, no pairs."""
    prints = durable(fingerprints(docs, shingle))
    nodes = durable(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(pigeonhole.links(nodes.select("fp"), k))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = durable(placed)
    # made before it is joined, so that the adaptive join can split a class of very many fingerprints
    named = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = placed.join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    # many rows may share a fingerprint; the adaptive join splits such a key
    both = prints.join(named, F.col("fp") == F.col("_fp"), "left")
    return both.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
