"""Exact substring dedup behind a count-min prefilter.

A window is ``width`` consecutive words of one document.  A word goes if a
window that covers it also starts in a document with a smaller id.

1. *Sketch.*  A window's key in the sketch is its anchor: of the runs of
   ``width // 3`` words in it, the one with the least hash.  Equal windows have
   equal anchors, so the count of an anchor bounds that of each of its windows
   from above, and neighbouring windows share anchors, so that there are about
   a twentieth as many keys as windows.  Every partition counts its anchors in a
   count-min sketch of two rows and sends the cells that it has; the sketches
   are merged by cell range, and of each cell only "twice or more" and "often"
   are kept, one bit each.  The width follows the input's size up to
   ``MOST_BITS``, which bounds the broadcast; beyond it more windows pass on.
2. *Exact grouping.*  Only windows whose anchor is estimated repeated go on, as
   one row for each document and anchor, with the hashes and places of its
   windows; those of an anchor that is estimated to come often are dealt by anchor
   and window, so that no key grows hot.  Before that each batch settles its own
   repeats: of equal windows only those in its smallest document ask further, so a
   window has one row per batch at most, however often the document repeats it
   (a row holds ``ROW`` places).
   Rows come to a task sorted by deal, and windows are grouped by anchor and
   window hash, 128 bits, for some deals at a time, so a task holds a few of
   them whatever its partition's size.
3. The words to remove come back as intervals, are joined to the documents by
   id and a hash of the text, as rows may share an id, and the texts rebuilt.

Nothing is dropped on an estimate: one that is too high only sends a window to
the exact grouping.  Null text has no words; a document with a null id is
neither changed nor changes others, since null is smaller than nothing; rows
with the same id don't change each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.llm.common import hash_words, input_bytes, mix64, powers, small_batches, split_words, text_chunks, whole_keys

#: Cells a row of the sketch: from 2**LEAST_BITS to 2**MOST_BITS (64 MB a bit map), by the input's bytes.
LEAST_BITS, MOST_BITS, SHARD_BITS = 20, 29, 18
#: Estimated occurrences from which an anchor's windows are dealt one by one.
OFTEN = 64
#: Words hashed at once, and windows of a row that asks.
SEGMENT, ROW = 1 << 19, 1 << 16

_POWERS: dict[int, tuple] = {}


def _runs_hash(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of ``width`` words."""
    if base not in _POWERS:
        _POWERS[base] = powers(base, SEGMENT + 1024)
    p, inverse = _POWERS[base]
    if len(h) > len(p):
        p, inverse = powers(base, len(h))
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * p[: len(h)], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * inverse[: len(h) - width + 1])


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    out, reach = values, 1
    while reach * 2 <= span:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(values) - span + 1], out[span - reach :]) if span > reach else out


def windows(texts: pa.Array, width: int):
    """(row, first word, window hashes, anchors) for each document part with windows; parts of long ones follow each other."""
    short = max(1, width // 3)
    for first, buf, offsets in text_chunks(texts):
        starts, ends, bounds = split_words(buf, offsets)
        if not len(starts):
            continue
        hashes = hash_words(buf, starts, ends)
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for lo in range(a, b - width + 1, SEGMENT):
                h = hashes[lo : min(b, lo + SEGMENT + width - 1)]
                yield first + row, lo - a, _runs_hash(h, width, 0x9E3779B97F4A7C15 | 1), _least(_runs_hash(h, short, 0xD1B54A32D192ED03), width - short + 1)


def _all_windows(texts: pa.Array, width: int):
    """All windows of a batch: row, first word, hash, anchor as arrays."""
    parts = list(windows(texts, width))
    if not parts:
        return None
    rows = np.repeat([p[0] for p in parts], [len(p[2]) for p in parts])
    at = np.concatenate([np.arange(p[1], p[1] + len(p[2])) for p in parts])
    return rows, at, np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])


def _cells(anchors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An anchor's cell in each of the two rows."""
    return (anchors >> np.uint64(64 - bits)).astype(np.int64), (mix64(anchors + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """log2 of the cells a row: some eight for each expected anchor (of about 16 million a GB of Parquet)."""
    return int(min(MOST_BITS, max(LEAST_BITS, int(input_bytes(docs) / 8).bit_length())))


def repeated_anchors(docs: DataFrame, width: int, bits: int) -> np.ndarray:
    """Merged sketch as bit maps [row, twice or often, bytes]."""
    shard_bits = min(bits, SHARD_BITS)

    def count(batches):
        for batch in small_batches(batches, 1):
            anchors = []
            for _, _, _, a in windows(batch.column(1), width):
                anchors.append(a[np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))])
            if not anchors:
                continue
            for row, cells in enumerate(_cells(np.concatenate(anchors), bits)):
                cells, n = np.unique(cells, return_counts=True)
                shard = cells >> shard_bits
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(cells)]])
                low = (cells & ((1 << shard_bits) - 1)).astype("<u4")
                n = np.minimum(n, OFTEN).astype(np.uint8)
                out = [(int(shard[a] << 1) | row, low[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "cells", "n"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, cells, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total = sums.setdefault(shard, np.zeros(1 << shard_bits, dtype=np.uint8))
                at = np.frombuffer(cells, dtype="<u4")
                total[at] = np.minimum(total[at].astype(np.uint16) + np.frombuffer(n, dtype=np.uint8), OFTEN)
        for shard, total in sums.items():
            maps = [np.packbits(total >= least, bitorder="little").tobytes() for least in (2, OFTEN)]
            yield pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int64()), pa.array(maps[:1], type=pa.binary()), pa.array(maps[1:], type=pa.binary())], names=["shard", "twice", "often"])

    partial = docs.mapInArrow(count, "shard long, cells binary, n binary")
    merged = partial.repartition("shard").mapInArrow(merge, "shard long, twice binary, often binary")
    maps = np.zeros((2, 2, (1 << bits) // 8), dtype=np.uint8)
    size = (1 << shard_bits) // 8
    for r in merged.toLocalIterator(prefetchPartitions=True):
        at = (r.shard >> 1) * size
        maps[r.shard & 1, 0, at : at + size] = np.frombuffer(r.twice, dtype=np.uint8)
        maps[r.shard & 1, 1, at : at + size] = np.frombuffer(r.often, dtype=np.uint8)
    return maps


def _is_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _merge_runs(doc: np.ndarray, text: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, text, start, end) of the words that windows cover."""
    if not len(doc):
        return doc, text, at, at
    order = np.lexsort((at, text, doc))
    doc, text, at = doc[order], text[order], at[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (at[1:] > at[:-1] + width)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], text[first], at[first], at[last] + width


def _batch(columns: list, kinds: tuple) -> pa.RecordBatch:
    names = ("deal", "doc_id", "text", "start", "stop", "hashes", "places")
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
#: A row is a span that is known to go (start, stop), or asks for windows (hashes and the places of their first words).
_SCHEMA = "deal long, doc_id long, text long, start int, stop int, hashes binary, places binary"


def _ask(maps, width: int, bits: int):
    def run(batches):
        (twice1, often1), (twice2, often2) = maps.value
        for batch in small_batches(batches, 1):
            found = _all_windows(batch.column(1), width)
            if found is None:
                continue
            rows, at, hashes, anchors = found
            one, two = _cells(anchors, bits)
            keep = np.flatnonzero(_is_set(twice1, one) & _is_set(twice2, two))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if batch.column(0).null_count:
                keep = keep[~np.asarray(batch.column(0).is_null())[rows[keep]]]
                ids = np.array([x or 0 for x in batch.column(0).to_pylist()], dtype=np.int64)
            if not len(keep):
                continue
            doc, text, at, hashes, anchors = ids[rows[keep]], batch.column(2).to_numpy()[rows[keep]], at[keep], hashes[keep], anchors[keep]
            often = _is_set(often1, one[keep]) & _is_set(often2, two[keep])
            # of equal windows in this batch, only those in its smallest document ask on
            order = np.lexsort((doc, anchors, hashes))
            h, a = hashes[order], anchors[order]
            head = np.concatenate([[True], (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
            least = doc[order][np.flatnonzero(head)][np.cumsum(head) - 1]
            later = np.zeros(len(doc), dtype=bool)
            later[order] = doc[order] > least
            d, t, s, e = _merge_runs(doc[later], text[later], at[later], width)
            yield _batch([mix64(d.astype(np.uint64) * np.uint64(31) + s.astype(np.uint64)).view(np.int64), d, t, s, e, [None] * len(d), [None] * len(d)], _KINDS)
            ask = np.flatnonzero(~later)
            doc, text, at, hashes, anchors, often = doc[ask], text[ask], at[ask], hashes[ask], anchors[ask], often[ask]
            if not len(doc):
                continue
            deal = np.where(often, mix64(anchors ^ (hashes * np.uint64(3))), anchors).view(np.int64)
            order = np.lexsort((hashes, text, doc, deal))
            deal, doc, text, at, hashes = deal[order], doc[order], text[order], at[order], hashes[order]
            new = np.concatenate([[True], (deal[1:] != deal[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])])
            first = np.flatnonzero(new)
            stop = np.concatenate([first[1:], [len(doc)]])
            if (stop - first).max() > ROW:
                first = np.concatenate([np.arange(i, j, ROW) for i, j in zip(first.tolist(), stop.tolist(), strict=True)])
                stop = np.concatenate([first[1:], [len(doc)]])
            raw, places = hashes.astype("<u8").tobytes(), at.astype("<i4").tobytes()
            for lo in range(0, len(first), 50_000):
                ends = list(zip(first[lo : lo + 50_000].tolist(), stop[lo : lo + 50_000].tolist(), strict=True))
                own = first[lo : lo + 50_000]
                yield _batch([deal[own], doc[own], text[own], at[own], at[own], [raw[8 * i : 8 * j] for i, j in ends], [places[4 * i : 4 * j] for i, j in ends]], _KINDS)

    return run


def _settle(width: int):
    names = ["doc_id", "text", "start", "stop"]

    def run(batches):
        for batch in whole_keys(batches, 4 << 20):
            asked = batch.column(5).is_valid()
            known = batch.filter(pc.invert(asked))
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(i) for i in (1, 2, 3, 4)], names=names)
            rest = batch.filter(asked)
            if not rest.num_rows:
                continue
            deal, doc, text = (rest.column(i).to_numpy() for i in range(3))
            n = pc.binary_length(rest.column(5)).to_numpy().astype(np.int64) // 8
            hashes = np.frombuffer(b"".join(rest.column(5).to_pylist()), dtype="<u8")
            at = np.frombuffer(b"".join(rest.column(6).to_pylist()), dtype="<i4")
            doc, text, deal = np.repeat(doc, n), np.repeat(text, n), np.repeat(deal, n)
            order = np.lexsort((doc, deal, hashes))
            h, k, d = hashes[order], deal[order], doc[order]
            head = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
            later = d > d[np.flatnonzero(head)][np.cumsum(head) - 1]
            d, t, s, e = _merge_runs(d[later], text[order][later], at[order][later], width)
            yield pa.RecordBatch.from_arrays([pa.array(d, type=pa.int64()), pa.array(t, type=pa.int64()), pa.array(s, type=pa.int32()), pa.array(e, type=pa.int32())], names=names)

    return run


def repeated_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, text, spans): the spans of words to remove, as an array of (start, stop), for documents that have some; ``text`` is a hash."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.xxhash64("text").alias("hash"))
    bits = sketch_bits(docs)
    maps = docs.sparkSession.sparkContext.broadcast(repeated_anchors(rows, width, bits))
    asked = rows.mapInArrow(_ask(maps, width, bits), _SCHEMA)
    spans = asked.repartition("deal").sortWithinPartitions("deal").mapInArrow(_settle(width), "doc_id long, text long, start int, stop int")
    return spans.groupBy("doc_id", "text").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _kept(words: list[bytes], spans) -> list[bytes]:
    """The words outside all spans, which may overlap."""
    kept, at = [], 0
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        kept += words[at : max(at, start)]
        at = max(at, stop)
    return kept + words[at:]


def _apply(with_text: bool):
    names = ["n_words", "n_removed", "kept_sha256", *(["_sl_kept"] if with_text else [])]
    kinds = (pa.int64(), pa.int64(), pa.string(), *([pa.string()] if with_text else []))

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                kept = _kept(words, spans) if spans else words
                joined = b" ".join(kept)
                new = None if text is None else (joined if spans else text).decode()
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), *([new] if with_text else [])))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            rows = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["_sl_row", *names])

    return run


def dedup(docs: DataFrame, width: int = 50, *, with_text: bool = True) -> DataFrame:
    """Each row of ``docs`` but its text as struct ``_sl_row``, n_words, n_removed, kept_sha256 and the text that stays as ``_sl_kept``.

    The rows meet their spans in one shuffle by id and text; their spans are bounded by the text.
    """
    spans = repeated_spans(docs, width).select(F.col("doc_id").alias("_sl_id"), F.col("text").alias("_sl_hash"), F.col("spans").alias("_sl_spans"))
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    rows = docs.select(others.alias("_sl_row"), F.col("text").alias("_sl_text"))
    same = (F.col("_sl_row.doc_id").cast("long") == F.col("_sl_id")) & (F.xxhash64("_sl_text") == F.col("_sl_hash"))
    both = rows.join(spans, same, "left").select("_sl_row", "_sl_text", "_sl_spans")
    # a schema as an object, since names may hold any character
    schema = StructType([rows.schema["_sl_row"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    return both.mapInArrow(_apply(with_text), schema.add("_sl_kept", "string") if with_text else schema)


def digests(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    return dedup(docs.select("doc_id", "text"), width, with_text=False).select("_sl_row.doc_id", "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, width: int = 50) -> DataFrame:
    """The documents with repeated passages removed; one that loses all its words goes, the others keep their columns."""
    out = dedup(docs, width).where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col(f"_sl_row.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("_sl_kept")}
    if "n_chars" in columns:
        length = F.length("_sl_kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH b AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, rid, unnest(range(1, len(ws) - 48)) AS i, ws FROM b WHERE len(ws) >= 50),
k AS (SELECT doc_id, rid, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM p),
r AS (SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS least FROM k) WHERE least < doc_id),
g AS (SELECT DISTINCT rid, i + d AS i FROM r, (SELECT unnest(range(0, 50)) AS d)),
y AS (SELECT b.rid, unnest(b.ws) AS w, unnest(range(1, len(b.ws) + 1)) AS i FROM b),
z AS (SELECT y.rid, string_agg(y.w, ' ' ORDER BY y.i) AS kept, count(*) AS n FROM y LEFT JOIN g ON g.rid = y.rid AND g.i = y.i WHERE g.i IS NULL GROUP BY y.rid)
SELECT b.doc_id, CAST(len(b.ws) AS BIGINT) AS n_words, CAST(len(b.ws) - coalesce(z.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(z.kept, '')) AS kept_sha256
FROM b LEFT JOIN z USING (rid)
"""
