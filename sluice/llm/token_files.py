"""Token-id files of patched frame-of-reference blocks.

File layout, little-endian:

    "SLTF" u32 version | u32 block | u64 documents | u64 ids
    documents x (u8 has_id, i64 doc_id, u64 ids)
    (blocks + 1) x u64   byte offset of each block from the first one
    blocks               u32 minimum | u8 width | u16 exceptions
                         packed low bits of value - minimum, ``width`` each
                         exceptions x u16 position, exceptions x u32 high bits

A block's width is that of the ``percentile`` of its differences; the values
beyond it keep their high bits in the exception list.  The block index lets a
reader decode any range of ids alone.

Documents are range-partitioned by id, encoded and written by the task that
holds them, under names that depend on the partition alone and by renaming, so
a task that runs again replaces its own files.  A file holds ``file_ids`` ids or
one document.  The manifest, a row per file, is a table; the driver sees one row
per partition.

Null text is empty (its end id remains); rows with a null id come first;
repeated ids are ordered by text; an empty table writes no file.  Texts are
encoded in pieces of some MB, a longer one by itself; a document's ids are in one file.
Other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import durable, qualified, scratch_path, small_batches
from sluice.llm.tokens import default_vocabulary, encoder

HEAD = struct.Struct("<4sIIQQ")
DOC = np.dtype([("has_id", "<u1"), ("doc_id", "<i8"), ("ids", "<u8")])
BLOCK = 1024


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of unsigned 32-bit values to rows of packed bytes, ``width`` bits each."""
    if not width:
        return np.zeros((len(values), 0), dtype=np.uint8)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8), axis=1, bitorder="little")
    bits = bits.reshape(len(values), -1, 8 * size)[:, :, :width].reshape(len(values), -1)
    return np.packbits(bits, axis=1, bitorder="little")


def _unpack_bits(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(packed), n), dtype=np.uint32)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : n * width].reshape(len(packed), n, width)
    full = np.zeros((len(packed), n, 8 * size), dtype=np.uint8)
    full[:, :, :width] = bits
    return np.packbits(full, axis=2, bitorder="little").view(f"<u{size}")[:, :, 0].astype(np.uint32)


def _encode_blocks(rows: np.ndarray, percentile: float) -> list[bytes]:
    low = rows.min(axis=1)
    over = rows - low[:, None]
    rank = min(rows.shape[1] - 1, int(percentile * rows.shape[1]))
    typical = np.partition(over, rank, axis=1)[:, rank]
    widths = np.array([int(v).bit_length() for v in typical.tolist()])
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = over[at]
        packed = _pack_bits(part & np.uint32((1 << width) - 1), width)
        high = (part.astype(np.uint64) >> np.uint64(width)).astype("<u4")
        for i, k in enumerate(at.tolist()):
            where = np.flatnonzero(high[i])
            out[k] = struct.pack("<IBH", int(low[k]), width, len(where)) + packed[i].tobytes() + where.astype("<u2").tobytes() + high[i][where].tobytes()
    return out


def encode_file(docs: list[tuple[int | None, int]], ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """A file of ``ids`` (unsigned 32-bit) that belong to (doc_id, number of ids) in turn."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    whole = len(ids) - len(ids) % BLOCK
    blocks: list[bytes] = []
    for lo in range(0, whole, 512 * BLOCK):
        blocks += _encode_blocks(ids[lo : min(whole, lo + 512 * BLOCK)].reshape(-1, BLOCK), percentile)
    if whole < len(ids):
        blocks += _encode_blocks(ids[whole:].reshape(1, -1), percentile)
    table = np.array([(d is not None, d or 0, n) for d, n in docs], dtype=DOC)
    index = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return HEAD.pack(b"SLTF", 1, BLOCK, len(docs), len(ids)) + table.tobytes() + index.tobytes() + b"".join(blocks)


def _open(data: bytes):
    magic, version, block, n_docs, n_ids = HEAD.unpack_from(data)
    if magic != b"SLTF" or version != 1:
        raise ValueError("not a token file")
    docs = np.frombuffer(data, dtype=DOC, count=n_docs, offset=HEAD.size)
    at = HEAD.size + docs.nbytes
    index = np.frombuffer(data, dtype="<u8", count=-(-n_ids // block) + 1, offset=at)
    return docs, index, at + index.nbytes, block, n_ids


def read_ids(data: bytes, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Ids lo to hi (all without them) of a file; only their blocks are decoded."""
    _, index, base, block, n_ids = _open(data)
    hi = n_ids if hi is None else min(hi, n_ids)
    if lo >= hi:
        return np.zeros(0, dtype=np.uint32)
    first, last = lo // block, -(-hi // block)
    out = np.empty((last - first) * block, dtype=np.uint32)
    buf = np.frombuffer(data, dtype=np.uint8)
    heads = [struct.unpack_from("<IBH", data, base + int(o)) for o in index[first:last]]
    groups: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, _) in enumerate(heads):
        n = min(block, n_ids - (first + k) * block)
        groups.setdefault((width, n), []).append(k)
    for (width, n), ks in groups.items():
        size = -(-n * width // 8)
        for part in (ks[i : i + 512] for i in range(0, len(ks), 512)):
            at = base + index[first:last][part].astype(np.int64) + 7
            values = _unpack_bits(buf[at[:, None] + np.arange(size)], width, n)
            for row, k, o in zip(values, part, at.tolist(), strict=True):
                low, _, odd = heads[k]
                if odd:
                    where = np.frombuffer(data, dtype="<u2", count=odd, offset=o + size)
                    high = np.frombuffer(data, dtype="<u4", count=odd, offset=o + size + 2 * odd)
                    row[where] |= (high.astype(np.uint64) << np.uint64(width)).astype(np.uint32)
                out[k * block : k * block + n] = row + np.uint32(low)
    return out[lo - first * block : hi - first * block]


def decode_file(data: bytes) -> tuple[list[tuple[int | None, int]], np.ndarray]:
    docs = _open(data)[0]
    return [(d if h else None, n) for h, d, n in docs.tolist()], read_ids(data)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, *, end_id: int = 0, vocabulary: str | None = None, percentile: float = 0.9, file_ids: int = 1 << 22) -> DataFrame:
    """Writes all documents in ascending id order; the manifest (file, documents, ids, start), ``start`` being the ids in files before."""
    spark = docs.sparkSession
    path = qualified(spark, path)
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        store, root = _filesystem(path)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        held: list[tuple[int | None, bytes]] = []
        written: list[tuple] = []

        def flush():
            ids = np.frombuffer(b"".join(x for _, x in held), dtype=enc.dtype)
            data = encode_file([(d, len(x) // enc.dtype.itemsize) for d, x in held], ids, percentile)
            file = f"ids-{part:06d}-{len(written):06d}.sltf"
            name = f"{root}/{file}"
            with store.open_output_stream(f"{name}.{attempt}") as out:
                out.write(data)
            store.move(f"{name}.{attempt}", name)
            written.append((part, len(written), f"{path}/{file}", len(held), len(ids)))
            held.clear()

        size = 0
        for batch in small_batches(batches, rows=1 << 14, size=8 << 20):
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += end
                if held and size + len(ids) > file_ids * enc.dtype.itemsize:
                    flush()
                    size = 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            flush()
        columns = list(zip(*written, strict=True)) if written else [()] * 5
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["part", "k", "file", "documents", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = durable(rows.mapInArrow(run, "part int, k int, file string, documents long, ids long"))
    at, starts = 0, []
    for r in sorted(manifest.groupBy("part").agg(F.sum("ids").alias("ids")).collect()):
        starts.append((r.part, at))
        at += r["ids"]
    first = spark.createDataFrame(starts, "part int, first long")
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("k")) - F.col("ids")
    return manifest.join(first, "part").select("file", "documents", "ids", (F.col("first") + before).alias("start"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the manifest's files (file, start)."""
    context = manifest.sparkSession.sparkContext

    def run(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _filesystem(name)
                with store.open_input_stream(name) as f:
                    docs, ids = decode_file(f.read())
                ids, lo, out = ids.astype("<u4"), 0, []
                for doc, n in docs:
                    out.append((doc, at + lo, n, zlib.crc32(ids[lo : lo + n].tobytes())))
                    lo += n
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row per file: dealt evenly, at most as many tasks as files
    named = manifest.select("file", "start").repartition(max(1, min(4 * context.defaultParallelism, manifest.count())))
    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token_files")
    return read_token_files(write_token_files(docs, path, **options))
