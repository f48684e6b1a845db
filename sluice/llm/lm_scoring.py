"""Cross-entropy difference of two matched n-gram models.

A target model is counted over the documents whose ids are given, a background
model over all documents.  Both are bigram models over one vocabulary, the
``vocabulary`` most frequent words of all documents (others are one unknown
word), with the same order and smoothing.  Each token's loss under either model
is -log2 p(word | word before it); a document's score is the mean difference,
target less background: the lower, the more it is like the target.

    p1(w)     = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(h, w) + MU p1(w)) / (c(h) + MU)

All counts are exact and come from every word of every document, and those of
the document itself are left out of both models while it is scored, so that a
score doesn't tell whether a document was counted.  With them or without, the
probabilities after any word sum to 1.

1. The vocabulary is counted, and each document becomes a row of word ids.
2. Bigrams are counted in each task and summed by shard, for both models in one
   row.  Shards are ranges of scattered bigram numbers, as many as the corpus has
   millions of words; this table grows with the corpus and stays distributed.  The
   counts of single words, one row for each of the vocabulary, follow from it.
3. Documents ask for the counts of their bigrams.  The most frequent ones, at
   most ``HOT``, are broadcast, so that no bigram that comes everywhere is asked
   for; the others meet the counts of their shard, which a task holds one at a time
   while the questions stream by.

Texts are read in pieces of some MB; a longer one is a piece by itself.  Null and
empty texts have no tokens and null losses; documents that repeat an id are
target documents together; null ids are never targets; an empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import durable, small_batches

#: Words of the shared vocabulary, weight of the unigram model, and bigrams whose counts are broadcast at most.
VOCABULARY, MU, HOT = 50_000, 2.0, 1 << 19
#: Distinct words and bigrams that a task holds before it sends their counts, and words of the corpus for each shard.
HELD_WORDS, HELD_BIGRAMS, TOKENS_A_SHARD = 300_000, 1 << 20, 1 << 20
#: log2 of the numbers of a block of documents, whose sums are one row.
DOC_BITS = 10
_ODD = 0x9E3779B97F4A7C15
MODELS = ("target", "background")


def vocabulary(docs: DataFrame, size: int = VOCABULARY) -> tuple[dict[bytes, int], int]:
    """Ids from 1 of the most frequent words, ties by bytes, and the number of all words."""

    def count(batches):
        held: Counter[bytes] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), type=pa.binary()), pa.array(list(held.values()), type=pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in small_batches(batches, 0):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    held.update(text.split())
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    words = durable(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # a short histogram of the counts' magnitudes tells which words can be among the first, so that only these are sorted
    magnitude = F.floor(16 * F.log2("n"))
    least, held, tokens = 0, 0, 0
    for r in sorted(words.groupBy(magnitude.alias("m")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect(), key=lambda r: -r.m):
        tokens += r["n"]
        if held < size:
            least, held = r.m, held + r.words
    top = words.where(magnitude >= F.lit(least)).orderBy(F.desc("n"), "word").limit(size).select("word").toArrow()["word"].to_pylist()
    return {bytes(w): i + 1 for i, w in enumerate(top)}, tokens


def _kind(width: int) -> np.dtype:
    """The type of a stored word id."""
    return np.dtype("<u2" if width <= 1 << 16 else "<u4")


def encoded(docs: DataFrame, targets: DataFrame, known) -> DataFrame:
    """rid (a number of the row), doc_id, target and the ids of its words, of every document."""

    def run(batches):
        get, kind = known.value.get, _kind(len(known.value) + 2)
        for batch in small_batches(batches):
            blobs = [np.array([get(w, 0) for w in (t or b"").split()], dtype=kind).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, type=pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, ids binary")
    ids = targets.select(F.col("doc_id").cast("long").alias("_t")).where("_t is not null").distinct()
    # labels grow with the documents, so they are never broadcast; only ids of words are shuffled, not texts
    marked = rows.join(ids.hint("merge"), F.col("doc_id") == F.col("_t"), "left")
    return durable(marked.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("_t").isNotNull().alias("target"), "ids"))


def _tokens(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word before (``width`` - 1 at the start) and word of each token; ``ids`` is the last column."""
    blobs = batch.column(batch.num_columns - 1).to_pylist()
    kind = _kind(width)
    n = np.array([len(b) // kind.itemsize for b in blobs], dtype=np.int64)
    ids = np.frombuffer(b"".join(blobs), dtype=kind).astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = width - 1
    return np.repeat(np.arange(len(n)), n), before, ids


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers as compressed planes of bytes, as many as the largest needs."""
    size = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :size]
    return zlib.compress(len(values).to_bytes(8, "little") + planes.T.tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    raw = zlib.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = np.frombuffer(raw, dtype=np.uint8, offset=8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view("<i8")


class Shards:
    """Bigrams (word before * width + word) as scattered numbers, and these in ranges of equal width."""

    def __init__(self, width: int, tokens: int):
        self.width = width
        self.bits = (width * width - 1).bit_length()
        self.shard_bits = min(self.bits, (tokens // TOKENS_A_SHARD).bit_length())
        self.mask = (1 << self.bits) - 1
        self.back = pow(_ODD, -1, 1 << 64)

    def scatter(self, bigram: np.ndarray) -> np.ndarray:
        return (bigram.astype(np.uint64) * np.uint64(_ODD) & np.uint64(self.mask)).astype(np.int64)

    def gather(self, scattered: np.ndarray) -> np.ndarray:
        return (scattered.astype(np.uint64) * np.uint64(self.back) & np.uint64(self.mask)).astype(np.int64)

    def cut(self, scattered: np.ndarray):
        """(shard, from, to) of sorted numbers."""
        shard = scattered >> (self.bits - self.shard_bits)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]).tolist()
        return [(int(shard[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]


def _steps(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0))


def _summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys and sums of (keys, numbers, ...) parts."""
    keys, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
    return keys, *(np.bincount(where, weights=np.concatenate(c), minlength=len(keys)) for c in list(zip(*held, strict=True))[1:])


def _row(names: str, *columns) -> pa.RecordBatch:
    """One row; integers as numbers, bytes as bytes."""
    return pa.RecordBatch.from_arrays([pa.array([c], type=pa.binary() if isinstance(c, bytes) else pa.int64()) for c in columns], names=names.split())


def bigrams(coded: DataFrame, shards: Shards) -> DataFrame:
    """shard, keys (scattered bigrams, packed), target, background: exact counts of both models, one row a shard."""
    width = shards.width
    names = "shard keys target background"
    schema = "shard long, keys binary, target binary, background binary"

    def count(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out(sums):
            for shard, a, b in shards.cut(sums[0]):
                yield _row(names, shard, _steps(sums[0][a:b]), *(pack(c[a:b]) for c in sums[1:]))

        for batch in small_batches(batches):
            row, before, ids = _tokens(batch, width)
            keys, where, n = np.unique(shards.scatter(before * width + ids), return_inverse=True, return_counts=True)
            target = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((keys, np.bincount(where, weights=target[row], minlength=len(keys)), n))
            size += len(keys)
            if size > HELD_BIGRAMS:
                held = [_summed(held)]
                size = len(held[0][0])
                if 2 * size > HELD_BIGRAMS:
                    yield from out(held[0])
                    held, size = [], 0
        if held:
            yield from out(_summed(held))

    def add(batches):
        held: list[tuple[np.ndarray, ...]] = []
        at, size = None, 0
        for batch in batches:
            for shard, keys, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and held:
                    sums = _summed(held)
                    yield _row(names, at, _steps(sums[0]), *map(pack, sums[1:]))
                    held, size = [], 0
                at = shard
                held.append((np.cumsum(unpack(keys)), *map(unpack, counts)))
                size += len(held[-1][0])
                if size > HELD_BIGRAMS:
                    held = [_summed(held)]
                    size = len(held[0][0]) // 2
        if held:
            sums = _summed(held)
            yield _row(names, at, _steps(sums[0]), *map(pack, sums[1:]))

    sent = coded.select("target", "ids").mapInArrow(count, schema)
    return durable(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, schema))


def _magnitude(n: np.ndarray) -> np.ndarray:
    return np.floor(16 * np.log2(np.maximum(n, 1))).astype(np.int64)


def word_counts(counted: DataFrame, shards: Shards) -> tuple[np.ndarray, np.ndarray]:
    """Counts [target or background, word or word before, id], and how many bigrams have each magnitude.

    At most two rows a word of the vocabulary, and 1,024 magnitudes, reach the driver.
    """
    width = shards.width

    def run(batches):
        sums, sizes = np.zeros((2, 2, width)), np.zeros(1024, dtype=np.int64)
        for batch in batches:
            for keys, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bigram, both = shards.gather(np.cumsum(unpack(keys))), [unpack(c) for c in counts]
                for kind, ids in enumerate((bigram % width, bigram // width)):
                    for m in (0, 1):
                        sums[m, kind] += np.bincount(ids, weights=both[m], minlength=width)
                sizes += np.bincount(_magnitude(both[1]), minlength=1024)
        flat = [*sums.reshape(2, -1).astype(np.int64)]
        columns = [np.arange(2 * width + 1024), np.concatenate([flat[0], sizes]), np.concatenate([flat[1], sizes])]
        some = np.flatnonzero(columns[2])
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=["id", *MODELS])

    found = counted.select("keys", *MODELS).mapInArrow(run, "id long, target long, background long").groupBy("id").agg(*(F.sum(m).alias(m) for m in MODELS)).toArrow()
    out = np.zeros((2, 2 * width + 1024), dtype=np.int64)
    for m, name in enumerate(MODELS):
        out[m, found["id"].to_numpy()] = found[name].to_numpy()
    return out[:, : 2 * width].reshape(2, 2, width), out[0, 2 * width :]


def frequent(counted: DataFrame, shards: Shards, sizes: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Bigrams, sorted, with both counts: all those of the greatest magnitudes that together are ``most`` at most."""
    upto = np.cumsum(sizes[::-1])[::-1]
    few = int(np.argmax(upto <= most))

    def run(batches):
        for batch in batches:
            for keys, *counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bigram, both = shards.gather(np.cumsum(unpack(keys))), [unpack(c) for c in counts]
                top = np.flatnonzero(_magnitude(both[1]) >= few)
                yield pa.RecordBatch.from_arrays([pa.array(c[top]) for c in (bigram, *both)], names=["bigram", *MODELS])

    found = counted.select("keys", *MODELS).mapInArrow(run, "bigram long, target long, background long").toArrow()
    order = np.argsort(found["bigram"].to_numpy())
    return tuple(found[c].to_numpy()[order] for c in ("bigram", *MODELS))


def _by_block(rids: np.ndarray, sums, doc_ids: pa.Array | None = None, n_tokens: np.ndarray | None = None) -> pa.RecordBatch:
    """Sums of documents, sorted by rid, in one row for each block of them; the documents themselves come before what is added."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(rids >> DOC_BITS)) + 1, [len(rids)]]).tolist()
    spans = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]
    offsets = pa.array([0, *(b for _, b in spans)], type=pa.int32())
    none = pa.nulls(len(spans), pa.list_(pa.int64()))
    lists = lambda v: none if v is None else pa.ListArray.from_arrays(offsets, v if isinstance(v, pa.Array) else pa.array(v))
    columns = [pa.array([int(rids[a]) >> DOC_BITS for a, _ in spans], type=pa.int64()), pa.array([int(doc_ids is None)] * len(spans), type=pa.int64()), pa.array([_steps(rids[a:b]) for a, b in spans], type=pa.binary())]
    columns += [lists(doc_ids), lists(n_tokens), *(pa.array([v[a:b].astype("<f8").tobytes() for a, b in spans], type=pa.binary()) for v in sums)]
    return pa.RecordBatch.from_arrays(columns, names=["block", "kind", "rids", "doc_ids", "n_tokens", *MODELS])


_BLOCKS = "block long, kind long, rids binary, doc_ids array<long>, n_tokens array<long>, target binary, background binary"
SCHEMA = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


def _means(batches):
    """Scores of the documents of blocks, which come sorted by block, the documents first."""
    at, docs, more = None, [], []

    def out():
        rids = np.concatenate([d[0] for d in docs])
        ids, n = (pa.concat_arrays([d[i] for d in docs]) for i in (1, 2))
        sums = [np.concatenate([d[3][m] for d in docs]) for m in (0, 1)]
        if more:
            order = np.argsort(rids)
            place = order[np.searchsorted(rids[order], np.concatenate([a[0] for a in more]))]
            for m in (0, 1):
                sums[m] = sums[m] + np.bincount(place, weights=np.concatenate([a[1][m] for a in more]), minlength=len(rids))
        size = n.to_numpy()
        means = [v / np.maximum(size, 1) for v in sums]
        return pa.RecordBatch.from_arrays([ids, n, *(pa.array(v, mask=size == 0) for v in (*means, means[0] - means[1]))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    for batch in batches:
        for i, (block, kind, steps) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            if block != at and docs:
                yield out()
                docs, more = [], []
            at = block
            rids = np.cumsum(unpack(steps))
            sums = [np.frombuffer(batch.column(c)[i].as_py(), dtype="<f8") for c in (5, 6)]
            if kind:
                more.append((rids, sums))
            else:
                docs.append((rids, batch.column(3)[i].values, batch.column(4)[i].values, sums))
    if docs:
        yield out()


def _own(row: np.ndarray, key: np.ndarray, base: int) -> np.ndarray:
    """How often each token's key comes in its row."""
    _, where, n = np.unique(row * base + key, return_inverse=True, return_counts=True)
    return n[where]


def score(docs: DataFrame, targets: DataFrame, size: int = VOCABULARY, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score; ``targets`` has the column doc_id."""
    context = docs.sparkSession.sparkContext
    words, tokens = vocabulary(docs, size)
    known = context.broadcast(words)
    # ids run from 0 (unknown) to width - 2, the last one stands for the start of a text
    width = len(words) + 2
    shards = Shards(width, tokens)
    coded = encoded(docs, targets, known)
    counted = bigrams(coded, shards)
    singles, sizes = word_counts(counted, shards)
    shared = context.broadcast((singles, *frequent(counted, shards, sizes, hot)))
    totals = singles[:, 0].sum(axis=1)

    def look_up(batches):
        """For each document and bigram of it (row, bigram, n, and its place among the broadcast ones) what scoring needs."""
        keys = shared.value[1]
        for batch in small_batches(batches):
            row, before, ids = _tokens(batch, width)
            bigram = before * width + ids
            own_word, own_before = _own(row, ids, width), _own(row, before, width)
            _, at, n = np.unique(row * (width * width) + bigram, return_index=True, return_counts=True)
            row, before, ids, bigram, own_word, own_before = (x[at] for x in (row, before, ids, bigram, own_word, own_before))
            place = np.minimum(np.searchsorted(keys, bigram), max(len(keys) - 1, 0))
            here = keys[place] == bigram if len(keys) else np.zeros(len(bigram), dtype=bool)
            n_row = np.bincount(row, weights=n, minlength=batch.num_rows).astype(np.int64)
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch, n_row, target, row, before, ids, bigram, n, own_word, own_before, place, here

    def known_part(batches):
        """A row for each document: the sums that need no further count."""
        singles, _, *frequent_counts = shared.value
        for batch, n_row, target, row, before, ids, _, n, own_word, own_before, place, here in look_up(batches):
            columns = []
            for m in (0, 1):
                own = target[row] if m == 0 else np.ones(len(row), dtype=np.int64)
                bits = np.log2(singles[m, 1][before] - own * own_before + MU)
                p1 = (singles[m, 0][ids] - own * own_word + 1) / (totals[m] - own * n_row[row] + width - 1)
                bits[here] -= np.log2(frequent_counts[m][place[here]] - (own * n)[here] + MU * p1[here])
                columns.append(np.bincount(row, weights=n * bits, minlength=batch.num_rows))
            yield _by_block(batch.column(0).to_numpy(), columns, batch.column(1), n_row)

    asked_names = "shard kind keys at n own_word rids sizes"
    asked_schema = "shard long, kind long, keys binary, at binary, n binary, own_word binary, rids binary, sizes binary"

    def ask(batches):
        """A row for each shard that a piece of the documents asks: bigrams, their documents and own counts."""
        for batch, n_row, target, row, _, _, bigram, n, own_word, _, _, here in look_up(batches):
            rids = batch.column(0).to_numpy()
            asks = np.flatnonzero(~here)
            key = shards.scatter(bigram[asks])
            order = np.argsort(key, kind="stable")
            key, asks = key[order], asks[order]
            for shard, a, b in shards.cut(key):
                some, at = np.unique(row[asks[a:b]], return_inverse=True)
                yield _row(asked_names, shard, 1, _steps(key[a:b]), pack(at), pack(n[asks[a:b]]), pack(own_word[asks[a:b]]), _steps(rids[some]), pack(2 * n_row[some] + target[some]))

    def answer(batches):
        """Sums by document; a shard's counts come before what is asked of it."""
        singles = shared.value[0]
        keys, counts, held, size = None, None, [], 0

        for batch in batches:
            for _, kind, steps, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = np.cumsum(unpack(steps))
                if kind == 0:
                    keys, counts = key, [unpack(b) for b in blobs[:2]]
                    continue
                at, n, own_word, rid_steps, sizes = map(unpack, blobs)
                place, ids = np.searchsorted(keys, key), shards.gather(key) % width
                n_row, target = sizes[at] >> 1, sizes[at] & 1
                bits = []
                for m in (0, 1):
                    own = target if m == 0 else 1
                    p1 = (singles[m, 0][ids] - own * own_word + 1) / (totals[m] - own * n_row + width - 1)
                    bits.append(-n * np.log2(counts[m][place] - own * n + MU * p1))
                held.append((np.cumsum(rid_steps)[at], *bits))
                size += len(key)
                if size > HELD_BIGRAMS:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD_BIGRAMS:
                        yield _by_block(held[0][0], held[0][1:])
                        held, size = [], 0
        if held:
            rids, *sums = _summed(held)
            yield _by_block(rids, sums)

    rows = coded.select("rid", "doc_id", "target", "ids")
    nothing = F.lit(None).cast("binary")
    table = counted.select("shard", F.lit(0).cast("long").alias("kind"), "keys", F.col("target").alias("at"), F.col("background").alias("n"), nothing.alias("own_word"), nothing.alias("rids"), nothing.alias("sizes"))
    met = table.union(rows.mapInArrow(ask, asked_schema)).repartition("shard").sortWithinPartitions("shard", "kind")
    parts = rows.mapInArrow(known_part, _BLOCKS).union(met.mapInArrow(answer, _BLOCKS))
    return parts.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(_means, SCHEMA)


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false)::INT AS target FROM documents),
t AS (SELECT rid, target, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS id FROM t GROUP BY w QUALIFY id <= {VOCABULARY}),
n AS (SELECT count(*) AS v FROM v),
x AS (SELECT rid, target, i, coalesce(v.id, 0) AS w FROM t LEFT JOIN v ON t.w = v.w),
y AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY rid ORDER BY i), -1) AS h FROM x),
k AS (SELECT rid, target, h, w, count(*) AS k, sum(count(*)) OVER (PARTITION BY rid, w) AS kw,
    sum(count(*)) OVER (PARTITION BY rid, h) AS kh, sum(count(*)) OVER (PARTITION BY rid) AS kn FROM y GROUP BY rid, target, h, w),
cc AS (SELECT h, w, sum(k) AS b, sum(k * target) AS t FROM k GROUP BY h, w),
cw AS (SELECT w, sum(b) AS b, sum(t) AS t FROM cc GROUP BY w),
ch AS (SELECT h, sum(b) AS b, sum(t) AS t FROM cc GROUP BY h),
s AS (SELECT sum(b) AS b, sum(t) AS t FROM cc),
l AS (SELECT k.rid, k.k, k.kn,
    -log2((cc.t - k.k * target + {MU} * (cw.t - kw * target + 1) / (s.t - kn * target + n.v + 1)) / (ch.t - kh * target + {MU})) AS lt,
    -log2((cc.b - k.k + {MU} * (cw.b - kw + 1) / (s.b - kn + n.v + 1)) / (ch.b - kh + {MU})) AS lb
  FROM k JOIN cc ON cc.h = k.h AND cc.w = k.w JOIN cw ON cw.w = k.w JOIN ch ON ch.h = k.h, s, n),
m AS (SELECT rid, sum(k * lt) / any_value(kn) AS lt, sum(k * lb) / any_value(kn) AS lb FROM l GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lt - lb, 6) AS score
FROM d LEFT JOIN m USING (rid)
"""
