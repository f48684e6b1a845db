"""Near-duplicates: five-word shingles, similarity 0.8 or more, found by SimHash.

*Fingerprints.*  A document has ``PRINTS`` SimHash fingerprints of 64 bits over its set of
five-word shingles, each of hashes of its own: a bit is set if it is in over half of them.

*Candidates.*  Each fingerprint is searched as in :mod:`sluice.llm.pigeonhole`: its bits are put
into ``PARTS`` groups by correlation, every fingerprint has thresholds of its own by dynamic
programming, and probes meet the entries of a value.  Two documents are candidates if such a probe
finds one of the two, and they differ in at most ``FAR`` bits over this fingerprint and the next.
So no pair within ``K`` bits of any fingerprint and ``FAR`` of the two is lost.  Of two documents
of similarity 0.8 a bit differs with the probability 0.15, and a group of 13 is equal with 0.12:
one of all 80 groups is with 1 - 3e-5, by calculation.

*Groups.*  A task returns a spanning forest of its candidates; the components of these links
hold all candidates together.  They decide only which documents meet.  The first ``FIRST``
fingerprints are searched by themselves, and what they join is one node in the search of the
others, so that a large group of near copies isn't linked again by each of the 80 groups of bits.

*Verification.*  The documents of a component meet with their sets of shingles, and the exact
Jaccard similarity of each two that aren't linked yet, candidates or not, is looked at.  A link
that fails is thus never missed for another.  A component of more than ``PIECE``
shingles is dealt out as pieces, so that a task stays small: first each piece meets by itself
and with the document that most others are candidates of; then only the classes this makes
meet each other, large ones in pieces, small ones pooled.  Of a class, no two pieces meet, so
many near copies of one text cost no more than their number.  Pairs below 0.8 never link.

Words are those of :mod:`sluice.llm.common`, with A-Z in lower case; fewer than five
words are one shingle.  Documents of equal words are one node, counted
before any search; null and empty texts have no words and equal each other.  Rows with
a null id are kept and link nothing.  Of rows that repeat id and text one is kept.  An
empty table gives no rows.  Other columns are kept as they are.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import pigeonhole
from sluice.llm.common import durable, hash_words, mix64, split_words, text_chunks, whole_keys
from sluice.llm.components import components

#: Words of a shingle, least similarity, fingerprints of a document, and groups of a fingerprint's bits.
SHINGLE, SIMILAR, PRINTS, PARTS = 5, 0.8, 16, 5
#: Fingerprints searched before the others, and links that one task joins.
FIRST, FEW_LINKS = 2, 1 << 18
#: Bits of a fingerprint within which the search is exact, and bits in which candidates differ at most in two fingerprints.
K, FAR = PARTS - 1, 30
#: Shingles hashed at a time, shingles of a piece of a component, and ids up to which they are broadcast.
BLOCK, PIECE, FEW_IDS = 1020, 1 << 18, 1 << 18
#: Documents counted by a task, entries of a share, rows compared at once, and documents that a crowded value is compared with first.
COUNTED, SHARE, SIDE, HUBS = 1 << 16, 1 << 18, 1024, 8
_ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_PRINT_ODD = mix64(np.arange(1, PRINTS + 1, dtype=np.uint64) * _ODD[0])


def _lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


def hashed_words(texts: pa.Array):
    """The word hashes of each text, in order."""
    for _, buf, offsets in text_chunks(texts, 1 << 20):
        buf = _lower(buf)
        starts, ends, at = split_words(buf, offsets)
        hashes = hash_words(buf, starts, ends)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield hashes[a:b]


def grams(words: np.ndarray) -> np.ndarray:
    """The distinct shingles, hashed; the whole sequence if it is shorter than one."""
    n = min(SHINGLE, len(words))
    if not n:
        return words
    count = len(words) - n + 1
    total = np.full(count, np.uint64(n))
    for i in range(n):
        total = mix64(total + words[i : i + count] * _ODD[i])
    return np.unique(total)


def fingerprints(shingles: np.ndarray) -> np.ndarray:
    """The fingerprints: bits set in over half of the shingles' hashes."""
    votes = np.zeros(64 * PRINTS, dtype=np.int64)
    for lo in range(0, len(shingles), BLOCK):
        hashes = mix64(shingles[lo : lo + BLOCK, None] ^ _PRINT_ODD)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):
            votes += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * votes > len(shingles), bitorder="little").view("<u8")


def _same(words: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(words.tobytes())


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of all words), the number of shingles and the fingerprints, 8 bytes each."""

    def run(batches):
        for batch in batches:
            node, n, found = [], [], []
            for words in hashed_words(batch.column(1)):
                shingles = grams(words)
                node.append(_same(words))
                n.append(len(shingles))
                found.append(fingerprints(shingles).tobytes())
            nodes = pa.array(np.array(node, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(n, type=pa.int64()), pa.array(found, type=pa.binary())], names=["doc_id", "node", "n", "prints"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "doc_id long, node long, n long, prints binary")


def _signatures(blobs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), dtype="<u8").reshape(-1, PRINTS)


def _totals(nodes: DataFrame, tasks: int, cells: int, count) -> np.ndarray:
    """For each fingerprint, ``cells`` sums over all nodes of what ``count(number, fingerprints)`` finds."""

    def batch_of(sums: dict[int, np.ndarray]):
        blobs = pa.array([x.tobytes() for x in sums.values()], type=pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int32()), blobs], names=["print", "sums"])

    def some(batches):
        sums = {s: np.zeros(cells, dtype=np.int64) for s in range(PRINTS)}
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                own = _signatures(batch.column(0).slice(lo, 8192))
                for s in sums:
                    sums[s] += count(s, np.ascontiguousarray(own[:, s]))
        yield batch_of(sums)

    def all_of(batches):
        sums = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(blob, dtype=np.int64)
        yield batch_of(sums)

    schema = "print int, sums binary"
    out = np.zeros((PRINTS, cells), dtype=np.int64)
    for r in nodes.select("prints").coalesce(tasks).mapInArrow(some, schema).repartition("print").mapInArrow(all_of, schema).collect():
        out[r.print] = np.frombuffer(r.sums, dtype=np.int64)
    return out


def _joint(s: int, fps: np.ndarray) -> np.ndarray:
    bits = pigeonhole._bits(fps).astype(np.float32)
    return np.rint(bits.T @ bits).astype(np.int64).ravel()


def _filed(grouped: list[list[list[int]]], bits: int):
    def count(s, fps):
        cells = [pigeonhole._cell(p, pigeonhole.values(fps, part), len(part), bits) for p, part in enumerate(grouped[s])]
        return np.concatenate([np.bincount(c, minlength=1 << bits) for c in cells])

    return count


def _deal(grouped: list[list[list[int]]], counts, bits: int, searched: range):
    """Entries and probes of the fingerprints ``searched``; the node and the next fingerprint travel along."""

    def run(batches):
        runs = [(s, pigeonhole._deal(grouped[s], SimpleNamespace(value=counts.value[s]), K, bits, s * PARTS, SHARE)) for s in searched]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                own, node = _signatures(batch.column(0).slice(lo, 4096)).view(np.int64), batch.column(1).slice(lo, 4096)
                for s, deal in runs:
                    fp, check = (pa.array(own[:, i % PRINTS].copy()) for i in (s, s + 1))
                    yield from deal([pa.RecordBatch.from_arrays([fp, node, check], names=list(pigeonhole.NAMES))])

    return run


def forest(probes: np.ndarray, entries: np.ndarray) -> list[tuple[int, int]]:
    """Links of candidates, as few as hold each group together; the rows of both are fingerprints, nodes and checks."""

    def close(q, d):
        far = np.bitwise_count(q[0][:, None] ^ d[0]) + np.bitwise_count(q[2][:, None] ^ d[2])
        return (far <= FAR) & (q[1][:, None] != d[1])

    crowded = probes.shape[1] * entries.shape[1] > SIDE * SIDE
    if not crowded and not close(probes, entries).any():
        return []
    nodes, place = np.unique(np.concatenate([probes[1], entries[1]]), return_inverse=True)
    label, out = np.arange(len(nodes)), []
    q_at, d_at = place[: probes.shape[1]], place[probes.shape[1] :]

    def link(one: int, others: np.ndarray) -> None:
        groups, first = np.unique(label[others], return_index=True)
        new = groups != label[one]
        if new.any():
            out.extend((int(nodes[one]), int(nodes[x])) for x in others[first[new]])
            label[np.isin(label, groups[new])] = label[one]

    if crowded:
        # many near copies of one text are one class after a few rows, and one class isn't compared any more
        seen = np.zeros(len(nodes), dtype=bool)
        for _ in range(HUBS):
            left = np.flatnonzero(~seen[d_at])
            if not len(left):
                break
            hub = int(left[0])
            linked = q_at[close(probes, entries[:, hub : hub + 1])[:, 0]]
            link(int(d_at[hub]), linked)
            seen[linked] = seen[d_at[hub]] = True
        order, other = np.argsort(label[q_at], kind="stable"), np.argsort(label[d_at], kind="stable")
        probes, q_at, entries, d_at = probes[:, order], q_at[order], entries[:, other], d_at[other]
    for lo in range(0, len(q_at), SIDE):
        for start in range(0, len(d_at), SIDE):
            own, cells = q_at[lo : lo + SIDE], d_at[start : start + SIDE]
            if (label[own] == label[cells[0]]).all() and (label[cells] == label[cells[0]]).all():
                continue
            near = close(probes[:, lo : lo + SIDE], entries[:, start : start + SIDE]) & (label[own][:, None] != label[cells])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                link(int(own[i]), cells[near[i]])
    return out


def _probe(batches):
    for batch in whole_keys(batches):
        deal, part, value, probes, *own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        # the entries of a value, then its probes, each by node
        order = np.lexsort((own[1], probes, value, part, deal))
        deal, part, value, probes = (x[order] for x in (deal, part, value, probes))
        rows = np.stack([x[order] for x in own]).view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], (deal[1:] != deal[:-1]) | (part[1:] != part[:-1]) | (value[1:] != value[:-1])]))
        stop = np.concatenate([first[1:], [len(deal)]])
        asking = np.add.reduceat(probes.astype(np.int64), first)
        out = []
        for a, b, n in zip(first.tolist(), stop.tolist(), asking.tolist(), strict=True):
            # both sides are in order, so their ends tell whether all are one node
            if n and b - a - n and not (rows[1, a] == rows[1, b - n - 1] == rows[1, b - n] == rows[1, b - 1]):
                out += forest(rows[:, b - n : b], rows[:, a : b - n])
        if out:
            links = np.array(out, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join all candidates among the nodes that have shingles."""
    nodes = nodes.where("n > 0").select("prints", "node")
    n = nodes.count()
    tasks = max(1, -(-n // COUNTED))
    joint = _totals(nodes, tasks, 64 * 64, _joint).reshape(PRINTS, 64, 64)
    grouped = [pigeonhole.group_bits(n, own, PARTS) for own in joint]
    bits = max(len(part) for parts in grouped for part in parts)
    filed = _totals(nodes, tasks, PARTS << bits, _filed(grouped, bits)).reshape(PRINTS, PARTS, -1)
    counts = nodes.sparkSession.sparkContext.broadcast(np.minimum(filed, 1 << 30).astype(np.int32))

    def found(rows: DataFrame, searched: range) -> DataFrame:
        dealt = rows.mapInArrow(_deal(grouped, counts, bits, searched), "deal long, part int, value long, probes boolean, fp long, node long, check long")
        links = dealt.repartition("deal").sortWithinPartitions("deal").mapInArrow(_probe, "a long, b long")
        return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    first = durable(found(nodes, range(FIRST)))
    roots = components(first, FEW_LINKS)
    placed = durable(nodes.join(roots, "node", "left").select("prints", F.coalesce("root", "node").alias("node")))
    return first.union(found(placed, range(FIRST, PRINTS)))


def _with_grams(rows: DataFrame) -> DataFrame:
    """node, grams of the rows (node, text) whose text has the node's words; another row may repeat the id."""

    def run(batches):
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            texts, at = batch.column(1), 0
            for words in hashed_words(texts):
                if np.uint64(_same(words)).view(np.int64) == nodes[at]:
                    found = pa.array([grams(words).view(np.int64)], type=pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[at]]), found], names=["node", "grams"])
                at += 1

    return rows.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ``SIMILAR`` or more, as few as hold together the groups that all such pairs make."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    _, gram = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # the sets that hold a shingle stand side by side
    order = np.argsort(gram, kind="stable")
    holders = owner[order]
    count = np.bincount(gram)
    first = np.cumsum(count) - count
    starts = np.cumsum(sizes) - sizes
    label, out = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        if (label[i + 1 :] == label[i]).all():
            continue
        own = gram[starts[i] : starts[i] + sizes[i]]
        own = own[count[own] > 1]
        n = count[own]
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((shared >= SIMILAR * (sizes[i] + sizes - shared) - 1e-9) & (label != label[i]))
        near = near[near > i]
        groups, one = np.unique(label[near], return_index=True)
        out += [(i, int(j)) for j in near[one]]
        label[np.isin(label, groups)] = label[i]
    return out


def _meet(batches):
    for batch in whole_keys(batches):
        deal, node = (batch.column(i).to_numpy() for i in (0, 1))
        grams_of = batch.column(2)
        cuts = np.concatenate([[0], np.flatnonzero(deal[1:] != deal[:-1]) + 1, [len(deal)]]).tolist()
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                out += [(node[a + i], node[a + j]) for i, j in alike([grams_of[k].values.to_numpy() for k in range(a, b)])]
        if out:
            links = np.array(out, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])


def _met(dealt: DataFrame) -> DataFrame:
    """Links among the sets (deal, node, grams) that share a deal."""
    return dealt.repartition("deal").sortWithinPartitions("deal", "node").mapInArrow(_meet, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """node, grams of the documents (node, _sl_id); rows that repeat id and text are one set."""
    return _with_grams(docs.select(F.col("doc_id").cast("long").alias("_sl_id"), "text").join(ids, "_sl_id")).dropDuplicates(["node"])


def _between(members: DataFrame, linked: DataFrame) -> DataFrame:
    """node, _sl_id, deal: the meetings of the classes that ``linked`` makes in the components (node, _sl_id, root, n)."""
    labels = components(linked.join(members.select(F.col("node").alias("a")), "a", "left_semi"), FEW_LINKS).withColumnRenamed("root", "label")
    members = durable(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    sizes = durable(members.groupBy("root", "label").agg(F.sum("n").alias("n")))
    large = sizes.where(F.col("n") > PIECE).select("root", "label", F.lit(False).alias("pool"), F.ceil(F.col("n") / PIECE).alias("pieces"))
    pool = sizes.where(F.col("n") <= PIECE).groupBy("root").agg(F.ceil(F.sum("n") / PIECE).alias("pool_pieces"))
    sides = durable(large.union(pool.select("root", F.col("root").alias("label"), F.lit(True), "pool_pieces")))
    # a class that is large keeps its name, the others share that of the component
    own = members.join(large.drop("pool"), ["root", "label"], "left").join(pool, "root", "left").withColumn("pool", F.col("pieces").isNull())
    at = F.when(F.col("pool"), F.pmod(F.xxhash64("label"), F.col("pool_pieces"))).otherwise(F.pmod(F.xxhash64("node"), F.col("pieces")))
    own = own.select("node", "_sl_id", "root", "pool", F.when(F.col("pool"), F.col("root")).otherwise(F.col("label")).alias("label"), at.alias("at"))
    other = sides.select("root", F.col("label").alias("_sl_label"), F.col("pool").alias("_sl_pool"), F.col("pieces").alias("_sl_pieces"))
    apart = (F.col("label") != F.col("_sl_label")) | (F.col("pool") != F.col("_sl_pool"))
    met = own.join(other, "root").where(apart | F.col("pool")).withColumn("_sl_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sl_pieces") - 1)))
    x, y = F.xxhash64("pool", "label", "at"), F.xxhash64("_sl_pool", "_sl_label", "_sl_at")
    return met.select("node", "_sl_id", F.xxhash64("root", F.least(x, y), F.greatest(x, y)).alias("deal"))


def verified(docs: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Links of a similarity of ``SIMILAR`` or more that join all such pairs within each component of ``links``."""
    roots = components(links, FEW_LINKS)
    placed = roots.union(roots.select("root", "root").distinct())
    placed = durable(nodes.join(placed, "node").select("node", F.col("least").alias("_sl_id"), "root", "n"))
    # most components are one piece, so few have to be told of their pieces
    pieces = placed.groupBy("root").agg(F.ceil(F.sum("n") / PIECE).cast("int").alias("pieces")).where("pieces > 1")
    degrees = links.groupBy("b").agg(F.count("*").alias("degree")).join(placed, F.col("b") == F.col("node")).select("root", "degree", "b")
    hubs = degrees.join(pieces, "root").groupBy("root", "pieces").agg(F.max(F.struct("degree", "b"))["b"].alias("hub"))
    large = durable(hubs.withColumnRenamed("root", "_sl_root"))
    placed = placed.join(large, F.col("root") == F.col("_sl_root"), "left").select("node", "_sl_id", "root", "n", "hub", F.coalesce("pieces", F.lit(1)).alias("pieces"))
    sets = _sets(docs, placed.select("node", "_sl_id")).join(placed.drop("_sl_id"), "node")
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)
    at = F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("pieces"))))).alias("at")
    dealt = sets.select("node", "grams", "root", at)
    found = _met(dealt.select(F.xxhash64("root", "at").alias("deal"), "node", "grams"))
    if large.isEmpty():
        return found
    found = durable(found)
    meetings = durable(_between(placed.where("pieces > 1").select("node", "_sl_id", "root", "n"), found))
    ids = durable(meetings.select("node", "_sl_id").distinct())
    few = ids.count() <= FEW_IDS
    return found.union(_met(_sets(docs, F.broadcast(ids) if few else ids).join(meetings.drop("_sl_id"), "node").select("deal", "node", "grams")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, component_id of every row with an id; a class is named by its smallest document."""
    found = durable(prints(docs).where("doc_id is not null"))
    nodes = durable(found.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("prints").alias("prints")))
    links = durable(candidates(nodes))
    roots = components(verified(docs, nodes, links), FEW_LINKS)
    placed = nodes.select("node", "least").join(roots, "node", "left").select(F.col("node").alias("_sl_node"), "least", F.coalesce("root", "node").alias("root"))
    placed = durable(placed)
    # made before it is joined, so that the adaptive join can split a class of very many documents
    named = durable(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    named = placed.join(named, "root").select("_sl_node", "component_id")
    # many rows may share a node; the adaptive join splits such a key
    return found.join(named, F.col("node") == F.col("_sl_node")).select("doc_id", "node", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The smallest document of each class, with its own columns; documents without an id stay."""
    first = classes(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_sl_id")).distinct()
    rows = docs.select(F.struct("*").alias("_sl_row"), F.col("doc_id").cast("long").alias("_sl_key"), F.col("text").alias("_sl_text"))
    kept = rows.join(first, F.col("_sl_key") == F.col("_sl_id"), "left_semi").dropDuplicates(["_sl_key", "_sl_text"])
    return kept.unionByName(rows.where("_sl_key is null")).select("_sl_row.*")
