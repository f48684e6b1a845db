"""Near-duplicates around a similarity of 0.8: blocks appended, cut off and replaced."""

import random

import numpy as np
import pyarrow as pa
import pytest
from sluice.llm import near


def shingles(words):
    return near.grams(next(near.hashed_words(pa.array([" ".join(words)]))))


def similar(a, b):
    shared = len(np.intersect1d(shingles(a), shingles(b)))
    return shared / (len(shingles(a)) + len(shingles(b)) - shared)


def appended(words, block):
    return words + block


def truncated(words, block):
    return words[: len(words) - len(block)]


def replaced(words, block):
    at = len(words) // 3
    n = len(block) // 2
    return words[:at] + block[:n] + words[at + n :]


@pytest.mark.parametrize("edit", [appended, truncated, replaced])
def test_block_edits_are_found(spark, edit):
    rng = random.Random(8)
    docs, pairs = [], []
    while len(pairs) < 300:
        n = rng.randrange(120, 600)
        words = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]
        other = edit(words, [f"n{rng.randrange(10**6)}" for _ in range(int(n * rng.uniform(0.15, 0.25)))])
        if 0.8 <= similar(words, other) < 0.86:
            pairs.append(2 * len(pairs) + 1)
            docs += [words, other]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    kept = {r.doc_id for r in near.deduplicated(frame).select("doc_id").collect()}
    assert kept >= set(range(0, len(docs), 2))
    assert sum(d in kept for d in pairs) <= 3


def revisions(n):
    """Independent revisions of one text, whose pairs lie around 0.8."""
    rng = random.Random(n)
    base = [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(400)]
    docs = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4, 9)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        docs.append(words)
    return docs


def least_alike(docs):
    root = list(range(len(docs)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    sets = [set(shingles(d).tolist()) for d in docs]
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 10 * shared >= 8 * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in range(len(docs)) if find(i) == i}


@pytest.mark.parametrize("piece", [1 << 18, 3000])
def test_failed_links_lose_none(spark, monkeypatch, piece):
    monkeypatch.setattr(near, "PIECE", piece, raising=False)
    docs = revisions(150)
    least = least_alike(docs)
    assert 1 < len(least) < 75
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    kept = {r.doc_id for r in near.deduplicated(frame).select("doc_id").collect()}
    assert kept == least


def two_classes(bridged):
    """Near copies of two texts that are 0.7 alike, single documents that are like one copy only, and a bridge."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    new = [f"v{rng.randrange(10**6)}" for _ in range(70)]
    docs = []
    for k in range(60):
        a, b = list(base), base[:330] + new
        a[k * 5], b[k * 5] = f"n{k}", f"m{k}"
        docs += [a, b]
    docs += [docs[k] + [f"x{k}.{i}" for i in range(95)] for k in range(0, 20, 3)]
    return docs + ([base[:365] + new[35:]] if bridged else [])


@pytest.mark.parametrize("bridged", [False, True])
@pytest.mark.parametrize("few", [0, 1 << 18])
def test_classes_of_many_pieces(spark, monkeypatch, bridged, few):
    monkeypatch.setattr(near, "PIECE", 3000)
    monkeypatch.setattr(near, "FEW_IDS", few)
    docs = two_classes(bridged)
    least = least_alike(docs)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    kept = {r.doc_id for r in near.deduplicated(frame).select("doc_id").collect()}
    assert kept == least and (0 in kept) and (1 in kept) != bridged


def test_pieces_of_a_class_do_not_meet(spark, monkeypatch):
    """One class of 60 pieces of a document and a pool of three documents: each of the class meets the pool, no others."""
    monkeypatch.setattr(near, "PIECE", 100)
    members = spark.createDataFrame([(i, i, 0, 100 if i < 60 else 30) for i in range(63)], "node long, _sl_id long, root long, n long")
    linked = spark.createDataFrame([(i, 0) for i in range(1, 60)], "a long, b long")
    met = [(r.node, r.deal) for r in near._between(members, linked).collect()]
    deals = {}
    for node, deal in met:
        deals.setdefault(deal, set()).add(node)
    assert len(met) <= 60 + 3 * 61
    assert all(any({i, j} <= d for d in deals.values()) for i in range(63) for j in range(60, 63) if i != j)
    alone = near._between(members.where("node < 60"), linked)
    assert alone.count() == 0


def test_fingerprints():
    """Each bit is a vote of the shingles' hashes, in long documents too."""
    for n in (1, 4, 255, 256, 3000):
        own = shingles([f"w{i}" for i in range(n + 4)])
        assert len(own) == n
        got = near.fingerprints(own)
        for s in range(near.PRINTS):
            hashes = near.mix64(own ^ near._PRINT_ODD[s]).tolist()
            assert int(got[s]) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def test_search_by_fingerprints(spark):
    """Documents near in any one fingerprint, and in the next one, are candidates; those far in the next one aren't."""
    rng = random.Random(3)
    rows, want, far = [], set(), set()
    for i in range(160):
        own = [rng.getrandbits(64) for _ in range(near.PRINTS)]
        other = [rng.getrandbits(64) for _ in range(near.PRINTS)]
        s, apart = i % near.PRINTS, i >= 128
        other[s] = flipped(rng, own[s], near.K)
        after = (s + 1) % near.PRINTS
        other[after] = flipped(rng, own[after], 40 if apart else near.FAR - near.K)
        (far if apart else want).add((2 * i + 1, 2 * i))
        rows += [(2 * i + j, 9, np.array(x, dtype="<u8").tobytes()) for j, x in enumerate((own, other))]
    got = {(r.a, r.b) for r in near.candidates(spark.createDataFrame(rows, "node long, n long, prints binary")).collect()}
    assert got >= want and not got & far


def test_crowded_values():
    """Rows of a value in several blocks: a large class, a small one and single rows."""
    rng = random.Random(6)
    texts = [[rng.getrandbits(64) for _ in range(2)] for _ in range(40)]
    group = [0] * 1500 + [1] * 900 + list(range(2, 40))
    rng.shuffle(group)
    rows = np.array([[flipped(rng, texts[g][0], 2), k, flipped(rng, texts[g][1], 5)] for k, g in enumerate(group)], dtype=np.uint64).T
    links = near.forest(rows, rows)
    assert all(group[a] == group[b] for a, b in links)
    root = list(range(len(group)))
    for a, b in links:
        old, new = root[a], root[b]
        assert old != new
        root = [new if x == old else x for x in root]
    assert len(set(root)) == 40


def test_stage_searches_fingerprints(spark, monkeypatch):
    """The pipeline's stage groups the bits of each fingerprint and probes them."""
    import corpus_pipeline

    asked, group_bits = [], near.pigeonhole.group_bits
    monkeypatch.setattr(near.pigeonhole, "group_bits", lambda *given: asked.append(given[2]) or group_bits(*given))
    base = [f"w{i}" for i in range(300)]
    docs = [base, base[:290], [f"v{i}" for i in range(300)]]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == {0, 2}
    assert asked == [near.PARTS] * near.PRINTS


def test_near_copies_are_not_linked_by_every_group(spark):
    """A group of near copies brings links in proportion to the groups of the first fingerprints, not of all."""
    docs = revisions(150)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    links = near.candidates(near.durable(near.prints(frame))).collect()
    linked = {x for r in links for x in (r.a, r.b)}
    assert len(linked) > 140
    assert len(links) <= 16 * len(docs)


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_links_joined_by_one_task_or_in_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(near, "FEW_LINKS", few)
    rng = random.Random(few)
    # chains, so that a least id has far to go, and single links
    links = [(i, i + 1) for i in range(0, 60)] + [(2 * i + 101, 2 * i + 100) for i in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    frame = spark.createDataFrame(links, "a long, b long")
    got = sorted(tuple(r) for r in near.components(frame, near.FEW_LINKS).select("node", "root").collect())
    assert got == sorted((x, r) for x, r in root.items() if x != r)
    assert near.components(frame.where("a < 0"), near.FEW_LINKS).count() == 0
