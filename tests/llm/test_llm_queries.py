"""The ten queries over the smallest tables, against SQL or a brute-force version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SF, same_rows
from sluice.llm import mixing, registry
from sluice.llm.common import table
from sluice.llm.tokens import default_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    same_rows(registry.QUERIES[name](spark, SF), registry.ORACLES[name])


def test_packing(spark, texts, tokenizer):
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in registry.QUERIES["op3_nnls_packing"](spark, SF).collect():
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r["offset"], r.length))
    assert pieces.keys() == ids.keys()
    for d, parts in pieces.items():
        assert gapless(parts) == len(ids[d])
    padding = 0
    for parts in sequences.values():
        n = gapless(parts)
        assert n <= 1024
        padding += 0 if n & (n - 1) == 0 else 1024 - n
    assert padding == 0


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at and length > 0
        at += length
    return at


def test_token_files(spark, texts, tokenizer):
    at, expected = 0, set()
    for d in sorted(texts):
        ids = [*tokenizer.encode(texts[d] or "", add_special_tokens=False).ids, 0]
        expected.add((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert {tuple(r) for r in registry.QUERIES["op10_token_files"](spark, SF).collect()} == expected


def test_token_counts(spark, texts):
    import json

    vocabulary = json.load(open(default_vocabulary()))["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelt = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}

    def greedy(word):
        text, n = "".join(spelt[b] for b in b" " + word), 0
        while text:
            size = next(k for k in range(len(text), 0, -1) if text[:k] in vocabulary)
            text, n = text[size:], n + 1
        return n

    for r in registry.QUERIES["op8_token_counts"](spark, SF).collect():
        words = (texts[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(map(greedy, words)))


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(fps)
    for i, a in enumerate(names):
        for b in names[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def test_simhash(spark, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    least = brute_components(fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op9_simhash"](spark, SF).collect()}
    assert found == {d: (f"{fps[d]:016x}", least[d]) for d in fps}


def test_pipeline(spark, tokenizer):
    """Each stage against a plain version of it on the same input."""
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given = [r.asDict() for r in docs.collect()]
        path = corpus_pipeline.scratch_path(spark, f"test{k}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        got = [r.asDict() for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns
        [check_quality, check_near, check_passages, check_mix, check_packed][k](given, got, tokenizer)


def by_id(found):
    return {r["doc_id"]: r for r in found}


def check_quality(given, got, _):
    kept = by_id(got)
    for r in given:
        words = (r["text"] or "").encode().split()
        runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + d for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for d in range(3)}
        text = r["text"] or ""
        symbols, letters = sum(text.count(c) for c in "#*$%&|<>"), len(b"".join(words).decode())
        lines = [x for x in text.encode().split(b"\n") if x.split()]
        fails = len(words) < 50 or 2 * len(covered) > len(words) or 10 * symbols > len(words) or not 3 * len(words) <= letters <= 12 * len(words)
        fails = fails or (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines))
        assert (r["doc_id"] in kept) == (not fails)
    assert all(r in given for r in got)


def brute_similar(given):
    """The least document reachable over pairs whose sets of five-word shingles are alike to 0.8."""
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in given}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if 10 * shared >= 8 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return words, {d: find(d) for d in names}


def check_near(given, got, _):
    words, least = brute_similar(given)
    kept = by_id(got)
    assert all(r in given for r in got) and len(got) == len(kept)
    assert all(d in kept for d in least if least[d] == d)
    first = {}
    for d in sorted(words):
        first.setdefault(tuple(words[d]), d)
    assert not any(d in kept for d in words if first[tuple(words[d])] != d)
    gone = [d for d in least if least[d] != d]
    assert sum(d in kept for d in gone) <= 0.1 * len(gone)


def test_near_copies(spark):
    """A large group of near copies, pairs with one edit in forty words, and texts half alike, which stay."""
    import random

    from sluice.llm import near

    rng = random.Random(5)

    def text(n):
        return [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]

    def edited(words, every):
        return [f"e{rng.randrange(10**6)}" if i % every == every // 2 else w for i, w in enumerate(words)]

    hot, docs = text(200), []
    docs += [edited(hot, 67) for _ in range(300)]
    for _ in range(60):
        base = text(rng.randrange(120, 400))
        docs += [base, edited(base, 60), base[: len(base) // 2] + text(len(base) // 2)]
    given = [{"doc_id": i, "text": " ".join(w)} for i, w in enumerate(docs)]
    got = near.deduplicated(spark.createDataFrame([(r["doc_id"], r["text"]) for r in given], "doc_id long, text string")).collect()
    kept = {r.doc_id for r in got}
    _, least = brute_similar(given)
    gone = {d for d in least if least[d] != d}
    assert len(gone) > 300 and kept >= set(least) - gone
    assert len(kept & gone) <= 0.05 * len(gone)


def check_passages(given, got, _):
    first = {}
    for r in sorted(given, key=lambda r: r["doc_id"]):
        words = (r["text"] or "").encode().split()
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), r["doc_id"])
    found = by_id(got)
    for r in given:
        words = (r["text"] or "").encode().split()
        gone = {i + d for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < r["doc_id"] for d in range(50)}
        kept = [w for i, w in enumerate(words) if i not in gone]
        if gone and not kept:
            assert r["doc_id"] not in found
        elif gone:
            new = b" ".join(kept).decode()
            assert found[r["doc_id"]] == r | {"text": new, "n_chars": len(new)}
        else:
            assert found[r["doc_id"]] == r
    assert len(found) == len(got)


def check_mix(given, got, _):
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in given}
    taken = Counter(r["doc_id"] for r in got)
    assert max(taken.values()) <= 2 and all(r in given for r in got)
    sources = defaultdict(list)
    for r in given:
        sources[r["source"]].append(r["doc_id"])
    sizes = {s: sum(size[d] for d in ds) for s, ds in sources.items()}
    goal = mixing.targets(sizes, mixing.cycled_weights(list(sizes)), 1.5 * sum(sizes.values()), 2.0)
    for s, ds in sources.items():
        # what is missing is less than any document that could still have been taken once more
        missing = goal[s] - sum(size[d] * taken[d] for d in ds)
        least = min(taken[d] for d in ds)
        more = [size[d] for d in ds if taken[d] == least and size[d]]
        assert -1e-6 <= missing and (missing < min(more) or missing < 1)


def check_packed(given, got, tokenizer):
    pieces = Counter()
    for r in got:
        pieces[r["doc_id"]] += r["length"]
    expected = Counter()
    for r in given:
        expected[r["doc_id"]] += len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert pieces == expected


def test_sha_of_nothing(spark):
    empty = hashlib.sha256(b"").hexdigest()
    schema = "doc_id long, text string"
    from sluice.llm import substring_dedup

    got = substring_dedup.digests(spark.createDataFrame([(1, None), (2, " \n")], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, empty), (2, 0, 0, empty)]
