"""A mix takes what going through each source in hash order takes, so it stops short by less than any document left out."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from sluice.llm import mixing


def brute(rows):
    """taken of each (doc_id, source, size): documents in hash order, each that fits (rows that repeat one together)."""
    sources = defaultdict(Counter)
    for doc_id, source, size in rows:
        sources[source][doc_id, size] += 1
    sizes = {s: sum(z * n for (_, z), n in c.items()) for s, c in sources.items()}
    goal = mixing.targets(sizes, mixing.cycled_weights(list(sizes)), 1.5 * sum(sizes.values()), 2.0)
    out = {}
    for s, docs in sources.items():
        whole = int(goal[s] // sizes[s])
        left = goal[s] - whole * sizes[s] + 1e-6
        for (d, z), n in sorted(docs.items(), key=lambda x: (hashlib.md5(str(x[0][0]).encode()).hexdigest()[:15], x[0])):
            fits = z * n <= left
            left -= z * n * fits
            out[d, s, z] = (whole + fits) * z
    return out, goal


def check(spark, rows):
    docs = spark.createDataFrame([(d, "w " * z, s) for d, s, z in rows], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken, goal = brute(rows)
    assert all(r.taken == taken[r.doc_id, r.source, r["size"]] for r in got)
    for s, words in goal.items():
        own = [r for r in got if r.source == s]
        least = min(r.taken // r["size"] for r in own)
        missing = words - sum(r.taken for r in own)
        # an id that several rows share is taken whole or not at all
        repeats = Counter(r.doc_id for r in own)
        more = [r["size"] * repeats[r.doc_id] for r in own if r.taken == least * r["size"]]
        assert -1e-3 <= missing < min(more)


def test_one_very_long_document(spark):
    upper = {i: hashlib.md5(str(i).encode()).hexdigest()[0] >= "8" for i in range(300)}
    long = next(i for i in range(300) if not upper[i])
    check(spark, [(i, "s", 5000 if i == long else 5) for i in range(300)])


@pytest.mark.parametrize("level", [1, 12])
def test_sizes_of_all_orders(spark, monkeypatch, level):
    """Several thresholds a source, found by one bit or by twelve at a time; some ids repeat."""
    monkeypatch.setattr(mixing, "LEVEL_BITS", level)
    monkeypatch.setattr(mixing, "LAST_BUCKET", 8)
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaab"), int(2 ** rng.uniform(0, 9))) for i in range(1200)]
    rows += [r for r in rows if r[0] % 7 == 0] + [(2000 + i, "c", 400 if i % 3 else 1 + i % 5) for i in range(100)]
    check(spark, rows)


def test_nothing_broadcast(spark, monkeypatch):
    """Sources and takes above the sizes that are broadcast."""
    monkeypatch.setattr(mixing, "FEW_SOURCES", 1)
    monkeypatch.setattr(mixing, "FEW_TAKEN", 1)
    monkeypatch.setattr(mixing, "LAST_BUCKET", 16)
    rng = random.Random(6)
    check(spark, [(i, rng.choice("abc"), int(2 ** rng.uniform(0, 8))) for i in range(500)])
