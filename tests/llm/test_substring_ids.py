"""Rows that share an id but not a text."""

import numpy as np
import pyarrow as pa
from sluice.llm import substring_dedup


def test_one_id_two_texts(spark):
    shared = " ".join(f"shared{i}" for i in range(60))
    own = " ".join(f"own{i}" for i in range(80))
    given = [(1, shared), (2, "a b " + shared + " c"), (2, own), (2, own), (3, own + " d")]
    frame = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    found = {r.text for r in substring_dedup.deduplicated(frame).collect()}
    assert found == {shared, "a b c", own, "d"}
    removed = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digests(frame).collect())
    assert removed == [(1, 60, 0), (2, 63, 60), (2, 80, 0), (2, 80, 0), (3, 81, 80)]


def test_a_repetitive_document_asks_once_a_window():
    """20,000 words that repeat twelve lines: as many rows as distinct windows, whatever their number."""
    lines = [" ".join(f"line{i} word{j}" for j in range(5)) for i in range(12)]
    text = "\n".join(lines[i % 12] for i in range(2000))
    full = np.full((2, 2, 1 << 17), 255, dtype=np.uint8)
    maps = type("Maps", (), {"value": full})
    given = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([0])], names=["doc_id", "text", "hash"])
    asked = [r for b in substring_dedup._ask(maps, 50, 20)([given]) for r in b.to_pylist()]
    assert len(asked) == 120 and sum(len(r["places"]) // 4 for r in asked) == 20_000 - 49


def test_windows_of_hot_and_repetitive_documents(spark, monkeypatch):
    """Every path: sketch full, anchors that come often, rows of many places, against a plain search."""
    monkeypatch.setattr(substring_dedup, "ROW", 64)
    monkeypatch.setattr(substring_dedup, "OFTEN", 3)
    shared = [f"shared{i}" for i in range(70)]
    docs = [(i, [f"d{i}w{j}" for j in range(i % 7)] + shared[i % 5 :]) for i in range(40)] + [(50, ["a", "b"] * 300), (51, ["b", "a"] * 90), (52, ["x"] * 500)]
    first, expected = {}, []
    for d, words in docs:
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), d)
    for d, words in docs:
        gone = {i + k for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < d for k in range(50)}
        expected.append((d, len(words), len(gone)))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(4)
    for bits in (20, 3):
        monkeypatch.setattr(substring_dedup, "sketch_bits", lambda _, bits=bits: bits)
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digests(frame).collect())
        assert got == expected
