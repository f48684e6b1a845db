"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F
from sluice.llm import chat_tree, common, components, knn, lm_scoring, mixing, near, packing, pigeonhole, quality, simhash, substring_dedup, token_counts, token_files
from sluice.llm.common import table, whole_keys
from sluice.llm.tokens import default_vocabulary, encoder

SCHEMA = "doc_id long, text string, source string, size long, n_words long, value long, _row string"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
SHARED = " ".join(f"shared{i}" for i in range(60))
CASES = [
    (1, "alpha " + SHARED + " omega", "a"),
    (2, None, None),
    (3, "", "b"),
    (4, " \t\n\x0b\f\r ", "b"),
    (5, SHARED, "a"),
    (5, SHARED, "a"),
    (6, LONG, "a"),
    (7, "beta " + LONG + " gamma", None),
    (None, SHARED, "b"),
    (8, "naïve  日本語 x y \x1c\x1dz 😀", "c"),
    (9, "x" * 40_000, "c"),
    (10, "one", "a"),
    (11, "ONE", "a"),
]
FUNCTIONS = {
    "quality": lambda d: quality.apply_policy(quality.ledger(d), "web-2"),
    "keep": quality.keep,
    "packing": packing.pack,
    "files": token_files.token_files,
    "mixing": mixing.mix,
    "mixed": mixing.mixed,
    "substring": substring_dedup.digests,
    "passages": substring_dedup.deduplicated,
    "simhash": simhash.classes,
    "near": near.deduplicated,
    "counts": token_counts.count_tokens,
    "lm": lambda d: lm_scoring.score(d, d.select("doc_id")),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, s, 7, 8, 9, "r") for d, t, s in CASES], SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_odd_rows(docs, name):
    got = FUNCTIONS[name](docs).collect()
    if name not in ("keep", "packing", "mixed", "passages", "near"):
        assert sorted(str(r.doc_id) for r in got) == sorted(str(c[0]) for c in CASES)
    if name in ("keep", "mixed", "passages", "near"):
        assert set(got[0].asDict()) == set(docs.columns)


@pytest.mark.parametrize("name", ["keep", "mixed", "passages", "near"])
def test_odd_names(spark, name):
    """Columns with dots, spaces and the names that operators use stay as they are."""
    names = ["meta.lang", "_sl_key", "_sl_row", "_sl_id", "a b", "Root", "node", "n_chars"]
    given = [(i, f"{t} {SHARED} {i} {LONG[:900]}", "s", *(f"{c}{i}" for c in names[:-1]), 5) for i, t in enumerate("abc")]
    frame = spark.createDataFrame(given, ["doc_id", "text", "source", *names])
    out = FUNCTIONS[name](frame)
    assert out.columns == frame.columns
    for r in out.collect():
        assert [r[c] for c in names[:-1]] == list(given[r["doc_id"]][3:-1])


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_empty_table(spark, name):
    assert FUNCTIONS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_substring_values(docs):
    removed = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.digests(docs).collect()}
    assert removed[5, 60] == 60 and removed[1, 62] == 0 and removed[None, 60] == 0
    assert removed[7, 60_002] == 60_000 and removed[6, 60_000] == 0


def test_near_values(docs):
    # alike: 1 and 5; 2, 3 and 4, which have no words; 6 and 7; 10 and 11
    kept = [r.doc_id for r in near.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 6, 8, 9, 10, None], key=str)


def test_mix_values(docs):
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 2 * r["size"]
    assert rows(mixing.mix(docs)) == rows(mixing.mix(docs))


def test_targets():
    sizes = {"a": 100, "b": 10, None: 50}
    weights = mixing.cycled_weights([None, "b", "a"])
    assert weights == {"a": 3, "b": 1, None: 2}
    got = mixing.targets(sizes, weights, 240.0, 2.0)
    assert got["b"] == 20 and sum(got.values()) == pytest.approx(240) and all(got[s] <= 2 * sizes[s] for s in sizes)
    assert mixing.targets({"a": 0}, {"a": 3}, 0.0, 2.0) == {"a": 0}


def test_repeats_of_one_hash(spark, monkeypatch):
    """Different windows with one hash, between each other in the text, hide no repeat."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.length(c[0]).cast("long"))
    dice = random.Random(4)
    texts = [" ".join(dice.choice(["a", "b", "cc", "dd", "eee"]) for _ in range(n)) for n in (0, 2, 3, 9, 40, 300) for _ in range(5)] + [None]
    got = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        found = (texts[r.doc_id] or "").split()
        windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
        count = Counter(windows)
        assert r.n_repeat_words == len({i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)})


def test_quality_ablations(docs):
    ledger = quality.ledger(docs)
    got = {(r.policy, r["without"]): r.kept for r in quality.ablations(ledger).collect()}
    for policy, rules in quality.POLICIES.items():
        for rule in (None, *rules):
            expected = sum(all(not r.failed & quality.BITS[x] for x in rules if x != rule) for r in ledger.collect())
            assert got[policy, rule] == expected


def test_encoder_equals_library():
    enc = encoder(default_vocabulary())
    rng = random.Random(3)
    letters = [*"ab'st.,  \n\n\t\r\x0b\x1c\x85  é1<|", "'re", "<|endoftext|>", "  ", " \n", "日本", "😀", "́", "Straße", "ǅ", "ɐ"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 300, 60_000, 2**32 - 1])
def test_token_file_round_trip(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 5000, endpoint=True).astype(np.uint32)
    ids[::50] = top
    docs = [(3, 1000), (None, 0), (-7, 3999), (9, 1)]
    data = token_files.encode_file(docs, ids)
    assert token_files.decode_file(data)[0] == docs and (token_files.decode_file(data)[1] == ids).all()
    for lo, hi in ((0, 1), (1000, 1030), (1023, 1025), (4990, 5000), (7, 7)):
        assert (token_files.read_ids(data, lo, hi) == ids[lo:hi]).all()
    assert (token_files.decode_file(token_files.encode_file([], np.zeros(0, np.uint32)))[1]).size == 0


def test_token_file_order(docs, tmp_path):
    """Many files a partition, by a path without a scheme: starts go on from file to file."""
    manifest = token_files.write_token_files(docs, f"{tmp_path}/tokens", file_ids=1000)
    files = sorted(manifest.collect(), key=lambda r: r.start)
    assert len(files) > 3 and all(r.file.startswith("file:///") for r in files)
    assert [r.start for r in files] == [0, *np.cumsum([r["ids"] for r in files])[:-1].tolist()]
    found = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d)) and len(ids) == len(CASES)


def test_shared_folder(spark):
    """Plain sessions: a local one gets a folder, a cluster must name it."""

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        def __init__(self, master):
            self.master, self.dir = master, None

        def getCheckpointDir(self):
            return self.dir

        def setCheckpointDir(self, path):
            self.dir = path + "/uuid"

    class Session:
        conf = Conf()

    for master in ("local", "local[*]", "local[8]"):
        Session.sparkContext = Context(master)
        made = common.shared_dir(Session)
        assert made.startswith("file:///") and common.shared_dir(Session) == made
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        Session.sparkContext = Context(master)
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(Session)


def test_exceptions_make_blocks_small():
    ids = np.full(4096, 5, dtype=np.uint32)
    ids[::100] = 40_000
    assert len(token_files.encode_file([(1, 4096)], ids)) < 1000


def test_sequences_hold_their_ids(docs):
    pieces = packing.pack(docs, window=64, group=5, with_ids=True).cache()
    made = {r.sequence_id: r.ids for r in packing.sequences(pieces).collect()}
    for r in pieces.collect():
        assert made[r.sequence_id][4 * r["offset"] : 4 * (r["offset"] + r.length)] == r.ids
    assert all(len(v) <= 256 for v in made.values())


def test_place_fills_windows():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 1024, 4000)
    tail, start, length, sequence, offset, n = packing.place(lengths, 1024)
    assert (np.bincount(tail, weights=length) == lengths).all()
    filled = np.bincount(sequence, weights=length, minlength=n).astype(int)
    assert sum(v & (v - 1) != 0 for v in filled.tolist()) == 0
    # most tails are left whole, though each length has only some four
    assert len(tail) < 1.2 * len(lengths)


@pytest.mark.parametrize("kind", ["uniform", "geometric"])
def test_windows_follow_the_fit(kind):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1024, 8000) if kind == "uniform" else np.minimum(rng.geometric(1 / 300, 8000), 1023)
    h = np.bincount(lengths, minlength=1025)
    cols, x = packing.fit_counts(h, 1024)
    counts = packing.round_counts(cols, x, h)
    assert (x >= 0).all() and (counts <= np.floor(x + 1e-9) + 1).all() and not counts[x == 0].any()
    used = np.bincount(cols.ravel(), weights=np.repeat(counts, 3) * (cols.ravel() > 0), minlength=1025)
    assert (used <= h).all() and counts.sum() > 0.5 * x.sum()
    tail, start, length, sequence, offset, n = packing.place(lengths, 1024)
    made = {}
    for t, o, s in sorted(zip(tail.tolist(), offset.tolist(), sequence.tolist(), strict=True), key=lambda r: (r[2], r[1])):
        made.setdefault(s, []).append(int(lengths[t]))
    # the first sequences are the combinations, as often as their rounded count says
    first = Counter(tuple(made[s]) for s in range(int(counts.sum())))
    assert first == Counter({tuple(v for v in c if v): k for c, k in zip(cols.tolist(), counts.tolist(), strict=True) if k})


def test_hot_lengths():
    *_, length, sequence, offset, n = packing.place(np.full(900, 700), 1024)
    assert length.sum() == 900 * 700 and n <= 900 * 700 // 1024 + 10


def test_automaton_against_library():
    from tokenizers.models import WordPiece

    rng = random.Random(5)
    pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)}
    first, later = {p for p in pieces if rng.random() < 0.6}, {p for p in pieces if rng.random() < 0.6}
    names = ["[UNK]", *sorted(first), *(f"##{p}" for p in sorted(later))]
    model = WordPiece({p: i for i, p in enumerate(names)}, unk_token="[UNK]", max_input_chars_per_word=100)
    count = token_counts.Automaton([p.encode() for p in first], [p.encode() for p in later])
    for _ in range(3000):
        word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(1, 14)))
        assert count[word.encode()] == len(model.tokenize(word)), word


@pytest.mark.parametrize("cells, share", [(16, 2048), (4, 2048), (16, 8)])
def test_pigeonhole_finds_all(spark, monkeypatch, cells, share):
    monkeypatch.setattr(pigeonhole, "cell_bits", lambda n, parts: cells + 6 if share < 9 else cells)
    monkeypatch.setattr(pigeonhole._deal, "__defaults__", (0, share))
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    near = [base]
    for _ in range(3):
        flips = np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64) for _ in range(2)])
        near.append(near[-1] ^ flips)
    ball = np.uint64(0x0123456789ABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    fps = np.unique(np.concatenate([*near, ball]))
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= 2).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = pigeonhole.links(frame)
    found = {r.node: r.root for r in components.components(links).collect()}
    groups = {}
    for i, f in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(find(i), set()).add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)
    assert links.count() < 6 * len(fps)


def test_thresholds_sum_and_cost_least():
    rng = np.random.default_rng(2)
    costs = rng.random((3, 4, 50)) * [[[0], [1], [5], [30]]]
    got = pigeonhole.allocate(costs, 0)
    assert (got.sum(axis=0) == 0).all()
    options = [(a, b, -a - b) for a in range(-1, 3) for b in range(-1, 3) if -1 <= -a - b <= 2]
    for i in range(50):
        least = min(sum(costs[p, t + 1, i] for p, t in enumerate(o)) for o in options)
        assert sum(costs[p, got[p, i] + 1, i] for p in range(3)) == pytest.approx(least)


def test_components_of_a_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in components.components(links.union(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def test_knn_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.5]), (50, [-1.0, 2.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.25]), (None, [1.0, 1.0]), (9, [0.001, -0.001])]
    frame = spark.createDataFrame([(a, b, "x") for a, b in data], "vec_id long, embedding array<float>, score string")
    good = sorted({(i, tuple(np.floor(256.0 * np.array(v + [0.0] * (2 - len(v)))).astype(int))) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()})
    expected = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(np.dot(x, y)), i) for i, y in good if i != q)[:5]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(knn.top_k(frame)) == sorted(expected, key=repr)
    assert knn.top_k(frame.limit(0)).count() == 0
    assert knn.top_k(frame.where("vec_id % 50 <> 0")).count() == 0


@pytest.mark.parametrize("share, chunk", [(16, 16_384), (16, 3), (10_000, 1)])
def test_knn_splits_hot_cells(spark, monkeypatch, share, chunk):
    monkeypatch.setattr(knn, "SHARE", share)
    monkeypatch.setattr(knn, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((150, 4), 0.5), rng.normal(size=(250, 4))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    e = np.floor(256 * x).astype(int)
    expected = []
    for q in range(0, 400, 50):
        best = sorted((-int(e[q] @ e[i]), i) for i in range(400) if i != q)[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(knn.top_k(frame, pivots=8)) == sorted(expected, key=repr)


def test_knn_repeated_rows_leave_room(spark):
    """A vector that a hundred rows of one id repeat doesn't hide the next ones; scattered groups need few cells."""
    rng = np.random.default_rng(6)
    far = [(i, (rng.normal(size=3) * 0.1 + 20.0 * np.eye(3)[i % 3]).tolist()) for i in range(90)]
    data = [(7, [30.0, 30.0, 30.0])] * 100 + [(i, v) for i, v in far if i != 7]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    good = {(i, tuple(np.floor(256 * np.array(v)).astype(int).tolist())) for i, v in data}
    expected = []
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(np.dot(x, y)), i) for i, y in good if i != q)[:5]
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows(knn.top_k(frame, pivots=6)) == sorted(expected, key=repr)


TALKS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello <|im_end|>\n"), (1, 2, "user", "bye"), (1, 3, "assistant", ""),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello <|im_end|>\n"), (2, 2, "user", "\\<|\\n"),
    (3, 0, "user", "hi"), (3, 1, "assistant", "other\\"),
    (4, None, None, None), (5, 0, "a\nb<|", "x"), (None, 0, "assistant", "no id"),
    (6, 0, "user", "hi"), (6, 0, "user", "hi"),
]


@pytest.mark.parametrize("most", [chat_tree.MAX_IDS, 20])
def test_chat_round_trip(spark, most):
    frame = spark.createDataFrame([(*t, "x") for t in TALKS], "conv_id long, turn long, role string, text string, keys string")
    made = chat_tree.format_trees(frame, max_ids=most)
    expected = {}
    for c, turn, role, text in sorted(TALKS, key=lambda t: (t[0] or 0, t[1] or 0)):
        expected.setdefault(c, []).append((role or "", text or ""))
    back = {r.conv_id: r for r in chat_tree.read_back(made).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == expected
    for c, r in back.items():
        assert r.loss_text == "".join(t for role, t in expected[c] if role == "assistant")
    assert chat_tree.format_trees(frame.limit(0)).count() == 0


def test_chat_tree_shares_turns(spark):
    frame = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").coalesce(1)
    (tree,) = [s for s in chat_tree.format_trees(frame).collect() if {1, 2, 3, 6} & {t.conv_id for t in s.conversations}]
    assert sorted(t.conv_id for t in tree.conversations) == [1, 2, 3, 6]
    # hi, hello, bye, empty; \<|\n; other; hi again
    assert len(tree.nodes) == 7 and tree.nodes[-1].stop == len(tree.ids) == len(tree.position_ids) == len(tree.loss_mask)
    for n in tree.nodes:
        seen = sum(a.stop - a.start for a in n.attends)
        assert tree.position_ids[n.start : n.stop] == list(range(seen, seen + n.stop - n.start))
        parents, at = set(), n.parent
        while at >= 0:
            parents |= set(range(tree.nodes[at].start, tree.nodes[at].stop))
            at = tree.nodes[at].parent
        assert {i for a in n.attends for i in range(a.start, a.stop)} == parents


def test_scores_prefer_the_target(spark):
    good, bad = "the cat sat on the mat", "buy cheap pills now now now"
    docs = spark.createDataFrame([(i, good if i % 2 else bad, "s") for i in range(40)] + [(98, None, ""), (99, "", "")], "doc_id long, text string, score string")
    targets = spark.createDataFrame([(i,) for i in range(1, 20, 2)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score(docs, targets).collect()}
    assert got[39].score < 0 < got[38].score and got[39].n_tokens == 6
    assert got[98].score is None and got[99].n_tokens == 0


def test_models_are_distributions(spark):
    """Both models, over every word that comes before another, at the size of the tests' tables."""
    docs = table(spark, SF, "documents")
    words, tokens = lm_scoring.vocabulary(docs, 3000)
    known = spark.sparkContext.broadcast(words)
    shards = lm_scoring.Shards(len(words) + 2, 100 * tokens)
    width = shards.width
    counted = lm_scoring.bigrams(lm_scoring.encoded(docs, table(spark, SF, "labels").where("quality = 1"), known), shards)
    singles, sizes = lm_scoring.word_counts(counted, shards)
    bigram, *counts = lm_scoring.frequent(counted, shards, sizes, 1 << 30)
    assert len(bigram) == sizes.sum() == len(set(bigram.tolist())) and counted.count() > 4 and tokens == counts[1].sum()
    for m in (0, 1):
        p1 = (singles[m, 0, : width - 1] + 1) / (singles[m, 0].sum() + width - 1)
        sums = np.bincount(bigram // width, weights=counts[m], minlength=width)
        assert p1.sum() == pytest.approx(1) and singles[m, 0].sum() == sums.sum() == singles[m, 1].sum()
        assert (sums + lm_scoring.MU * p1.sum()) / (singles[m, 1] + lm_scoring.MU) == pytest.approx(np.ones(width))


@pytest.mark.parametrize("values", [[], [0, 0], [5, 0, 255], [1 << 40, 3], [1 << 62]])
def test_packed_numbers(values):
    assert lm_scoring.unpack(lm_scoring.pack(np.array(values, dtype=np.int64))).tolist() == values


def brute_scores(docs, targets, size):
    from math import log2

    words = [(t or "").encode().split() for _, t in docs]
    top = sorted(Counter(w for ws in words for w in ws).items(), key=lambda x: (-x[1], x[0]))[:size]
    names = {w for w, _ in top}
    pairs = [list(zip([None, *ws], ws, strict=False)) for ws in ([w if w in names else b"" for w in ws] for ws in words)]
    out = []
    for i, (d, _) in enumerate(docs):
        losses = []
        for members in ([j for j, x in enumerate(docs) if x[0] in targets], range(len(docs))):
            rest = [p for j in members if j != i for p in pairs[j]]
            both, one, first = Counter(rest), Counter(w for _, w in rest), Counter(h for h, _ in rest)
            p1 = {w: (one[w] + 1) / (len(rest) + len(names) + 1) for w in (*names, b"")}
            losses.append([-log2((both[h, w] + 2 * p1[w]) / (first[h] + 2)) for h, w in pairs[i]])
        n = len(pairs[i])
        t, b = (sum(x) / n if n else None for x in losses)
        out.append((d, n, t, b, t - b if n else None))
    return out


@pytest.mark.parametrize("hot", [0, 7, 1 << 19])
def test_scores_leave_the_own_document_out(spark, monkeypatch, hot):
    monkeypatch.setattr(lm_scoring, "HELD_BIGRAMS", 20)
    monkeypatch.setattr(lm_scoring, "TOKENS_A_SHARD", 64)
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [docs[3], docs[3], (4, "w1 w2 w1 w2"), (None, "w1 w1 w3"), (70, None), (71, " ")]
    targets = set(range(1, 60, 4))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*targets, 1, None]], "doc_id long")
    rounded = lambda rs: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rs), key=repr)
    assert rounded(map(tuple, lm_scoring.score(frame, ids, 25, hot).collect())) == rounded(brute_scores(docs, targets, 25))


@pytest.mark.parametrize("limit", [1, 64, 1 << 20])
def test_whole_keys_split_no_key(limit):
    keys = np.repeat(np.array([-9, -2, 0, 5, 7, 8]), [1, 300, 2, 0, 41, 1])
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.arange(len(keys)))], names=["k", "v"])
    parts = list(whole_keys([rows.slice(lo, 7) for lo in range(0, len(keys), 7)] + [rows.slice(0, 0)], limit))
    assert np.concatenate([p.column(1).to_numpy() for p in parts]).tolist() == list(range(len(keys)))
    seen = [set(p.column(0).to_pylist()) for p in parts]
    assert sum(map(len, seen)) == len(set(keys.tolist()))
    assert len(parts) > 1 or limit > 64
    assert not list(whole_keys([rows.slice(0, 0)], limit))
