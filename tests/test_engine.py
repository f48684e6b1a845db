"""Semantics on small inputs: circuits, blocks, empty and constant selections, nulls, bitmaps, streams."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SF, TABLES, rows, same_rows
from pyspark.sql import functions as F
from sluice.functions import bit_reverse, horizontal_sum, page, slot, vector_add
from sluice.operators import bitmaps, reducers, sets
from sluice.operators.keyed import KeyedTable
from sluice.operators.selection import evaluate, evaluate_if_keys_intersect, select_filter
from sluice.operators.terms import NOTHING, Slice, Term, intersection_of, union_of
from sluice.plans.context import DatasetSpec
from sluice.plans.queries import ORACLES, QUERIES
from sluice.sources import latest, number_rows, row_set, synthetic_rows, synthetic_trades
from sluice.streaming import ingest, snapshot

SCHEMA = "row_id long, a boolean, b boolean, c boolean, x double, y double"
SPEC = DatasetSpec().filter("a", "a").filter("b", "b").filter("c", "c").metric("x", "x").metric("y", "y").row_id("row_id")


def context(spark, data):
    return SPEC.over(spark.createDataFrame(data, SCHEMA))


@pytest.fixture(scope="module")
def ids(spark):
    a, b = {0, 1, 65536, 65537, 131073}, {0, 2, 65536, 65538, 131074}
    return context(spark, [(i, i in a, i in b, None, float(i % 7), float(i % 5)) for i in sorted(a | b | {5, 70000, 200000})])


@pytest.fixture(scope="module")
def many(spark):
    """Rows across pages and blocks: a full page, a part of one, long runs and a block that only one filter has."""
    rng = random.Random(1)
    at = [*range(0, 1500), *range(65_530, 65_545), *range(131_072, 133_000, 3), *range(200_000, 200_020)]
    data = [(i, i < 1100 or rng.random() < 0.3, rng.random() < 0.5 and i < 200_000, i % 3 == 0, rng.random(), -rng.random()) for i in at]
    return context(spark, data), data


def test_fold_refuses_negative_ids(spark):
    ctx = context(spark, [(i, True, None, None, 1.0, 1.0) for i in (-40, -1, 5)])
    with pytest.raises(ValueError, match="-40"):
        select_filter(ctx, "a").fold(F.lit(0.0), ctx.metric("x"), lambda a, b: a + b)


def test_constants_leave_circuits():
    a, true = Term("name", "a"), Term("const", True)
    same = {a | NOTHING: "a", NOTHING | a: "a", a & true: "a", a - NOTHING: "a", a ^ NOTHING: "a", ~NOTHING & a: "a"}
    assert all(t.simplified().op == "name" for t in same)
    assert all(t.simplified().op == "not" for t in (true - a, a ^ true, true ^ a))
    for t, value in ((a | true, True), (a & NOTHING, False), (a - true, False), (NOTHING - a, False), (~true, False)):
        assert t.simplified().op == "const" and t.simplified().args[0] is value


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    found = {name: plan(QUERIES[name](spark, SF)) for name in ("contains_hit", "contains_range", "slice_default", "keys_intersect_and", "sum_product_keys_intersect", "is_empty_blocks", "no_circuit", "keys_intersect_xor", "array_pmcc")}
    assert not any("NestedLoop" in p or "Cartesian" in p for p in found.values())
    assert "EqualTo(o_orderkey,1)" in found["contains_hit"] and "GreaterThanOrEqual(o_orderkey,100)" in found["contains_range"]
    assert "GreaterThan(o_totalprice,400000.0)" in found["slice_default"]
    assert "Join" not in found["keys_intersect_and"] + found["sum_product_keys_intersect"] and "Join" in found["keys_intersect_xor"]


def test_separate_sources(spark, many):
    """A filter from an id list, one from words and a metric from another table, together."""
    ctx, data = many
    listed = [i for i, *_ in data if i % 5 == 0]
    ids = spark.createDataFrame([(i,) for i in [*listed, listed[0], None, 10**9]], "row_id long")
    words = bitmaps.circuit_words(bitmaps.filter_words(ctx, "a", "b"), lambda s: s["a"] & s["b"], "a", "b")
    values = spark.createDataFrame([(i, float(i % 11)) for i in listed], "row_id long, value double")
    wide = ctx.with_rows("listed", ids).with_words("both", words).with_metric_of("far", values)
    got = evaluate(wide, lambda s: s["listed"] | s["both"], "listed", "both").reduce(n=reducers.count(), far=reducers.total("far")).first()
    chosen = [i for i, a, b, *_ in data if i % 5 == 0 or (a and b)]
    assert got.n == len(chosen) and got.far == sum(float(i % 11) for i in chosen if i % 5 == 0)
    assert bitmaps.selected(ctx, words).cardinality() == sum(1 for _, a, b, *_ in data if a and b)


def test_words_of_many_filters(many, monkeypatch):
    ctx, _ = many
    few = rows(bitmaps.filter_words(ctx, "a", "b", "c"))
    monkeypatch.setattr(bitmaps, "FEW", 1)
    assert rows(bitmaps.filter_words(ctx, "a", "b", "c")) == few


OPERATIONS = {
    "and": (lambda s: s["a"] & s["b"], lambda a, b: a and b),
    "or": (lambda s: s["a"] | s["b"], lambda a, b: a or b),
    "xor": (lambda s: s["a"] ^ s["b"], lambda a, b: a != b),
    "andnot": (lambda s: s["a"] - s["b"], lambda a, b: a and not b),
}


def found(selection):
    return sorted(r[0] for r in selection.rows().collect())


def test_known_ids(ids):
    assert found(evaluate_if_keys_intersect(ids, lambda s: s["a"] & s["b"], "a", "b")) == [0, 65536]
    assert found(evaluate(ids, lambda s: s["a"] ^ s["b"], "a", "b")) == [1, 2, 65537, 65538, 131073, 131074]


def test_membership(spark):
    ctx = context(spark, [(i, True, False, False, 0.0, 0.0) for i in (1, 11, 65537)])
    assert select_filter(ctx, "a").contains(11) and not select_filter(ctx, "a").contains(12)
    assert select_filter(ctx, "a").cardinality() == 3
    words = bitmaps.words_of_rows(row_set(spark, [1, 16384, 65537, 131072, 1]), "z")
    assert bitmaps.cardinality(words).first()[0] == 4 and bitmaps.contains(words, 16384) and not bitmaps.contains(words, 2)


@pytest.mark.parametrize("op", OPERATIONS)
def test_forms_agree(many, op):
    ctx, data = many
    circuit, plain = OPERATIONS[op]
    expected = sorted(r[0] for r in data if plain(r[1], r[2]))
    chosen = evaluate(ctx, circuit, "a", "b")
    assert found(chosen) == expected
    words = bitmaps.circuit_words(bitmaps.filter_words(ctx, "a", "b"), circuit, "a", "b")
    assert sorted(r[0] for r in bitmaps.rows_of_words(words).collect()) == expected
    kept = {k for k in {r[0] >> 16 for r in data if r[1]} if any(r[2] and r[0] >> 16 == k for r in data)}
    assert found(evaluate_if_keys_intersect(ctx, circuit, "a", "b")) == [i for i in expected if i >> 16 in kept]


def test_block_rule_differs(many):
    ctx, _ = many
    assert evaluate(ctx, lambda s: s["a"] | s["b"], "a", "b").cardinality() > evaluate_if_keys_intersect(ctx, lambda s: s["a"] | s["b"], "a", "b").cardinality()


@pytest.mark.parametrize("op", OPERATIONS)
def test_reducers(many, op):
    ctx, data = many
    circuit, plain = OPERATIONS[op]
    x, y = zip(*((r[4], r[5]) for r in data if plain(r[1], r[2])), strict=True)
    n = len(x)
    got = evaluate(ctx, circuit, "a", "b").reduce(s=reducers.total("x"), p=reducers.sum_product("x", "y"), m=reducers.average("x"), n=reducers.count(), r=reducers.correlation("x", "y"), v=reducers.regression_moments("x", "y")).first()
    sxx, syy, sxy = sum(a * a for a in x), sum(b * b for b in y), sum(a * b for a, b in zip(x, y, strict=True))
    assert got.s == pytest.approx(sum(x)) and got.p == pytest.approx(sxy) and got.m == pytest.approx(sum(x) / n) and got.n == n
    assert tuple(got.v) == pytest.approx((sum(x), sum(y), sxx, syy, sxy, n))
    assert got.r == pytest.approx((n * sxy - sum(x) * sum(y)) / math.sqrt((n * sxx - sum(x) ** 2) * (n * syy - sum(y) ** 2)), abs=1e-5)
    lanes = evaluate(ctx, circuit, "a", "b").lanes("x").agg(F.sum("total")).first()[0]
    assert lanes == pytest.approx(sum(x))


def test_algebra(many):
    ctx, _ = many
    n = {op: evaluate(ctx, c, "a", "b").cardinality() for op, (c, _) in OPERATIONS.items()}
    a, b = select_filter(ctx, "a").cardinality(), select_filter(ctx, "b").cardinality()
    assert n["or"] == a + b - n["and"] and n["xor"] == n["or"] - n["and"] and n["andnot"] == a - n["and"]
    morgan = evaluate(ctx, lambda s: ~(~s["a"] | ~s["b"]), "a", "b")
    assert morgan.cardinality() == n["and"]
    assert select_filter(ctx, "a").value(reducers.correlation("x", "x")) == pytest.approx(1)


def test_empty_and_constant(spark):
    ctx = context(spark, [(i, True, False, None, 2.0, float(i)) for i in range(5)])
    for name in ("b", "c"):
        got = select_filter(ctx, name).reduce(s=reducers.total("x"), p=reducers.sum_product("x", "y"), m=reducers.average("x"), n=reducers.count(), r=reducers.correlation("x", "y")).first()
        assert (got.s, got.p, got.n) == (0.0, 0.0, 0) and math.isnan(got.m) and math.isnan(got.r)
    assert math.isnan(select_filter(ctx, "a").value(reducers.correlation("x", "y")))
    one = context(spark, [(0, True, False, False, 1.0, 2.0)])
    assert math.isnan(select_filter(one, "a").value(reducers.correlation("x", "y")))


def test_nulls_count_as_zero_and_false(spark):
    ctx = context(spark, [(0, True, None, None, None, 1.0), (1, True, True, None, 4.0, None), (2, None, True, None, 8.0, 1.0)])
    got = select_filter(ctx, "a").reduce(s=reducers.total("x"), m=reducers.average("x"), p=reducers.sum_product("x", "y")).first()
    assert (got.s, got.m, got.p) == (4.0, 2.0, 0.0)
    assert found(evaluate(ctx, lambda s: s["a"] - s["b"], "a", "b")) == [0]
    assert found(evaluate(ctx, lambda s: s["a"] ^ s["b"], "a", "b")) == [0, 2]
    assert found(evaluate(ctx, lambda s: ~s["b"], "b")) == [0]


def test_presence_of_blocks(ids):
    assert evaluate(ids, lambda s: None, "a").is_empty()
    same = evaluate(ids, lambda s: s["a"] - s["a"], "a")
    assert not same.is_empty() and same.has_no_rows() and same.cardinality() == 0


def test_errors(ids):
    with pytest.raises(ValueError):
        evaluate(ids, lambda s: NOTHING)
    with pytest.raises(KeyError):
        evaluate(ids, lambda s: s["z"], "z")
    with pytest.raises(ValueError):
        DatasetSpec().filter("a", "a").over(ids.df)
    with pytest.raises(KeyError):
        ids.metric("z")


def test_slices():
    s = Slice(("foo", "bar"))
    assert list(s) == ["foo", "bar"] and s["baz"] is NOTHING and "baz" not in s and s.get("baz", s["foo"]) is s["foo"]


def test_specs_are_immutable(spark, ids):
    changed = SPEC.filter("a", F.lit(True)).over(ids.df)
    assert select_filter(changed, "a").cardinality() == ids.df.count() and select_filter(ids, "a").cardinality() == 5


def test_many_filters(spark):
    spec = DatasetSpec().metric("one", F.lit(1.0)).row_id("id")
    for i in range(300):
        spec = spec.filter(f"f{i}", F.col("id") % 601 == i)
    ctx = spec.over(spark.range(6010))
    names = [f"f{i}" for i in range(300)]
    assert evaluate(ctx, union_of, *names).cardinality() == 3000
    assert evaluate(ctx, intersection_of, *names).cardinality() == 0
    assert bitmaps.cardinality(bitmaps.circuit_words(bitmaps.filter_words(ctx, *names), union_of, *names)).first()[0] == 3000


def test_nested_selections(many):
    ctx, data = many
    inner = evaluate_if_keys_intersect(ctx, lambda s: s["a"] | s["b"], "a", "b")
    outer = evaluate(inner.as_filter("ab"), lambda s: s["ab"] - s["c"], "ab", "c")
    third = {r[0] for r in data if r[3]}
    assert found(outer) == [i for i in found(inner) if i not in third]


def test_ordered_fold(many):
    ctx, data = many
    got = select_filter(ctx, "a").fold(F.lit("<"), F.col("row_id").cast("string"), lambda a, b: F.concat(a, F.lit(","), b)).first()[0]
    assert got == ",".join(["<", *(str(r[0]) for r in data if r[1])])
    assert select_filter(ctx, "a").fold(F.lit(1.0), ctx.metric("x"), lambda a, b: a + b).first()[0] == pytest.approx(1 + sum(r[4] for r in data if r[1]))


def test_pages(many):
    ctx, data = many
    full = select_filter(ctx, "a").pages("x").where("rows = 1024").collect()
    assert len(full) == 1 and [v.slot for v in full[0]["values"]] == list(range(1024))
    assert ctx.df.where(page(F.col("row_id")) == 1).where(slot(F.col("row_id")) == 0).count() == 1


def test_bit_reversal(spark):
    k = spark.range(1 << 16).select(F.col("id").cast("int").alias("k")).withColumn("r", bit_reverse(F.col("k")))
    assert k.select("r").distinct().count() == 1 << 16 and k.where(bit_reverse(F.col("r")) != F.col("k")).count() == 0


def test_bit_reversal_beyond_its_bits(spark, tmp_path):
    """Keys of more than 16 bits, negative ones and none, as in SQL."""
    for t in TABLES:
        if t != "orders":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    ids = [None, -(1 << 20) - 1, -17, -1, 0, 15, 16, (1 << 20) - 1, *range(1 << 20, (1 << 20) + 64, 7), 9_000_000, 1 << 40, (1 << 53) - 1]
    pq.write_table(pa.table({"o_orderkey": pa.array(ids, pa.int64())}), tmp_path / "orders.parquet")
    same_rows(QUERIES["bit_reverse_keys"](spark, str(tmp_path)), ORACLES["bit_reverse_keys"], str(tmp_path))
    assert [r[0] for r in spark.range(1 << 16, (1 << 16) + 4).select(bit_reverse(F.col("id"))).collect()] == [0, 1 << 15, 1 << 14, 3 << 14]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), (None, [1.0]), ([2.0], None)], "l array<double>, r array<double>")
    assert [r[0] for r in df.select(horizontal_sum(vector_add(F.col("l"), F.col("r")))).collect()] == [10.0, 1.0, 2.0]
    with pytest.raises(Exception, match="differ"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "l array<double>, r array<double>").select(vector_add(F.col("l"), F.col("r"))).collect()


def test_keyed_tables(spark):
    t = KeyedTable(spark.createDataFrame([(0, "three blind mice"), (129, "a little mouse with clogs on")], "key int, value string"))
    assert t.get(0) == "three blind mice" and t.get(1) is None
    words = t.fold(F.lit(0), lambda v: F.size(F.split(v, " ")))
    assert words.first()[0] == 9
    t = t.upsert(spark.createDataFrame([(0, "x")], "key int, value string"))
    assert t.get(0) == "x" and t.window(100, 50).df.count() == 1 and not t.is_empty()
    assert t.merge(t, every=True).count() == 2


def test_sets(spark):
    a, b = row_set(spark, [1, 2, 3, 3]), row_set(spark, [3, 4])
    assert [sorted(r[0] for r in f(a, b).collect()) for f in (sets.union, sets.intersection, sets.difference, sets.symmetric_difference)] == [[1, 2, 3, 4], [3], [1, 2], [1, 2, 4]]


def test_sources(spark):
    assert rows(latest(spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 1, 5.0)], "row_id long, seq int, value double"))) == [(1, 3.0), (2, 5.0)]
    numbered = number_rows(spark.range(1000).select((999 - F.col("id")).alias("v")), "v").collect()
    assert all(r.row_id == r.v for r in numbered) and len(numbered) == 1000
    trades = synthetic_trades(spark, 2000)
    assert trades.select("instrument").distinct().count() == 10 and rows(trades) == rows(synthetic_trades(spark, 2000))
    assert synthetic_rows(spark, 2).where("row_id >= 131072").count() == 0


def test_stream(spark, tmp_path):
    spec = DatasetSpec().filter("even", F.col("v") % 2 == 0).metric("v", F.col("v")).row_id("v")
    spark.range(100).select(F.col("id").alias("v")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v long").parquet(str(tmp_path / "in"))
    ingest(spec, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    before = snapshot(spark, spec, str(tmp_path / "out"))
    assert select_filter(before, "even").value(reducers.total("v")) == sum(range(0, 100, 2))
    spark.range(100, 110).select(F.col("id").alias("v")).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(spec, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert select_filter(snapshot(spark, spec, str(tmp_path / "out")), "even").cardinality() == 55


def test_filters_reach_the_scan(spark):
    from conftest import SF
    from sluice.plans.queries import lines

    def plan(circuit):
        return evaluate(lines(spark, SF), circuit, "returned", "bulk").reduce(s=reducers.total("price"))._jdf.queryExecution().toString()

    for circuit, pushed in ((lambda s: s["returned"] & s["bulk"], "EqualTo(l_returnflag,R), GreaterThan(l_quantity,40.0)"), (lambda s: s["returned"] - s["bulk"], "EqualTo(l_returnflag,R)"), (lambda s: s["returned"] ^ s["bulk"], "Or(EqualTo(l_returnflag,R),GreaterThan(l_quantity,40.0))")):
        text = plan(circuit)
        assert pushed in text and "l_tax" not in text.split("ReadSchema")[-1]


def test_persisted_contexts(many):
    ctx, _ = many
    kept = ctx.persist()
    assert found(evaluate(kept, lambda s: s["a"] ^ s["b"], "a", "b")) == found(evaluate(ctx, lambda s: s["a"] ^ s["b"], "a", "b"))


def test_word_index(spark):
    """A stored index answers circuits as the row form does, without a shuffle, null and negative ids among the rows."""
    rows = spark.createDataFrame([(i if i % 11 else None, i % 3 == 0, None if i % 7 == 0 else i % 5 == 0) for i in range(-300, 700)], "id long, x boolean, y boolean")
    ctx = DatasetSpec().filter("a`b", "x").filter("c.d", "y").metric("one", "1.0").row_id("id").over(rows)
    index = bitmaps.word_index(ctx, "a`b", "c.d")
    for circuit, rule in ((lambda s: s["a`b"] & s["c.d"], "x and y"), (lambda s: s["a`b"] ^ s["c.d"], "x <> coalesce(y, false)"), (lambda s: s["a`b"] - s["c.d"], "x and not coalesce(y, false)")):
        words = bitmaps.indexed_words(index, circuit, "a`b", "c.d")
        expected = {r.id for r in rows.where("id is not null").where(rule).collect()}
        assert {r.row_id for r in bitmaps.rows_of_words(words).collect()} == expected
        long = bitmaps.circuit_words(bitmaps.filter_words(ctx, "a`b", "c.d"), circuit, "a`b", "c.d")
        assert {tuple(r) for r in long.collect()} == {tuple(r) for r in words.collect()}
    assert words._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
