from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pplscope.bounded import local_copy, lookup_with_hot_keys, small_side
from pplscope.operators import columns as C, identity as I


def repeated(spark, n=400, seed=2):
    rng = random.Random(seed)
    # One id holds a third of all rows; null is an id like any other.
    rows = [(rng.choice([7, rng.randrange(60), None if rng.random() < 0.5 else 7]), f"t{i}", i) for i in range(n)]
    want, seen = [], set()
    for r in rows:
        if r[0] not in seen:
            seen.add(r[0])
            want.append(r)
    return spark.createDataFrame(rows, "id long, text string, ord long").repartition(5), want


@pytest.mark.parametrize("max_repeated", [500_000, 3])
def test_dedup_keeps_the_first_either_way(spark, max_repeated):
    df, want = repeated(spark)
    got = I.dedup_keep_first(df, "id", ["ord"], max_repeated=max_repeated)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == want


def test_dedup_null_ids_are_equal(spark):
    df = spark.createDataFrame([(1, "a", 0), (None, "b", 1), (None, "c", 2), (1, "d", 3)], "id long, t string, o long")
    assert {r.t for r in I.dedup_keep_first(df, "id", ["o"]).collect()} == {"a", "b"}


def test_dedup_leaves_unique_rows_unshuffled(spark):
    df = spark.range(100).withColumn("o", F.col("id"))
    plan = I.dedup_keep_first(df, "id", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_dense_index(spark):
    df = spark.createDataFrame([(i * 37 % 101, i % 3) for i in range(101)], "k long, g long").repartition(6)
    got = I.dense_index(df, [F.desc("g"), "k"], "pos", start=1).collect()
    assert [(r.k, r.g) for r in sorted(got, key=lambda r: r.pos)] == [
        (r.k, r.g) for r in df.orderBy(F.desc("g"), "k").collect()
    ]
    assert sorted(r.pos for r in got) == list(range(1, 102))


def test_scan_index_with_and_without_broadcast(spark, monkeypatch):
    rows = [(f"f{f}", r, (f * 31 + r * 7) % 5) for f in range(3) for r in range(50)]
    df = spark.createDataFrame(rows, "_file string, _row long, v long").repartition(4)
    kept = sorted(r for r in rows if r[2] > 1)
    for copy in (local_copy, lambda *a, **k: None):
        monkeypatch.setattr(I, "local_copy", copy)
        got = I.scan_index(df, F.col("v") > 1, "n", block=16)
        assert [(r._file, r._row, r.v) for r in sorted(got.collect(), key=lambda r: r.n)] == kept


@pytest.mark.parametrize("n, k, sizes", [(11, 4, [3, 3, 3, 2]), (8, 4, [2, 2, 2, 2]), (5, 5, [1] * 5)])
def test_balanced_slices(spark, n, k, sizes):
    got = I.balanced_slices(spark.range(n).repartition(3), k, ["id"]).orderBy("id").collect()
    assert [r.slice for r in got] == [s for s, size in enumerate(sizes) for _ in range(size)]


def test_an_empty_slice_is_an_error(spark):
    with pytest.raises(ValueError):
        I.balanced_slices(spark.range(2), 4, ["id"])


def test_doc_limit_rounds_up_to_batches(spark):
    docs = spark.range(30).withColumnRenamed("id", "doc_id")
    assert I.doc_limit(docs, 10, 4).count() == 12
    assert I.doc_limit(docs, 10, 4, exact=True).count() == 10
    assert I.doc_limit(docs, 0, 4).count() == I.doc_limit(docs, None, 4).count() == 30


def test_limits(spark):
    df = spark.range(10).repartition(3)
    assert [r.id for r in I.debug_limit(df, 3, ["id"]).collect()] == [0, 1, 2]
    assert I.debug_limit(df, 0, ["id"]).count() == 10


def test_small_side_checks_its_bounds(spark):
    assert local_copy(spark.range(11), max_rows=10) is None
    assert local_copy(spark.range(10), max_rows=10).count() == 10
    assert local_copy(spark.range(1000), max_bytes=100) is None
    big = spark.range(11)
    assert small_side(big, max_rows=10) is big


def test_lookup_with_hot_keys(spark):
    rows = [("the" if i % 3 else f"w{i % 50}", i) for i in range(600)] + [(None, 600), ("unknown", 601)]
    big = spark.createDataFrame(rows, "k string, i long")
    table = big.where("k is not null and k != 'unknown'").groupBy("k").agg(F.count("*").alias("uses"), F.min("i").alias("lowest"))
    want = {(r.k, r.i): r.lowest for r in big.join(table, "k", "left").collect()}
    for hot in (1, 3, 4096):
        got = lookup_with_hot_keys(big, table, ["k"], "uses", F.col("i"), hot=hot)
        assert {(r.k, r.i): r.lowest for r in got.collect()} == want
        assert got.columns == ["k", "i", "lowest"]


def test_column_helpers(spark):
    df = spark.createDataFrame([("1", "2", "t", "x")], "text_id string, chunk_id string, text string, my_logprobs string")
    assert C.logprob_columns(df) == ["my_logprobs"]
    assert C.columns_listing(df) == df.columns
    assert C.resolve_text_column(df) == "text"
    assert C.resolve_text_column(df.withColumnRenamed("text", "chunk_text")) == "chunk_text"
    with pytest.raises(ValueError):
        C.resolve_text_column(df.drop("text"))
    with pytest.raises(ValueError):
        C.require_columns(df, ["id"])
    assert dict(C.int_keys(df).dtypes)["text_id"] == "int"
    assert C.rename_columns(df, {"text": "prompt"}).columns[2] == "prompt"
    with pytest.raises(Exception):
        C.int_keys(df.withColumn("text_id", F.lit("junk"))).collect()


def test_blank_and_empty_differ(spark):
    df = spark.createDataFrame([("",), ("  ",), (None,), (" ",), ("a",)], "t string")
    assert C.nonempty_prompt(df, "t").count() == 3
    assert C.nonblank_response(df, "t").count() == 1
