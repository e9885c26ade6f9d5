"""Histograms of all pairs by block products."""

from __future__ import annotations

import random

import pytest

from pplscope.operators import similarity as V
from pplscope.operators.stats import density_histogram


@pytest.mark.parametrize("block", [3, 2048])
def test_block_histogram_is_that_of_the_pairs(spark, block):
    r = random.Random(4)
    rows = [(i, i % 2, [r.gauss(0, 1) for _ in range(5)]) for i in range(41)] + [(50, 0, [0.0] * 5), (51, 7, [1.0] * 5)]
    df = spark.createDataFrame(rows, "id long, set int, embedding array<float>").repartition(3)
    got = V.cosine_histogram(df, "id", by="set", bins=9, block=block)
    want = density_histogram(V.pairwise_cosine(df, "id", by="set"), "cosine", 9, by="set")
    assert got.columns == want.columns
    a, b = (sorted(map(tuple, x.collect())) for x in (got, want))
    assert [(x[0], x[1], x[4]) for x in a] == [(x[0], x[1], x[4]) for x in b] and len(a) == 18
    for x, y in zip(a, b, strict=True):
        assert x[2:4] + x[5:] == pytest.approx(y[2:4] + y[5:])


def test_no_vectors_and_equal_vectors(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    assert V.cosine_histogram(none, "id").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "id long, embedding array<float>")
    got = V.cosine_histogram(same, "id", bins=2).collect()
    assert sum(x.n for x in got) == 6 and {c for x in got for c in x.asDict()} == {"bin", "lower", "upper", "n", "density"}


def test_vectors_move_as_often_as_there_are_blocks_not_tiles(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST_BLOCKS", 2)
    rows = [(i, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    got = V.cosine_histogram(df, "id", bins=4, block=3)
    # 67 tiles of a side; the plan of the second pass sends on every vector twice.
    assert sum(r.n for r in got.collect()) == 199 * 100
    seen = []
    monkeypatch.setattr(V, "small_side", lambda x: seen.append(x) or x)
    V.cosine_histogram(df, "id", bins=4, block=3)
    assert [r._parts for r in seen[0].collect()] == [2]
    monkeypatch.setattr(V, "HELD_VALUES", 60)
    V.cosine_histogram(df, "id", bins=4, block=3)
    assert [r._parts for r in seen[2].collect()] == [10]
