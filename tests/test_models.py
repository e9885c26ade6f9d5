"""Perplexity, score, selection, similarity and histogram operators against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pplscope.operators import perplexity as P, selection as S, similarity as V, stats


def random_ppl(spark, n_chunks, n_models, seed, missing=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_chunks):
        for m in range(n_models):
            if rng.random() < missing / 2:
                continue
            value = None if rng.random() < missing else float(rng.integers(1, 6))
            rows.append((c % 7, c, f"m{m:02d}", value))
    return rows, spark.createDataFrame(rows, "text_id long, chunk_id long, model string, ppl double")


def score_by_definition(values, accuracy):
    names = sorted(accuracy)
    if any(values.get(m) is None for m in names):
        return None
    ranks = pd.Series([values[m] for m in names]).rank(method="average").to_numpy()
    y = [accuracy[m] for m in names]
    return sum(
        np.sign(y[k] - y[l]) * (ranks[k] - ranks[l]) for k, l in itertools.permutations(range(len(names)), 2)
    )


@pytest.mark.parametrize("n_models, tied", [(6, False), (6, True), (3, False), (40, False)])
def test_gamma_matches_its_definition(spark, n_models, tied):
    rows, ppl = random_ppl(spark, 60, n_models, seed=n_models)
    rng = np.random.default_rng(9)
    accuracy = {f"m{m:02d}": float(rng.integers(0, 3) / 10 if tied else rng.random()) for m in range(n_models)}
    acc = spark.createDataFrame([*accuracy.items(), ("absent", 0.9), ("unrated", None)], "model string, accuracy double")
    by_chunk = {}
    for t, c, m, v in rows:
        by_chunk.setdefault((t, c), {})[m] = v
    want = {k: score_by_definition(v, accuracy) for k, v in by_chunk.items()}
    sums = P.accuracy_sign_sums(acc.where(F.col("model").startswith("m")))
    for got in (P.gamma(ppl, acc), P.gamma(ppl, acc, sorted(accuracy)), P.gamma_by_rank(ppl, sums)):
        assert {(r.text_id, r.chunk_id): r.gamma for r in got.collect()} == want


def one_chunk(spark, values):
    rows = [(0, 0, f"m{i}", None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "text_id long, chunk_id long, model string, ppl double")


def test_gamma_extremes(spark):
    rising = spark.createDataFrame([(f"m{i}", i / 10) for i in range(6)], "model string, accuracy double")
    level = rising.withColumn("accuracy", F.lit(0.5))
    for values, acc, want in (
        (range(6), rising, 70.0), (range(6, 0, -1), rising, -70.0), (range(6), level, 0.0), ([1, 2, None, 3, 4, 5], rising, None),
    ):
        assert P.gamma(one_chunk(spark, values), acc).first().gamma == want


def test_gamma_shuffles_once(spark):
    _, ppl = random_ppl(spark, 20, 6, seed=1)
    acc = spark.createDataFrame([(f"m{i:02d}", i / 10) for i in range(6)], "model string, accuracy double")
    plan = P.gamma(ppl, acc, [f"m{i:02d}" for i in range(6)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_average_rank(spark):
    got = P.average_rank(one_chunk(spark, [3, None, 1, 3])).orderBy("model").collect()
    assert [r.ppl_rank for r in got] == [2.5, None, 1.0, 2.5]


def test_accuracy_of_usable_responses(spark):
    rows = [("a", "x", True), ("a", " ", True), ("a", None, False), ("a", "y", None), ("a", "z", False), ("b", "  ", True)]
    df = spark.createDataFrame(rows, "model string, model_response string, is_correct boolean")
    assert {r.model: r.accuracy for r in P.model_accuracy(df).collect()} == {"a": 0.5, "b": None}
    assert {r.accuracy for r in P.model_accuracy(df.drop("is_correct")).collect()} == {None}


def test_mean_perplexity_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 4.0), (None, None)], "a double, b double")
    assert [r.ppl for r in P.mean_ppl_over_columns(df, ["a", "b"]).collect()] == [2.0, 4.0, None]


def gammas(spark, values):
    rows = [(0, i, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "text_id long, chunk_id long, gamma double").repartition(3)


def test_top_and_bottom_with_ties_and_missing(spark):
    df = gammas(spark, [1, None, 3, 3, -2])
    picks = lambda rows: [r.chunk_id for r in rows.collect()]
    assert picks(S.top_gamma(df, 4)) == [2, 3, 0, 4]
    assert picks(S.top_gamma(df, 5)) == [2, 3, 0, 4, 1]
    assert picks(S.bottom_gamma(df, 4)) == [4, 0, 2, 3]
    assert picks(S.bottom_gamma(df, 5)) == [4, 0, 2, 3, 1]
    assert picks(S.gamma_curve(df).orderBy("rank")) == [2, 3, 0, 4, 1]


def test_texts_come_in_selection_order_and_must_exist(spark):
    df = gammas(spark, [1, 5, 3])
    texts = spark.createDataFrame([(0, i, f"t{i}") for i in range(3)], "text_id long, chunk_id long, chunk_text string")
    top = S.with_rank(S.top_gamma(df, 2))
    assert [r.chunk_text for r in S.lookup_texts(top, texts).collect()] == ["t1", "t2"]
    with pytest.raises(PySparkException):
        S.lookup_texts(top, texts.where("chunk_id != 2")).collect()


def test_control_is_repeatable_disjoint_and_checked(spark):
    df = gammas(spark, range(50))
    top = S.top_gamma(df, 10)
    draw = lambda seed: {r.chunk_id for r in S.random_control(df, top, 20, seed).collect()}
    assert draw(1) == draw(1) != draw(2)
    assert len(draw(1)) == 20 and draw(1).isdisjoint({r.chunk_id for r in top.collect()})
    assert S.complement(df, top).count() == 40
    with pytest.raises(PySparkException):
        S.random_control(df, top, 41).collect()
    with pytest.raises(PySparkException):
        S.random_control(top, top, 1).collect()


def test_report_lines(spark):
    rows = spark.createDataFrame([(1, 4, " a \n"), (2, 9, "b")], "rank int, chunk_index long, chunk_text string")
    assert [r.value for r in S.top_chunk_report(rows).collect()] == ["=== Chunk 4 ===\na\n", "=== Chunk 9 ===\nb\n"]
    plain = spark.createDataFrame([(3, 0, " x ")], "text_id long, chunk_id int, chunk_text string")
    assert S.chunk_sample_text(plain, legacy=True).first().value == "[text_id=3 | chunk_id=0]\nx\n"


@pytest.mark.parametrize("blocks", [1, 3, 8])
def test_all_pairs_once(spark, blocks):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(23, 5))
    x[4] = 0
    df = spark.createDataFrame([(i, s, x[i].tolist()) for i in range(23) for s in ("p", "q")], "id long, set string, embedding array<double>")
    got = V.pairwise_cosine(df, "id", by="set", blocks=blocks).collect()
    norms = np.linalg.norm(x, axis=1)
    assert sorted((r["set"], r.id_i, r.id_j) for r in got) == [
        (s, i, j) for s in ("p", "q") for i in range(23) for j in range(i + 1, 23)
    ]
    for r in got:
        scale = norms[r.id_i] * norms[r.id_j]
        assert r.cosine == pytest.approx(x[r.id_i] @ x[r.id_j] / scale if scale else 0.0, abs=1e-12)


@pytest.mark.parametrize("values", [list(np.random.default_rng(5).normal(size=3000)), [1.0] * 7, [0.0, 1.0, 0.5]])
def test_histogram_is_numpys(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    got = stats.density_histogram(df, "v").orderBy("bin").collect()
    density, edges = np.histogram(values, bins=50, density=True)
    assert np.allclose([r.density for r in got], density)
    assert np.allclose([r.lower for r in got] + [got[-1].upper], edges)
    assert math.isclose(sum(r.density * (r.upper - r.lower) for r in got), 1.0)


def test_statistics(spark):
    rows = [(1, 0, "aa"), (1, 1, "b"), (2, 0, "cccc"), (None, 0, "x"), (3, 0, "dddd")]
    df = spark.createDataFrame(rows, "text_id long, chunk_id int, chunk_text string")
    assert stats.text_count(df).first().n_texts == 3
    assert {(r.text_id, r.n_chunks) for r in stats.chunks_per_text(df).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert stats.mean_chunks_per_text(df).first().mean_chunks == pytest.approx(4 / 3)
    assert [r.text_id for r in stats.top_texts(df, 2).collect()] == [1, 2]
    assert stats.chunk_length_stats(df).first().mean_length == pytest.approx(12 / 5)
    assert [r.chunk_length for r in stats.longest_chunks(df, 2).collect()] == [4, 4]
