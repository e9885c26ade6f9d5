from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pplscope.functions import arrays as A, vectors as V


def scores(spark, *raws):
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(raws)], "i long, j string")
    return df.select("i", A.raw_from_json(F.col("j")).alias("raw"))


def token(logprob, word="w"):
    return {"logprob": logprob, "decoded_token": word}


def test_log_prob_extraction(spark):
    mixed = [None, {"7": token(-0.5, "a")}, None, {"9": token(-1.5, "b"), "3": token(-0.25, "c")}]
    df = scores(spark, [], [None], mixed, [{"1": token(-2.0)}])
    first = [r.x for r in df.orderBy("i").select(A.extract_first_logprob(F.col("raw")).alias("x")).collect()]
    assert first == [[], [], [-0.5, -1.5], []]
    every = [r.x for r in scores(spark, [], [None], mixed, None).orderBy("i").select(A.extract_all_logprobs(F.col("raw")).alias("x")).collect()]
    assert [x.prompt_logprobs for x in every] == [[], [], [-0.5, -1.5, -0.25], []]
    assert every[2].decoded_tokens == ["a", "b", "c"]


def test_perplexity(spark):
    df = spark.createDataFrame([(0, [-1.0, -3.0]), (1, []), (2, [float("nan"), -1.0]), (3, None)], "i long, lp array<double>")
    values = [r.p for r in df.orderBy("i").select(A.perplexity(F.col("lp")).alias("p")).collect()]
    assert values[0] == pytest.approx(7.38905609893065)
    assert values[1:] == [None, None, None]


def test_log_grid(spark):
    grid = spark.range(1).select(A.log_grid().alias("g")).first().g
    assert np.allclose(grid, np.logspace(-4, 2, 50), rtol=1e-12)


def test_cosine(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [pytest.approx(0.96), 0.0]
    assert math.isclose(0.96, 24 / 25)
