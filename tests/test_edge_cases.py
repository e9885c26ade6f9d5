"""Cases found by review: infinite perplexities, many models, reserved characters, scan positions, headers."""

from __future__ import annotations

import itertools
import math

import pytest
from pyspark.sql import functions as F

from pplscope.bounded import local_copy
from pplscope.functions import text as T
from pplscope.operators import chunking, perplexity, scoring
from pplscope.operators.identity import scan_index
from pplscope.sources import parquet, responses

INF = float("inf")


def pairwise(ppl: list, accuracy: list) -> float:
    """The definition: average ranks, then sign times rank difference over ordered pairs."""
    rank = [sum(y < x for y in ppl) + (sum(y == x for y in ppl) + 1) / 2 for x in ppl]
    sign = lambda d: (d > 0) - (d < 0)
    pairs = itertools.permutations(range(len(ppl)), 2)
    return float(sum(sign(accuracy[i] - accuracy[j]) * (rank[i] - rank[j]) for i, j in pairs))


@pytest.mark.parametrize("n", [3, 40])
def test_gamma_is_one_formula_and_never_nan(spark, n):
    accuracy = [round(0.1 + 0.01 * (i * 7 % n), 2) for i in range(n)]
    chunks = {
        (0, 0): [INF, INF, 2.0] + [float(i % 5) for i in range(n - 3)], (0, 1): [INF] * n, (1, 0): [float(i) for i in range(n)],
        (1, 1): [1.0] * (n - 1) + [math.nan], (2, 0): [1.0] * (n - 1) + [None],
    }
    rows = [(t, c, f"m{i}", x) for (t, c), values in chunks.items() for i, x in enumerate(values)]
    ppl = spark.createDataFrame([*rows, (1, 0, "m0", -1.0)], "text_id long, chunk_id long, model string, ppl double")
    rated = spark.createDataFrame([(f"m{i}", a) for i, a in enumerate(accuracy)], "model string, accuracy double")
    got = {(r.text_id, r.chunk_id): r.gamma for r in perplexity.gamma(ppl, rated).collect()}
    assert got[1, 1] is None and got[2, 0] is None
    for key in ((0, 0), (0, 1), (1, 0)):
        assert got[key] == pytest.approx(pairwise(chunks[key], accuracy))
    if n == 3:
        assert got[0, 0] == pairwise([INF, INF, 2.0], accuracy)


def test_gamma_without_common_models(spark):
    ppl = spark.createDataFrame([(1, 1, "a", 2.0)], "text_id long, chunk_id long, model string, ppl double")
    rated = spark.createDataFrame([("b", 0.5)], "model string, accuracy double")
    assert [r.gamma for r in perplexity.gamma(ppl, rated).collect()] == [0.0]


MARKED = ["one\ufdd0two. Three\ufdd1four", "\ufdd1A b. C\ufdd2 d.\n\nE\ufdd1 \U0001fffe f. " * 20, "plain. Text here."]


@pytest.mark.parametrize("size", [8, 60])
def test_reserved_characters_survive(spark, size):
    docs = spark.createDataFrame(list(enumerate(MARKED)), "id long, text string")
    chunks = chunking.chunk_documents(docs, size, 5).orderBy("text_id", "chunk_id").collect()
    recursive = {r.id: r.p for r in docs.select("id", T.recursive_pieces(F.col("text"), size).alias("p")).collect()}
    sentences = {r.id: r.p for r in docs.select("id", T.split_sentences(T.clean_text(F.col("text"))).alias("p")).collect()}
    squeeze = lambda t: "".join(t.split())
    for i, text in enumerate(MARKED):
        spans = "".join(r.chunk_text[r.new_start : r.new_end] for r in chunks if r.text_id == i)
        assert squeeze(spans) == squeeze(text) == squeeze("".join(recursive[i])) == squeeze("".join(sentences[i]))
    swapped = docs.select("id", F.translate("text", T.KEEP + T.BREAK, "\ufdee\ufdef").alias("text"))
    other = chunking.chunk_documents(swapped, size, 5).orderBy("text_id", "chunk_id").collect()
    assert [r.chunk_text.translate({0xFDEE: T.KEEP, 0xFDEF: T.BREAK}) for r in other] == [r.chunk_text for r in chunks]


def test_scan_index_is_linear_and_narrow(spark, tmp_path):
    n = 200_000
    spark.range(n, numPartitions=3).select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("").alias("text")).write.parquet(str(tmp_path / "t"))
    docs = parquet.scan_parquet(spark, str(tmp_path / "t"), with_order=True)
    got = scan_index(docs, F.col("text") != "", block=1000)
    assert "_dropped" not in got._jdf.queryExecution().toString()
    assert got.agg(F.min("doc_id"), F.max("doc_id"), F.countDistinct("doc_id")).first() == (0, n // 2 - 1, n // 2)
    assert got.where("doc_id * 2 <> id").count() == 0


def test_local_copy_bounds_bytes_before_it_collects(spark):
    wide = spark.range(20).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    assert local_copy(wide, max_rows=100, max_bytes=100_000) is None
    assert local_copy(wide, max_rows=100, max_bytes=1_000_000).count() == 20


def test_response_files_with_their_own_headers(spark, tmp_path):
    files = {"a": "model_response,is_correct\nyes,True\n", "b": "is_correct,model_response\nFalse,no\n", "c": "model_response\nmaybe\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    want = [("a", "yes", True), ("b", "no", False), ("c", "maybe", None)]
    paths = [str(tmp_path / f"{n}.csv") for n in files]
    assert sorted((r.model, r.model_response, r.is_correct) for r in responses.scan_responses_csv(spark, paths).collect()) == want
    assert responses.scan_responses_csv(spark, str(tmp_path)).count() == 3
    mapped = responses.scan_responses_csv(spark, paths, {"a.csv": "first", "c.csv": "third"})
    assert sorted(r.model for r in mapped.collect()) == ["first", "third"]


def test_windows_are_dealt_out_before_they_are_scored(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    plan = scoring.score_documents(docs, scoring.WordLengthScorer, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[plan.index("MapInArrow") :]


@pytest.mark.parametrize("side", ["top", "bottom"])
def test_selected_texts_are_embedded_and_compared(spark, side):
    from pplscope.operators import similarity

    class LengthEncoder:
        def encode(self, texts):
            return [[len(t), t.count("a"), 1.0] for t in texts]

    rows = [(i, i % 3, float(i * 7 % 50), "ab" * (i % 11 + 1)) for i in range(60)]
    chunks = spark.createDataFrame(rows, "text_id long, chunk_id long, gamma double, chunk_text string")
    scores = chunks.drop("chunk_text")
    ready = similarity.embed_texts(chunks, LengthEncoder, ["text_id", "chunk_id"])
    want = similarity.compare_sets(scores, ready, n=10, side=side, bins=5)
    got = similarity.compare_texts(scores, chunks, LengthEncoder, n=10, side=side, bins=5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_command_line_maps():
    from pplscope.__main__ import parser

    args = parser().parse_args(["analyse", "--results", "r", "--responses", "s", "--chunks", "c", "--output", "o", "--model-map", '{"a.parquet": "m"}'])
    assert args.model_map == {"a.parquet": "m"} and args.encoder is None
