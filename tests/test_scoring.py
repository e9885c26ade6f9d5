from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pplscope.functions.arrays import extract_first_logprob
from pplscope.operators import scoring as M
from pplscope.operators.chunking import document_windows, spread_windows
from pplscope.operators.stats import run_summary


def test_chunk_scores_keep_their_keys(spark):
    rows = [(t, c, " ".join("x" * (t + c + i + 1) for i in range(c))) for t in range(20) for c in range(5)]
    df = spark.createDataFrame(rows, "text_id long, chunk_id int, chunk_text string").repartition(3)
    got = {(r.text_id, r.chunk_id): r.logprobs for r in M.score_chunks(df, M.WordLengthScorer, batch_size=7).collect()}
    assert got == {(t, c): [-(t + c + i + 1) / 4 for i in range(1, c)] for t in range(20) for c in range(5)}
    summary = run_summary(M.score_chunks(df, M.WordLengthScorer, partitions=2)).first()
    assert (summary.n_rows, summary.n_tokens) == (100, 20 * (0 + 0 + 1 + 2 + 3))


def test_whole_document_scores(spark):
    texts = ["", "one", "a bb ccc dddd eeeee ffffff ggggggg", " ".join("w" * (i % 9 + 1) for i in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in M.score_documents(df, M.WordLengthScorer, ctx=5, stride=2).collect()}
    for i, text in enumerate(texts):
        words = text.split()
        assert got[i].decoded_tokens == words[1:]
        assert got[i].prompt_logprobs == [-len(w) / 4 for w in words[1:]]
    together = {r.doc_id: r for r in M.score_documents(df, M.WordLengthScorer, 5, 2, mode="concat").collect()}
    # Windows 0-2, 0-4, 1-6 and so on, each without its first token, cut to the document's length.
    assert together[2].decoded_tokens == ["bb", "bb", "ccc", "dddd", "ccc", "dddd", "eeeee"]
    assert together[0].decoded_tokens == [] == together[1].decoded_tokens


def test_without_context_each_window_loses_its_first_token(spark):
    df = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    assert M.score_documents(df, M.WordLengthScorer, 3, 3).first().decoded_tokens == ["b", "c", "e", "f"]


def test_bigram_model_matches_counting(spark):
    train = [("m0", "the cat sat on the mat"), ("m1", "the dog sat"), ("m1", "lonely"), ("m0", "the cat ran")]
    texts = [(0, 0, "the cat sat"), (0, 1, "lonely"), (1, 0, "the dog saw the cat"), (2, 0, "new words only"), (3, 0, "")]
    k, vocab = 0.1, len({w for _, t in train for w in t.split()})
    pairs, starts = defaultdict(Counter), defaultdict(Counter)
    for m, t in train:
        w = t.split()
        pairs[m].update(zip(w, w[1:]))
        starts[m].update(w[:-1])
    got = M.ngram_scorer(
        spark.createDataFrame(train, "model string, text string"),
        spark.createDataFrame(texts, "text_id long, chunk_id int, chunk_text string"), ["m0", "m1"], k,
    ).collect()
    assert len(got) == 10
    for r in got:
        w = next(t for i, c, t in texts if (i, c) == (r.text_id, r.chunk_id)).split()
        want = [math.log((pairs[r.model][p] + k) / (starts[r.model][p[0]] + k * vocab)) for p in zip(w, w[1:])]
        assert r.logprobs == pytest.approx(want)


def test_vocabulary_counts_lonely_words(spark):
    df = spark.createDataFrame([("a b",), ("c",), ("a",)], "text string")
    assert M.vocabulary_size(df) == 3
    assert M.bigram_rows(df.withColumn("id", F.lit(1)), ["id"], "text").where("a is null").count() == 2


def test_perplexities_by_sums_equal_those_of_the_lists(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["the", "the", "cat", "sat", f"w{rng.randint(0, 30)}"]) for _ in range(rng.choice([0, 1, 2, 40])))
    train = spark.createDataFrame([(f"m{rng.randint(0, 1)}", text()) for _ in range(60)], "model string, text string")
    texts = spark.createDataFrame([(i, i % 3, text()) for i in range(80)], "text_id long, chunk_id int, chunk_text string")
    lists = {(r.text_id, r.chunk_id, r.model): r.logprobs for r in M.ngram_scorer(train, texts, ["m0", "m1"]).collect()}
    sums = M.ngram_ppl(train, texts, ["m0", "m1"])
    got = {(r.text_id, r.chunk_id, r.model): r.ppl for r in sums.collect()}
    assert got.keys() == lists.keys() and len(got) == 160
    for key, values in lists.items():
        assert got[key] == (pytest.approx(math.exp(-sum(values) / len(values)), rel=1e-8) if values else None)
    assert "collect_list" not in sums._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ctx, stride", [(5, 2), (3, 3), (7, 3), (8, 1)])
def test_windows_from_blocks_are_the_windows(spark, ctx, stride):
    rows = [(i, [f"t{j}" for j in range(n)]) for i, n in enumerate([0, 1, 2, 3, 7, 8, 50])]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(2)
    whole = document_windows(df, ctx, stride)
    blocks = spread_windows(df, ctx, stride, partitions=3)
    assert blocks.columns == whole.columns
    empty = [r for r in blocks.collect() if not r.n_tokens]
    assert [(r.doc_id, r.window_id, r.window_tokens) for r in empty] == [(0, 0, [])]
    assert sorted(map(tuple, blocks.where("n_tokens > 0").collect())) == sorted(map(tuple, whole.collect()))
    with pytest.raises(ValueError):
        spread_windows(df, 2, 3)


def test_chunk_scores_equal_those_taken_from_the_raw_ones(spark):
    df = spark.createDataFrame([(1, "a bb ccc"), (2, None), (3, ""), (4, "x")], "k long, chunk_text string")
    raw = M.score_raw(df, M.WordLengthScorer, ["k"], "chunk_text").select("k", extract_first_logprob(F.col("raw")).alias("logprobs"))
    got = M.score_chunks(df, M.WordLengthScorer, keys=["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, raw.collect()))
    # The maps of tokens stay in the scorer's task.
    assert "map_values" not in got._jdf.queryExecution().executedPlan().toString()
