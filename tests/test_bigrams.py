"""Word pair models in files: against counting, and what moves."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pplscope.operators import bigrams as B, scoring as M

KEYS = ["text_id", "chunk_id"]
TEXTS = "text_id long, chunk_id int, chunk_text string"


def split(text):
    return [w for w in (text or "").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if w]


def counted(train, texts, models, k=0.1, vocab=None):
    """(key, model) to log-probs by position, by definition; the tokens of rows that share a key together."""
    pairs, starts, words = defaultdict(Counter), defaultdict(Counter), set()
    for m, t in train:
        w = split(t)
        words.update(w)
        pairs[m].update(zip(w, w[1:]))
        starts[m].update(w[:-1])
    vocab, out = len(words) if vocab is None else vocab, {}
    for i, c, t in texts:
        w = split(t)
        rows = [[math.log((pairs[m][p] + k) / (starts[m][p[0]] + k * vocab)) for m in models] for p in zip(w, w[1:])]
        out.setdefault((i, c), []).extend((n, *r) for n, r in enumerate(rows))
    return {(*key, m): [r[j + 1] for r in sorted(rows)] for key, rows in out.items() for j, m in enumerate(models)}


def made(seed, train_rows=70, rows=90):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "the", "the", "cat", "é", "a\x0bb", f"w{r.randint(0, 40)}"])
    text = lambda: r.choice([" ", "\t", "\n ", " \r"]).join(word() for _ in range(r.choice([0, 1, 2, 60])))
    train = [(r.choice(["m0", "m1", "m2", "other", None]), text()) for _ in range(train_rows)]
    # More than a byte counts, of one model and of several.
    train += [("m0", "hot pair " * 300), ("m0", "the cat " * 400), ("m1", "the cat " * 270), ("m1", None), ("m2", "lonely")]
    texts = [(i // 2 if i < 20 else i, i % 3 if i >= 20 else 0, text()) for i in range(rows)]
    texts += [(None, 1, "the cat w1"), (None, 1, "hot pair hot"), (7000, None, "new words the"), (7001, 0, None), (7002, 0, "lonely")]
    return train, texts


def frames(spark, train, texts):
    return spark.createDataFrame(train, "model string, text string").repartition(3), spark.createDataFrame(texts, TEXTS).repartition(3)


def agree(got, want):
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values), key


@pytest.mark.parametrize("files", ["one", "many", "none"])
def test_scores_are_those_of_counting(spark, monkeypatch, files):
    if files == "many":
        for name, value in (("WORD_BYTES", 500), ("PAIR_BYTES", 300), ("SLICE", 400), ("HELD_VALUES", 50), ("BLOCK_VALUES", 7)):
            monkeypatch.setattr(B, name, value)
    elif files == "none":  # a store that only Spark reads
        monkeypatch.setattr(B, "mounted_folder", lambda spark: None)
    models = ["m0", "m1", "m2", "m0"]
    train, texts = made(3)
    want = counted(train, texts, models)
    both = frames(spark, train, texts)
    rows = M.ngram_scorer(*both, models).collect()
    assert len(rows) == len(models) * len({(i, c) for i, c, _ in texts})
    agree({(r.text_id, r.chunk_id, r.model): r.logprobs for r in rows}, want)
    ppl = M.ngram_ppl(*both, models).collect()
    assert len(ppl) == len(rows)
    for r in ppl:
        values = want[r.text_id, r.chunk_id, r.model]
        assert r.ppl == (pytest.approx(math.exp(-sum(values) / len(values)), rel=1e-8) if values else None)


def test_vocabulary_and_k_are_taken_as_given(spark):
    train, texts = made(4, 20, 10)
    got = M.ngram_scorer(*frames(spark, train, texts), ["m1"], k=2, vocab=50).collect()
    agree({(r.text_id, r.chunk_id, r.model): r.logprobs for r in got}, counted(train, texts, ["m1"], 2, 50))
    # Without k a pair that was never seen has no log-prob, and a start that was never seen is an error.
    some = frames(spark, [("m", "a b a c"), ("n", "a x")], [(1, 0, "a b a a"), (2, 0, "b b")])
    rows = {(r.text_id, r.model): r for r in M.ngram_scorer(*some, ["m"], k=0).collect()}
    assert rows[1, "m"].logprobs == [pytest.approx(math.log(0.5)), 0.0, None] and rows[2, "m"].logprobs == [None]
    assert {r.text_id: r.ppl for r in M.ngram_ppl(*some, ["m"], k=0).collect()} == {1: pytest.approx(2**0.5), 2: None}
    with pytest.raises(Exception, match="no log-prob"):
        M.ngram_ppl(*frames(spark, [("m", "a b")], [(1, 0, "b a")]), ["m"], k=0).collect()


def test_no_word_pair_moves_to_be_scored(spark):
    train, texts = frames(spark, *made(5, 20, 10))
    for scored in (M.ngram_ppl(train, texts, ["m0", "m1"]), M.ngram_scorer(train, texts.dropDuplicates(KEYS), ["m0", "m1"])):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "posexplode" not in plan and "MapInArrow" in plan


def test_blocks_and_bijections():
    for bits in (2, 4, 10, 16):
        values = B.stirred(np.arange(1 << bits, dtype=np.uint64), bits)
        assert len(np.unique(values)) == 1 << bits and values.max() < 1 << bits
    r = np.random.default_rng(1)
    values, counts = np.unique(r.integers(0, 1 << 63, 999, dtype=np.uint64)), r.integers(1, 400, 999)
    back = B.unpack(B.pack(values, counts[: len(values)]))
    assert (back[0] == values).all() and (back[1] == counts[: len(values)]).all()
    hashes, bounds = B.hashed_words(pa.array([" x", " a b\n", "", None, "a", "b  c\ta b", "a\x0bb"]).slice(1))
    assert bounds.tolist() == [0, 2, 2, 2, 3, 7, 8] and len(set(hashes.tolist())) == 4


@pytest.mark.parametrize("models, inner", [(1, 12), (6, 14), (70, 16), (300, 62)])
def test_counts_come_back_from_the_arrays(tmp_path, models, inner):
    r = np.random.default_rng(models)
    want = defaultdict(lambda: np.zeros(models, np.int64))
    found = {}
    for j in range(models):
        keys = np.unique(r.integers(0, 1 << 12, 60, dtype=np.uint64) << np.uint64(inner - 12))
        found[j] = keys, r.choice([1, 2, 50, 254, 255, 256, 70_000], len(keys))
        for key, n in zip(keys.tolist(), found[j][1], strict=True):
            want[key][j] = n
    B.write(f"{tmp_path}/a/pairs", **B.pair_arrays(found, models, inner))
    asked = np.unique(np.append(np.array(list(want), np.uint64), r.integers(0, 1 << inner, 500, dtype=np.uint64)))
    got = B.pair_counts(B.mapped(f"{tmp_path}/a/pairs"), asked, models, inner)
    assert (got == np.array([want.get(key, np.zeros(models)) for key in asked.tolist()])).all()


def test_top_chunks_are_scored_and_answers_read_once(spark, monkeypatch):
    """Accuracies and the selection are read from what was written, whatever is joined or counted then."""
    from pplscope.plans import jobs

    docs = spark.createDataFrame([(i, f"The cat {i} sat. It ran{' on' * i}.") for i in range(12)], "id long, text string")
    training = docs.select(F.concat(F.lit("m"), (F.col("id") % 2).cast("string")).alias("model"), "text")
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = [("m0", "x", True), ("m0", "y", True), ("m1", "x", False), ("m1", "y", True)]
    kind = "model string, model_response string, is_correct boolean"
    responses = spark.createDataFrame(rows, kind).mapInArrow(seen, kind)
    got = jobs.top_quality_chunks(docs, responses, training, ["m0", "m1"], 5).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and all(r.chunk_text.startswith("The cat") for r in got)
    assert reads.value == len(rows)
