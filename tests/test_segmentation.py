"""Learned sentence borders."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pplscope.operators import segmentation as G
from pplscope.operators.chunking import chunk_documents


def corpus(seed=1, n=300):
    """Sentences of made-up words; `prof` and `e.g` always have a stop, names follow `prof`, `the` opens sentences."""
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("ta", "so", "rin", "mu")]

    def sentence():
        w = [r.choice(words) for _ in range(r.randint(4, 9))]
        if r.random() < 0.3:
            w[2:2] = ["Prof.", r.choice(["Smith", "Jones", "Brown"])]
        if r.random() < 0.2:
            w[3:3] = ["e.g.", r.choice(words)]
        if r.random() < 0.2:
            w[1:1] = ["the"]
        first = "The" if r.random() < 0.5 else w.pop(0).capitalize()
        return " ".join([first, *w]) + r.choice([".", ".", ".", "!", "?"])

    return [" ".join(sentence() for _ in range(r.randint(2, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, 1, "x") for t in corpus()] + [(None, 1, "x"), ("", 1, "x"), (" \n", 1, "x"), ("Prof.", 1, "x"), ("a﷑b. ﷐ c", 1, "x")]
    return G.learn(spark.createDataFrame(rows, "text string, kind int, base string").repartition(4))


def split(spark, model, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.sentences for r in G.split_learned(df, model).orderBy("id").collect()]


def test_abbreviations_and_starters_are_found(model):
    assert {"prof", "e.g"} <= set(model.abbreviations)
    assert not set(model.abbreviations) & {"smith", "the"}
    assert "the" in model.starters and "smith" not in model.starters


def test_borders(spark, model):
    got = split(
        spark, model, "He left! then came back. 5 people saw it.", "We met Prof. Smith here. The end.", "Ask Prof. The others know.",
        "See e.g. bata. No.", 'He said "Stop." Then (really?) he went.', "Wait... what? Wait... What?", "No. 5 and J. S. Bach.", "", "   ", None, "xa  yb.  zc",
    )
    assert [len(s) if s is not None else None for s in got[:4]] == [3, 2, 2, 2]
    assert got[1][0] == "We met Prof. Smith here."
    assert got[4] == ['He said "Stop."', "Then (really?)", "he went."]
    assert got[5] == ["Wait... what?", "Wait...", "What?"]
    assert got[6][-1].endswith("J. S. Bach.")
    assert got[7] == got[8] == [] and got[9] is None
    assert got[10] == ["xa  yb.", "zc"]


def test_numbers_before_small_letters_stay(spark):
    model = G.Segmenter(collocations=("## january",))
    assert split(spark, model, "On 3. January it was 5. in all. At 7. Then.") == [["On 3. January it was 5. in all.", "At 7.", "Then."]]


def test_nothing_is_lost_or_moved(spark, model):
    texts = [*corpus(9, 20), "a﷑b. ﷐C d! ﷑ e.", "one " * 5000]
    for text, got in zip(texts, split(spark, model, *texts), strict=True):
        assert " ".join(got) == text.strip()


def test_chunks_by_learned_sentences(spark, model):
    df = spark.createDataFrame([(1, "We met Prof. Smith here. " * 30)], "id long, text string")
    chunks = [r.chunk_text for r in chunk_documents(df, 60, 0, segmenter=model).orderBy("chunk_id").collect()]
    assert set(chunks) == {"We met Prof. Smith here. We met Prof. Smith here."}


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "text string")
    assert G.learn(none) == G.Segmenter()
    assert G.learn(spark.createDataFrame([("a",), (None,)], "text string")) == G.Segmenter()
    assert split(spark, G.Segmenter(), "Aa bb. cc! Dd") == [["Aa bb.", "cc!", "Dd"]]


def test_a_table_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(G, "MAX_ENTRIES", 1)
    with pytest.raises(ValueError, match="entries"):
        G._entries(spark.createDataFrame([("a",), ("b",)], "entry string"))


def test_types_are_looked_for_in_distinct_tokens(spark):
    df = spark.createDataFrame([("A cat sat. A cat ran.",)] * 5, "text string").repartition(2)
    rows = {(r.base, r.prev): (r.n, r.kind) for r in G.pairs(df, "text").collect()}
    assert rows["cat", "A"] == (10, "cat") and rows["A", None] == (5, "a") and rows["A", "sat."] == (5, "a") and len(rows) == 5


@pytest.mark.parametrize("most", [0, 1])
def test_a_large_table_cuts_as_a_small_one(spark, model, monkeypatch, most):
    """With more entries than an expression takes, the sentences are the same."""
    learned = spark.createDataFrame([(t, 1, "x") for t in corpus()] + [(None, 1, "x"), ("Prof.", 1, "x")], "text string, kind int, base string")
    texts = [*corpus(9, 20), "On 3. January it was 5. in all. At 7. Then.", "We met Prof. Smith here. The end. J. S. Bach.", "e.g. a. Wait... No.",
             "a﷑b. ﷐C d! ﷑ e.", "", None, "Prof.", "Prof. The Prof. the Prof. The e.g. The"]
    rows = [(i // 2 if i % 3 else None, t) for i, t in enumerate(texts)] + [(0, texts[0])] * 3
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    few = G.learn(learned)
    want = [sorted(map(str, rows.collect())) for rows in (G.split_learned(df, few), G.pack_learned(df, few, 60))]
    monkeypatch.setattr(G, "MAX_ENTRIES", most)
    large = G.learn(learned)
    assert large.abbreviations is None and (large.starters is None) == (most == 0)
    entries = {(r.what, r.entry) for r in large.table.collect()}
    kept = dict(zip(G.KINDS, (few.abbreviations, few.starters, few.collocations), strict=True))
    assert entries == {(k, e) for k in G.KINDS for e in kept[k] if len(kept[k]) > most}
    got = [sorted(map(str, rows.collect())) for rows in (G.split_learned(df, large), G.pack_learned(df, large, 60))]
    assert got == want
    table = spark.createDataFrame([("collocation", "## january"), ("collocation", "j bach")], "what string, entry string")
    two = G.Segmenter(("prof",), ("the", "bach"), ("## january", "j bach"))
    apart = G.Segmenter(("prof",), ("the", "bach"), None, table)
    assert sorted(map(str, G.split_learned(df, apart).collect())) == sorted(map(str, G.split_learned(df, two).collect()))
    chunks = chunk_documents(df.withColumn("id", F.monotonically_increasing_id()), 60, 10, segmenter=large)
    assert chunks.count() == chunk_documents(df.withColumn("id", F.monotonically_increasing_id()), 60, 10, segmenter=few).count()
