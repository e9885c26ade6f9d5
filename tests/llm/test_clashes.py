"""Columns of the input that have the names an operator uses inside come through as they are."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pplscope.llm import decontam, pii, probminhash, toxicity

NAMES = ["_text", "_toxicity", "text_", "_key", "_label", "label", "key", "_id", "_first", "id", "row", "c0", "c1", "found_id", "found_key", "first_key", "times", "_hits_email", "a.b", "toxicity"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "mail me at ann@example.org about the seven green boats that left the harbour"
    rows = [(1, text), (2, text), (None, "other words altogether " * 8), (4, None), (5, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "*", *[F.concat_ws("-", F.lit(n), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(n) for n in NAMES]
    )


def unharmed(got, docs):
    assert got.columns == docs.columns
    for row in got.collect():
        assert [row[n] for n in NAMES] == [f"{n}-{row['doc_id'] or 0}" for n in NAMES]
    return sorted(r["doc_id"] or 0 for r in got.collect())


def test_near_dedup(docs):
    assert unharmed(probminhash.keep_one(docs), docs) == [0, 1, 4, 5]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, "mail me at ann@example.org about the seven green boats that left the harbour", "x")], "item_id long, text string, _key string")
    assert unharmed(decontam.drop_contaminated(docs, items), docs) == [0, 4, 5]


def test_redaction(docs):
    got = pii.redact(docs)
    assert unharmed(got, docs) == [0, 1, 2, 4, 5]
    assert "<EMAIL>" in got.where("doc_id = 1").first()["text"]


def test_toxicity(docs):
    model = toxicity.fit(["bad vile words here", "good kind words there"] * 20, [1, 0] * 20)
    assert set(unharmed(toxicity.reject(docs, model, 1.1), docs)) == {0, 1, 2, 4, 5}
    scored = toxicity.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and scored.select("_toxicity.score").count() == 5
