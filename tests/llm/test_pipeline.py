"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline as P
from pplscope.llm import decontam, probminhash, toxicity

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_and_columns(spark, docs):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near-dedup", "decontamination", "pii", "bpe"]
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, D).dtypes == docs.dtypes


def test_decisions(spark, docs):
    model = toxicity.train(docs, spark.read.parquet(f"{D}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("_toxicity.score >= 0.5").collect()}
    assert ids(P.reject_toxic(spark, docs, D)) == ids(docs) - rejected
    firsts = {r.class_id for r in probminhash.classify(docs).collect()}
    assert ids(P.keep_one_of_near_copies(spark, docs, D)) == firsts
    leaking = ids(decontam.leaks(docs, spark.read.parquet(f"{D}/benchmark.parquet")))
    assert ids(P.remove_contaminated(spark, docs, D)) == ids(docs) - leaking
    clean = {r.doc_id: r for r in P.redact_personal_data(spark, docs, D).collect()}
    assert set(clean) == ids(docs) and all(r.n_chars == len(r.text) and "@mail" not in r.text for r in clean.values())


def test_run(spark, docs):
    rows = P.run(spark, D).collect()
    assert 0 < len(rows) < docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    own = {hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}
    assert sum(r.text_sha256 in own for r in rows) > 0.8 * len(rows)
