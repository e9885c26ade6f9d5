"""The corpus pipeline: each stage works on all that the one before kept, and its decisions take effect.

Documents go where the toxicity model rejects them, where they are copies of one that stays, and
where they hold a benchmark item; personal data in the others is replaced by its kind; what is left
is encoded. All stages but the last return the columns of `documents` (`n_chars` follows the text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope import scratch
from pplscope.llm import bpe, decontam, pii, probminhash, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half, with a model of the labels on them."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return probminhash.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind."""
    clean = pii.redact(docs)
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text back."""
    coded = bpe.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"),
    )


STAGES = [
    ("toxicity", reject_toxic),
    ("near-dedup", keep_one_of_near_copies),
    ("decontamination", remove_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]
# The models and estimates of the stages have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written and read again; a stage's rows go when the next
    one's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch.new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
