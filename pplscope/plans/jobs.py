"""The jobs a user runs: chunk a corpus, score it, inspect results, analyse models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope.operators import perplexity as P, regression as R, selection as S, similarity as V, stats
from pplscope.operators.chunking import chunk_documents, recursive_chunks
from pplscope.operators.columns import require_columns, resolve_text_column
from pplscope.operators.identity import SCAN_ORDER, dedup_keep_first
from pplscope.operators.segmentation import learn
from pplscope.operators.scoring import Scorer, ngram_ppl, score_chunks, score_documents
from pplscope.scratch import materialize
from pplscope.sinks import writers
from pplscope.sources.parquet import first_in_scan, limited_prompts, scan_glob, scan_parquet, stream_prompts
from pplscope.sources.responses import scan_responses_csv, scan_results


def chunk_corpus(
    spark: SparkSession, input_parquet: str, output_dir: str, chunk_size: int = 500, chunk_overlap: int = 100,
    recursive: bool = False, mode: str = "errorifexists", partitions: int | None = None, learned: bool = False,
) -> DataFrame:
    """Documents to a written chunk table, plus a readable sample of its first chunks.

    `partitions` deals the documents out that many ways; `learned` cuts sentences by what the documents
    themselves show.
    """
    documents = require_columns(scan_parquet(spark, input_parquet, with_order=True, partitions=partitions), ["id", "text"])
    unique = dedup_keep_first(documents.select("id", "text", *SCAN_ORDER), "id", SCAN_ORDER)
    borders = learn(unique) if learned else None
    chunks = (
        recursive_chunks(unique, chunk_size) if recursive
        else chunk_documents(unique, chunk_size, chunk_overlap, segmenter=borders)
    )
    path = f"{output_dir}/chunked_texts"
    writers.write_chunks(chunks, path, mode)
    written = spark.read.parquet(path)
    writers.write_chunk_sample(written, f"{output_dir}/sample_chunks", mode=mode)
    return written


def score_corpus(
    spark: SparkSession, dataset: str, output: str, make_scorer: Callable[[], Scorer],
    prompt_column: str = "chunk_text", limit: int = 0, partitions: int | None = None,
    max_records: int | None = None, mode: str = "errorifexists",
) -> dict:
    """Chunk table to written log-probs; returns rows, tokens and tokens per second."""
    chunks = require_columns(first_in_scan(spark, dataset, limit), ["text_id", "chunk_id", prompt_column])
    results = score_chunks(chunks, make_scorer, prompt_column, partitions=partitions)
    return stats.timed_write(results, lambda df: writers.write_results(df, output, max_records, mode))


def score_folder(
    spark: SparkSession, data_dir: str, pattern: str, output: str, make_scorer: Callable[[], Scorer],
    ctx: int, stride: int, limit: int | None = None, batch: int = 4, exact: bool = False,
    stitch: str = "fresh", mode: str = "errorifexists", partitions: int | None = None,
) -> dict:
    """Whole documents of a folder to written log-probs and tokens, in token windows."""
    if limit:
        prompts = limited_prompts(spark, data_dir, pattern, limit, batch, exact)
    else:
        prompts = stream_prompts(scan_glob(spark, data_dir, pattern))
    results = score_documents(prompts, make_scorer, ctx, stride, stitch, partitions=partitions)
    return stats.timed_write(results, lambda df: writers.write_doc_results(df, output, mode=mode), "prompt_logprobs")


def inspect_results(results: DataFrame) -> dict[str, DataFrame]:
    """Columns, number of texts, mean chunks per text, texts with most chunks."""
    spark = results.sparkSession
    return {
        "columns": spark.createDataFrame([(c,) for c in results.columns], "column string"),
        "texts": stats.text_count(results),
        "mean_chunks": stats.mean_chunks_per_text(results),
        "top_texts": stats.top_texts(results),
    }


def analyse_models(
    spark: SparkSession, result_paths: list[str], response_paths: list[str], chunks: DataFrame,
    embeddings: DataFrame | None = None, file_to_model: dict[str, str] | None = None, seed: int | str = 0,
    response_to_model: dict[str, str] | None = None, make_encoder=None,
) -> dict[str, object]:
    """From result and response files to scores, selections, comparisons and the regression.

    The maps name models by file where the file's name does not. Selections are compared by ready
    `embeddings`, or by those `make_encoder` gives their texts.

    Perplexities and scores are written once; everything after reads those narrow tables.
    """
    ppl = materialize(P.results_to_ppl(scan_results(spark, result_paths, file_to_model)), "ppl")
    accuracy = P.model_accuracy(scan_responses_csv(spark, response_paths, response_to_model))
    scores = materialize(P.gamma(ppl, accuracy), "gamma")
    top = S.with_rank(S.top_gamma(scores, 20))
    out: dict[str, object] = {
        "ppl": ppl,
        "accuracy": accuracy,
        "gamma": scores,
        "curve": S.gamma_curve(scores),
        "top": S.lookup_texts(top, chunks, resolve_text_column(chunks)),
        "regression": R.loo_predictions(ppl, accuracy, start=R.screen_features(scores, 500)),
    }
    if embeddings is not None:
        for side in ("top", "bottom"):
            out[f"compare_{side}"] = V.compare_sets(scores, embeddings, seed=seed, side=side)
    elif make_encoder is not None:
        text = resolve_text_column(chunks)
        for side in ("top", "bottom"):
            out[f"compare_{side}"] = V.compare_texts(scores, chunks, make_encoder, seed=seed, side=side, text_col=text)
    return out


def top_quality_chunks(
    documents: DataFrame, responses: DataFrame, training: DataFrame, models: list[str], n: int = 20
) -> DataFrame:
    """Which chunks track model quality? `documents` (id, text) are chunked, scored by one
    bigram model per name trained on `training` (model, text), and ranked by score against the
    accuracies in `responses`.

    The accuracies and the selection, a few rows each, are written, as they are read several times and what
    they are made of is not."""
    chunks = materialize(chunk_documents(documents, chunk_overlap=0), "chunks", "zstd")
    accuracy = materialize(P.model_accuracy(responses), "accuracy")
    scores = P.gamma(ngram_ppl(training, chunks, models), accuracy, models)
    top = materialize(S.with_rank(S.top_gamma(scores, n)), "top")
    found = S.lookup_texts(top, chunks)
    return found.select("rank", "text_id", "chunk_id", F.round("gamma", 6).alias("gamma"), "chunk_text")
