"""Result, chunk and report writers. Every task writes its own files; Spark commits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pplscope.operators.selection import chunk_sample_text, top_chunk_report

RESULTS = {"text_id": "int", "chunk_id": "int", "logprobs": "array<float>"}
DOC_RESULTS = {"doc_id": "long", "prompt_logprobs": "array<float>", "decoded_tokens": "array<string>"}
CHUNKS = {
    "text_id": "long", "chunk_id": "int", "chunk_text": "string", "new_start": "int", "new_end": "int",
}
PLAIN_CHUNKS = {k: CHUNKS[k] for k in ("text_id", "chunk_id", "chunk_text")}


def _write(df: DataFrame, path: str, types: dict[str, str], max_records: int | None, mode: str) -> None:
    # ANSI casts raise on ids that do not fit.
    writer = df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()]).write.mode(mode)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.parquet(path)


def write_results(df: DataFrame, path: str, max_records: int | None = None, mode: str = "errorifexists") -> None:
    """Chunk results; `max_records` bounds the rows of a file."""
    _write(df, path, RESULTS, max_records, mode)


def write_doc_results(df: DataFrame, path: str, max_records: int | None = None, mode: str = "errorifexists") -> None:
    """Whole-document results with their tokens."""
    _write(df, path, DOC_RESULTS, max_records, mode)


def write_chunks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Chunk table, with spans when it has them; an empty corpus still gets its columns."""
    _write(df, path, CHUNKS if "new_start" in df.columns else PLAIN_CHUNKS, None, mode)


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The `value` column as text, in the order of the (already limited) rows, as one file."""
    df.select("value").coalesce(1).write.mode(mode).text(path)


def write_chunk_sample(chunks: DataFrame, path: str, n: int = 20, mode: str = "errorifexists") -> None:
    """Readable sample of the first `n` chunks."""
    legacy = "new_start" not in chunks.columns
    write_lines(chunk_sample_text(chunks, n, legacy), path, mode)


def write_top_report(selected: DataFrame, path: str, label: str = "chunk_index", mode: str = "errorifexists") -> None:
    """Readable report of a top-n selection, best first."""
    write_lines(top_chunk_report(selected, label), path, mode)
