"""Counts, summaries and histograms."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, functions as F

from pplscope.bounded import small_side


def text_count(df: DataFrame) -> DataFrame:
    """Number of distinct texts, nulls not counted."""
    return df.agg(F.count_distinct("text_id").alias("n_texts"))


def chunks_per_text(df: DataFrame) -> DataFrame:
    """Chunks of each text (texts without id left out)."""
    return df.where(F.col("text_id").isNotNull()).groupBy("text_id").agg(F.count(F.lit(1)).alias("n_chunks"))


def mean_chunks_per_text(df: DataFrame) -> DataFrame:
    """Mean of `chunks_per_text`."""
    return chunks_per_text(df).agg(F.avg("n_chunks").alias("mean_chunks"))


def top_texts(df: DataFrame, n: int = 5) -> DataFrame:
    """The `n` texts with most chunks, ties by smallest id."""
    return chunks_per_text(df).orderBy(F.desc("n_chunks"), "text_id").limit(n)


def run_summary(results: DataFrame, logprobs: str = "logprobs") -> DataFrame:
    """Rows and scored tokens of a result table."""
    return results.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(F.size(logprobs).cast("long")), F.lit(0).cast("long")).alias("n_tokens"),
    )


def timed_write(results: DataFrame, write, logprobs: str = "logprobs") -> dict:
    """Run `write(results)` and return rows, tokens and tokens per second of that same pass."""
    seen = Observation()
    started = time.time()
    write(
        results.observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.sum(F.size(logprobs).cast("long")).alias("n_tokens")
        )
    )
    seconds = time.time() - started
    counts = seen.get
    tokens = counts["n_tokens"] or 0
    return {"n_rows": counts["n_rows"], "n_tokens": tokens, "seconds": seconds, "tokens_per_sec": tokens / seconds}


def chunk_length_stats(chunks: DataFrame) -> DataFrame:
    """Mean chunk length in characters."""
    return chunks.agg(F.avg(F.length("chunk_text")).alias("mean_length"))


def longest_chunks(chunks: DataFrame, n: int = 5) -> DataFrame:
    """The `n` longest chunks, ties by key."""
    lengths = chunks.select("text_id", "chunk_id", F.length("chunk_text").alias("chunk_length"))
    return lengths.orderBy(F.desc("chunk_length"), "text_id", "chunk_id").limit(n)


def density_histogram(df: DataFrame, col: str, bins: int = 50, by: str | None = None) -> DataFrame:
    """`bins` equal bins over each group's own range, the last one closed; empty bins included.

    `bin, lower, upper, n, density`, where density = n / (group size × width). A group with one
    single value gets a range of half a unit either side.

    Two combining aggregates over `df`: its range per group, then its counts per bin.
    """
    group = F.lit("all") if by is None else F.col(by)
    values = df.select(group.alias("_by"), F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    low, high = F.min("_v"), F.max("_v")
    half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    ranges = small_side(
        values.groupBy("_by").agg(
            (low - half).alias("_low"), (high + half).alias("_high"), F.count(F.lit(1)).alias("_total")
        )
    )

    position = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * float(bins)) + 1
    counts = (
        values.join(ranges, "_by")
        .select("_by", F.least(position, F.lit(bins)).cast("int").alias("bin"))
        .groupBy("_by", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    return filled_bins(ranges, counts, bins, by)


def filled_bins(ranges: DataFrame, counts: DataFrame, bins: int, by: str | None) -> DataFrame:
    """The columns of `density_histogram` from each group's range (`_by, _low, _high, _total`) and the counts
    of the bins that have any (`_by, bin, n`)."""

    def edge(i: Column) -> Column:
        return F.col("_low") + (F.col("_high") - F.col("_low")) * i / float(bins)

    grid = ranges.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("_high") - F.col("_low")) / float(bins)
    filled = grid.join(counts, ["_by", "bin"], "left").select(
        F.col("_by").alias(by or "_by"), "bin",
        edge(F.col("bin") - 1).alias("lower"), edge(F.col("bin")).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        (F.coalesce("n", F.lit(0)) / (F.col("_total") * width)).alias("density"),
    )
    return filled if by else filled.drop("_by")
