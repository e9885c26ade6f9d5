"""Documents to chunks, and documents to token windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from pplscope.functions import text as T
from pplscope.operators.columns import require_columns
from pplscope.operators.segmentation import Segmenter, pack_learned


def chunk_documents(
    df: DataFrame, chunk_size: int = 500, chunk_overlap: int = 100, id_col: str = "id", text_col: str = "text",
    segmenter: Segmenter | None = None,
) -> DataFrame:
    """Sentence-packed chunks, each (but a document's first) led by the end of the one before.

    Row-local from the scan on: no shuffle, and one evaluation of the packing per document. Sentences
    are cut by the plain rule, or as a learned `segmenter` tells.
    """
    require_columns(df, [id_col, text_col])
    named = df.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("_text"))
    if segmenter is None:
        cleaned = named.select("text_id", T.clean_text(F.col("_text")).alias("_clean"))
        packed = cleaned.select("text_id", T.pack_text(F.col("_clean"), chunk_size).alias("bases"))
    else:
        packed = pack_learned(named, segmenter, chunk_size, "_text", "bases").select("text_id", "bases")
    pieces = packed.select("text_id", F.posexplode(T.with_previous(F.col("bases"))).alias("chunk_id", "piece"))
    overlapped = pieces.select(
        "text_id", "chunk_id", F.col("piece.base").alias("base"),
        T.chunk_overlap_text(F.col("piece.prev"), chunk_overlap).alias("overlap"),
    )
    return overlapped.select(
        "text_id", "chunk_id",
        F.concat("overlap", "base").alias("chunk_text"),
        F.length("overlap").alias("new_start"),
        (F.length("overlap") + F.length("base")).alias("new_end"),
    )


def base_chunks(df: DataFrame, chunk_size: int = 500, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Packed chunks without overlap."""
    return chunk_documents(df, chunk_size, 0, id_col, text_col).select("text_id", "chunk_id", "chunk_text")


def overlap_chunks(bases: DataFrame, chunk_overlap: int = 100) -> DataFrame:
    """Add the overlap to chunks that are already one row each (`text_id, chunk_id, chunk_text`)."""
    prev = previous_chunk(bases).withColumn("overlap", T.chunk_overlap_text(F.col("previous"), chunk_overlap))
    return prev.select(
        "text_id", "chunk_id",
        F.concat("overlap", "chunk_text").alias("chunk_text"),
        F.length("overlap").alias("new_start"),
        (F.length("overlap") + F.length("chunk_text")).alias("new_end"),
    )


CHUNKS_TOGETHER = 64


def previous_chunk(bases: DataFrame) -> DataFrame:
    """Text of the chunk before, within the document; null for the first.

    Chunks meet in runs of consecutive numbers, so that a document with very many chunks is spread over
    tasks; only the last of a run moves twice, as the one before the next run's first. Where a key
    repeats, each of its rows is paired with each row of the chunk before.
    """
    number, run = F.col("chunk_id"), F.floor(F.col("chunk_id") / CHUNKS_TOGETHER).cast("long")
    last = F.pmod(number, F.lit(CHUNKS_TOGETHER)) == CHUNKS_TOGETHER - 1
    sent = bases.withColumn("_run", F.explode(F.when(last, F.array(run, run + 1)).otherwise(F.array(run))))
    before = W.partitionBy("text_id", "_run").orderBy("chunk_id").rangeBetween(-1, -1)
    keyed = F.col("text_id").isNotNull() & number.isNotNull()
    # An array of structs, so that a null text counts as a row.
    found = F.when(keyed, F.collect_list(F.struct(F.col("chunk_text").alias("t"))).over(before))
    own = sent.withColumn("_before", found).where(number.isNull() | (F.col("_run") == run))
    return own.select(*bases.columns, F.explode_outer("_before").alias("_b")).select(*bases.columns, F.col("_b.t").alias("previous"))


def new_span(chunks: DataFrame) -> DataFrame:
    """The part of each chunk that is not overlap."""
    span = F.substring("chunk_text", F.col("new_start") + 1, F.col("new_end") - F.col("new_start"))
    return chunks.select("text_id", "chunk_id", span.alias("new_text"))


def recursive_chunks(df: DataFrame, chunk_size: int = 500, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Chunks by paragraph, then line, then full stop; no overlap."""
    require_columns(df, [id_col, text_col])
    return df.select(
        F.col(id_col).alias("text_id"),
        F.posexplode(T.recursive_pieces(F.col(text_col), chunk_size)).alias("chunk_id", "chunk_text"),
    )


def document_windows(
    df: DataFrame, ctx: int, stride: int, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """Token windows of at most `ctx` tokens that advance by `stride`.

    Window `window_id` starts the fresh tokens at `cur = window_id * stride` and reaches back
    `ctx - stride` tokens before it. No tokens: no window.
    """
    if not ctx >= stride > 0:
        raise ValueError("need ctx >= stride > 0")
    n = F.size(tokens_col)

    def window(cur):
        beg = F.greatest(F.lit(0), cur - (ctx - stride))
        end = F.least(n, cur + stride)
        return F.struct(
            cur.alias("cur"), beg.alias("beg"), end.alias("end"), n.alias("n_tokens"),
            F.slice(tokens_col, beg + 1, end - beg).alias("window_tokens"),
        )

    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)))
    # Cut before exploding, so that an exploded row carries its window and not the document.
    return df.select(id_col, F.posexplode(F.transform(starts, window)).alias("window_id", "w")).select(
        id_col, "window_id", "w.*"
    )


WINDOWS_TOGETHER = 64


def spread_windows(
    df: DataFrame, ctx: int, stride: int, partitions: int | None = None, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """`document_windows`, dealt out by runs of windows: for documents too long for one task.

    Tokens are cut once into the stretches that `WINDOWS_TOGETHER` windows need: their fresh tokens and
    the context of the first. Stretches are dealt out, and windows cut from them where they arrive. What a
    task holds of a document is a stretch. A document without tokens (or with null) gets one window without
    tokens. Ids are unique; should they not be, windows are gathered block by block from all their rows.
    """
    if not ctx >= stride > 0:
        raise ValueError("need ctx >= stride > 0")
    if not df.groupBy(id_col).count().where("count > 1").isEmpty():
        return _gathered_windows(df, ctx, stride, partitions, id_col, tokens_col)
    back = ctx - stride
    fresh = WINDOWS_TOGETHER * stride
    n = F.greatest(F.coalesce(F.size(tokens_col), F.lit(0)), F.lit(0))
    rows = df.select(id_col, n.alias("n_tokens"), F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias("_tokens"))

    def stretch(s):
        beg = F.greatest(F.lit(0), s * fresh - back)
        return F.struct(beg.alias("beg"), F.slice("_tokens", beg + 1, (s + 1) * fresh - beg).alias("tokens"))

    runs = F.sequence(F.lit(0), F.expr(f"greatest(n_tokens - 1, 0) div {fresh}").cast("int"))
    stretches = rows.select(id_col, "n_tokens", F.posexplode(F.transform(runs, stretch)).alias("_run", "_s"))
    dealt = stretches.repartition(*([partitions] if partitions else []), id_col, "_run")

    def window(window_id):
        cur = window_id * stride
        beg, end = F.greatest(F.lit(0), cur - back), F.least(F.col("n_tokens"), cur + stride)
        return F.struct(
            window_id.alias("window_id"), cur.alias("cur"), beg.alias("beg"), end.alias("end"), F.col("n_tokens"),
            F.slice(F.col("_s.tokens"), beg - F.col("_s.beg") + 1, end - beg).alias("window_tokens"),
        )

    first = F.col("_run") * WINDOWS_TOGETHER
    last = F.least(first + WINDOWS_TOGETHER - 1, F.expr(f"greatest(n_tokens - 1, 0) div {stride}").cast("int"))
    return dealt.select(id_col, F.explode(F.transform(F.sequence(first, last), window)).alias("w")).select(id_col, "w.*")


def _gathered_windows(
    df: DataFrame, ctx: int, stride: int, partitions: int | None, id_col: str, tokens_col: str
) -> DataFrame:
    """`spread_windows` by blocks of `stride`, which go to their own window and to those behind it that reach
    back to them, all rows of an id together."""
    reach = -(-(ctx - stride) // stride)
    n = F.coalesce(F.size(tokens_col), F.lit(0))
    last = F.expr(f"greatest(_n - 1, 0) div {stride}").cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(tokens_col, b * stride + 1, F.lit(stride)))
    rows = df.select(id_col, F.greatest(n, F.lit(0)).alias("_n"), F.coalesce(F.col(tokens_col), F.array().cast("array<string>")).alias(tokens_col))
    blocks = rows.select(id_col, "_n", last.alias("_last"), F.posexplode(cut).alias("_block", "_tokens"))
    sent = blocks.withColumn("window_id", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + reach, F.col("_last")))))
    dealt = sent.repartition(*([partitions] if partitions else []), id_col, "window_id")
    gathered = dealt.groupBy(id_col, "window_id").agg(
        F.max("_n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("_block", "_tokens"))).alias("_blocks")
    )
    cur = F.col("window_id") * stride
    beg, end = F.greatest(F.lit(0), cur - (ctx - stride)), F.least(F.col("n_tokens"), cur + stride)
    first = F.greatest(F.lit(0), F.col("window_id") - reach) * stride
    return gathered.select(
        id_col, "window_id", cur.alias("cur"), beg.alias("beg"), end.alias("end"), "n_tokens",
        F.slice(F.flatten(F.col("_blocks._tokens")), beg - first + 1, end - beg).alias("window_tokens"),
    )


def stitch_windows(df: DataFrame, mode: str = "fresh", id_col: str = "doc_id") -> DataFrame:
    """Window scores back to one row per document, in token order.

    Input: `window_id, cur, beg, n_tokens, scores`, where `scores` has one entry per window
    token and a token without a score is null. `fresh` keeps the entries at or after `cur`;
    `concat` keeps every scored entry of every window and cuts the result to `n_tokens`.
    """
    if mode not in ("fresh", "concat"):
        raise ValueError(f"unknown mode {mode!r}")
    from_entry = F.col("cur") - F.col("beg") if mode == "fresh" else F.lit(0)
    part = F.filter(
        F.slice("scores", from_entry + 1, F.greatest(F.size("scores") - from_entry, F.lit(0))),
        lambda s: s.isNotNull(),
    )
    gathered = df.select(id_col, "window_id", "n_tokens", part.alias("part")).groupBy(id_col).agg(
        F.max("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("window_id", "part"))).alias("parts"),
    )
    whole = F.flatten(F.col("parts.part"))
    return gathered.select(id_col, F.slice(whole, F.lit(1), F.col("n_tokens")).alias("scores"))
