"""Pick chunks by score, look their texts up, draw random controls, write the report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from pplscope.bounded import pinned, small_side
from pplscope.functions.text import strip
from pplscope.operators.identity import dense_index

KEYS = ["text_id", "chunk_id"]


def top_gamma(gamma: DataFrame, n: int) -> DataFrame:
    """`n` highest scores, ties by key, missing scores only when nothing else is left."""
    return gamma.orderBy(F.desc_nulls_last("gamma"), *KEYS).limit(n)


def bottom_gamma(gamma: DataFrame, n: int) -> DataFrame:
    """`n` lowest scores, ties by key, missing scores only when nothing else is left."""
    return gamma.orderBy(F.asc_nulls_last("gamma"), *KEYS).limit(n)


def with_rank(selection: DataFrame, ascending: bool = False) -> DataFrame:
    """Number a selection 1…n in its own order. Meant for the n rows of a top-n only."""
    by_gamma = F.asc_nulls_last("gamma") if ascending else F.desc_nulls_last("gamma")
    return selection.withColumn("rank", F.row_number().over(W.orderBy(by_gamma, *KEYS)))


def gamma_curve(gamma: DataFrame) -> DataFrame:
    """Every chunk with its rank by falling score, missing scores last."""
    return dense_index(gamma, [F.desc_nulls_last("gamma"), *KEYS], name="rank", start=1)


def lookup_texts(selection: DataFrame, chunks: DataFrame, text_col: str = "chunk_text") -> DataFrame:
    """Texts of a top-n selection, in selection order; a key without a text raises.

    The selection is computed once and, within the broadcast bounds, the chunk table is only
    streamed past it.
    """
    selection = pinned(selection)
    texts = chunks.select(*KEYS, F.col(text_col).alias("chunk_text"))
    found = texts.join(small_side(selection.select(*KEYS)), KEYS).withColumn("_found", F.lit(True))
    missing = F.raise_error(F.concat_ws("/", F.lit("no chunk with key"), *KEYS)).cast("string")
    return (
        selection.join(found, KEYS, "left")
        .withColumn("chunk_text", F.when(F.col("_found"), F.col("chunk_text")).otherwise(missing))
        .drop("_found")
        .orderBy("rank")
    )


def complement(df: DataFrame, selection: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of `df` outside a selection."""
    keys = KEYS if keys is None else keys
    return df.join(small_side(selection.select(*keys)), keys, "left_anti")


def random_control(
    df: DataFrame, exclude: DataFrame, n: int, seed: int | str = 0, keys: list[str] | None = None
) -> DataFrame:
    """`n` rows outside `exclude`, chosen by a seeded hash of their keys; raises when fewer remain.

    A repeatable draw without replacement: the `n` smallest hashes, as a top-n.
    """
    keys = KEYS if keys is None else keys
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    drawn = complement(df, exclude, keys).orderBy(draw, *keys).limit(n)
    # The n drawn rows as one array, so that the check also sees an empty draw.
    gathered = drawn.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    enough = F.when(F.size("rows") == n, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit(f"asked for {n} control rows, left: "), F.size("rows").cast("string"))).cast(
            gathered.schema["rows"].dataType
        )
    )
    return gathered.select(F.explode(enough).alias("row")).select("row.*")


def chunk_sample_text(chunks: DataFrame, n: int = 20, legacy: bool = False) -> DataFrame:
    """One `value` per sampled chunk, to be written as text: the first `n` chunks by key."""
    first = chunks.orderBy(*KEYS).limit(n)
    # The two layouts.
    if legacy:
        value = F.format_string(
            "[text_id=%s | chunk_id=%s]\n%s\n",
            F.col("text_id").cast("string"), F.col("chunk_id").cast("string"), strip(F.col("chunk_text")),
        )
    else:
        new = F.substring("chunk_text", F.col("new_start") + 1, F.col("new_end") - F.col("new_start"))
        value = F.format_string(
            "[id=%s | chunk=%s]\n⋯full⋯ %s\n⋯new⋯  %s\n",
            F.col("text_id").cast("string"), F.col("chunk_id").cast("string"), F.col("chunk_text"), new,
        )
    return first.select(*KEYS, value.alias("value"))


def top_chunk_report(selected: DataFrame, label: str = "chunk_index") -> DataFrame:
    """One `value` per selected chunk, in selection order, to be written as text."""
    # Fixed value: the layout.
    value = F.format_string("=== Chunk %s ===\n%s\n", F.col(label).cast("string"), strip(F.col("chunk_text")))
    return selected.select("rank", value.alias("value")).orderBy("rank")
