"""Joins whose small or hot side is broadcast only after its size is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_ROWS = 200_000
MAX_BYTES = 64 * 1024 * 1024


def local_copy(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame | None:
    """`df` as a driver-built local table, or None when it is over either bound.

    Rows and bytes (as JSON) are added up on the executors first; only a table within both is collected.
    """
    size = F.octet_length(F.to_json(F.struct(*df.columns))) if df.columns else F.lit(0)
    rows, held = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    if rows > max_rows or held > max_bytes:
        return None
    probe = df.limit(max_rows + 1).toArrow()
    if probe.num_rows > max_rows or probe.nbytes > 2 * max_bytes:
        return None
    return df.sparkSession.createDataFrame(probe, schema=df.schema)


def small_side(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """`df` hinted for broadcast when it is within both bounds, else `df` for a shuffle join."""
    copy = local_copy(df, max_rows, max_bytes)
    return df if copy is None else F.broadcast(copy)


def pinned(df: DataFrame) -> DataFrame:
    """A top-n selection computed once: its rows as a local table when within both bounds."""
    copy = local_copy(df)
    return df if copy is None else copy


def lookup_with_hot_keys(
    big: DataFrame, table: DataFrame, keys: list[str], weight: str, spread: Column, hot: int = 4096
) -> DataFrame:
    """Left join of `big` to `table` (unique on `keys`) where a few keys may hold most of `big`.

    `weight` counts the rows of `big` per key. The `hot` heaviest keys go out by broadcast, a
    table of fixed size; any other key then holds at most 1/`hot` of `big`, so the shuffle join
    that looks up the rest is balanced. Rows already answered (and rows with null keys) are
    scattered over that shuffle by `spread` instead of piling up on their key.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    hottest = table.orderBy(F.desc(weight), *keys).limit(hot).select(
        *keys, F.struct(*values).alias("_hot")
    )
    rest = table.select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*values).alias("_rest"))
    answered = F.col("_hot").isNotNull() | F.col(keys[0]).isNull()
    return (
        big.join(F.broadcast(hottest), keys, "left")
        .withColumn("_salt", F.when(answered, F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
        .join(rest, [*keys, "_salt"], "left")
        .withColumn("_found", F.coalesce("_hot", "_rest"))
        .select(*big.columns, *[F.col(f"_found.{v}").alias(v) for v in values])
    )
