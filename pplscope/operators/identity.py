"""Row identity: keep-first dedup, positions, limits and contiguous slices."""

from __future__ import annotations

import functools
import operator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from pplscope.bounded import local_copy, lookup_with_hot_keys
from pplscope.scratch import materialize

Order = list[str | Column]

SCAN_ORDER = ["_file", "_row"]
SCAN_BLOCK = 1 << 14
MAX_SPLITS = 1 << 20
# Bits of one bitmap aggregate.
ROWS_PER_BITMAP = 1 << 15


def dedup_keep_first(
    df: DataFrame, key: str | list[str], order: list[str], max_repeated: int = 500_000, max_blocks: int = 1 << 14
) -> DataFrame:
    """One row per key, the first in `order` (which must be unique); null keys count as equal.

    Only the key and order columns are read to find the repeated keys. While those are few, the wide
    rows are filtered where they are, by a broadcast of the repeated keys. Otherwise, for rows in scan
    order, the losing rows are marked in bitmaps per block of a file, and these are broadcast, at most
    `max_blocks` at a time. Either way wide rows are neither shuffled nor sorted. Only rows with many
    repeats and another order go through a combining aggregate.
    """
    keys = [key] if isinstance(key, str) else list(key)
    position = F.struct(*order)
    repeated = materialize(
        df.groupBy(*keys)
        .agg(F.min(position).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_first", "_n"),
        "repeated",
    )
    few = local_copy(repeated.drop("_n"), max_rows=max_repeated)
    if few is None and list(order) == SCAN_ORDER:
        return _without(df, _losers(df, keys, repeated), max_blocks)
    if few is None:
        return (
            df.groupBy(*keys)
            .agg(F.min_by(F.struct(*df.columns), position).alias("_kept"))
            .select("_kept.*")
        )
    if few.isEmpty():
        return df
    match = functools.reduce(
        operator.and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    )
    return (
        df.join(F.broadcast(few), match, "left")
        .where(F.col("_first").isNull() | (position == F.col("_first")))
        .select(*df.columns)
    )


def _losers(df: DataFrame, keys: list[str], repeated: DataFrame) -> DataFrame:
    """(_hash, _block, _bits): the rows of repeated keys that are not the first, a bitmap per block of a file.

    What moves is narrow: 128 bits of the key and the row's place. Keys that very many rows share are
    answered by broadcast.
    """

    def named(columns: list[str]) -> list[Column]:
        parts = [part for c in columns for part in (F.col(c), F.col(c).isNull())]
        return [F.xxhash64(*parts).alias("_a"), F.xxhash64(F.lit(1), *parts).alias("_b")]

    rows = df.select(*named(keys), F.xxhash64("_file").alias("_hash"), "_row")
    firsts = repeated.select(
        *named([f"_k{i}" for i in range(len(keys))]), F.xxhash64("_first._file").alias("_first_hash"),
        F.col("_first._row").alias("_first_row"), "_n",
    )
    found = lookup_with_hot_keys(rows, firsts, ["_a", "_b"], "_n", spread=F.struct("_hash", "_row"))
    lost = found.where((F.col("_first_row") != F.col("_row")) | (F.col("_first_hash") != F.col("_hash")))
    return materialize(
        lost.groupBy("_hash", F.expr(f"_row div {ROWS_PER_BITMAP}").alias("_block"))
        .agg(F.bitmap_construct_agg(F.pmod(F.col("_row"), F.lit(ROWS_PER_BITMAP))).alias("_bits")),
        "losers",
    )


def _without(df: DataFrame, losers: DataFrame, max_blocks: int) -> DataFrame:
    """`df` without the rows marked in the bitmaps; files are dealt over as many scans as keep each broadcast in bound."""
    parts = max(1, -(-losers.count() // max_blocks))
    place = F.pmod(F.col("_row"), F.lit(ROWS_PER_BITMAP))
    byte = F.conv(F.hex(F.substring("_bits", F.expr(f"pmod(_row, {ROWS_PER_BITMAP}) div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.expr("1").cast("int").bitwiseAND(F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int"))) == 1

    def one(i: int) -> DataFrame:
        here = F.pmod(F.xxhash64("_file"), F.lit(parts)) == i
        rows = df if parts == 1 else df.where(here)
        bits = losers if parts == 1 else losers.where(F.pmod("_hash", F.lit(parts)) == i)
        bits = bits.select(F.col("_hash").alias("_file_hash"), F.col("_block").alias("_row_block"), "_bits")
        match = (F.xxhash64("_file") == F.col("_file_hash")) & (F.expr(f"_row div {ROWS_PER_BITMAP}") == F.col("_row_block"))
        return rows.join(F.broadcast(bits), match, "left").where(F.col("_bits").isNull() | ~marked).select(*df.columns)

    return functools.reduce(DataFrame.unionByName, [one(i) for i in range(parts)])


def dense_index(df: DataFrame, order: Order, name: str = "index", start: int = 0) -> DataFrame:
    """Position of each row in `order`, counted from `start`, without a global window.

    Rows are range-partitioned and sorted, written once with their place inside the partition,
    and shifted by the sizes of the partitions before theirs. `order` should end in a unique
    key so that a repeated task gives the same places.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()})
        # The low 33 bits count rows inside the partition.
        .withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))),
        "index",
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    # One row per partition: bounded by the number of shuffle partitions, not by the data.
    shift = placed.groupBy("_part").count().select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift")
    )
    return placed.join(F.broadcast(shift), "_part").select(
        *df.columns, (F.col("_shift") + F.col("_place") + F.lit(start)).alias(name)
    )


def scan_index(df: DataFrame, keep: Column, name: str = "doc_id", block: int = SCAN_BLOCK) -> DataFrame:
    """Rows where `keep` holds, numbered 0, 1, 2… in scan order (`_file`, then `_row`).

    Rows straight from a file scan are numbered where they are read, in two passes: the first counts the
    kept rows of every split of a file, narrow; their sums, one row per split, are broadcast to the
    second, where a row's number is its split's sum and its place in the split. Nothing else moves.

    Rows that come from elsewhere, or from more splits than can be broadcast, are numbered by blocks.
    """
    kept = df.where(F.coalesce(keep, F.lit(False)))
    try:
        placed = kept.select("*", F.col("_metadata.file_block_start").alias("_split"))
        sums = _split_sums(placed)
    except AnalysisException:
        sums = None
    if sums is None:
        return _block_index(kept, df.columns, name, block)
    here = placed.withColumns({"_task": F.spark_partition_id(), "_at": _place_in_task(), "_hash": F.xxhash64("_file")})
    joined = here.join(F.broadcast(sums), ["_task", "_hash", "_split"], "left")
    # Both passes plan the same scan; were they to differ, no row would get a wrong number.
    number = F.coalesce(F.col("_sum") + F.col("_at"), F.raise_error(F.lit("the two passes were split differently")).cast("long"))
    return joined.select(number.alias(name), *[c for c in df.columns if c != name])


def _place_in_task() -> Column:
    """Rows before this one in its partition: the low 33 bits of the id."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _split_sums(placed: DataFrame) -> DataFrame | None:
    """(_task, _hash, _split, _sum): what to add to a row's place in its task, for each split of a scan; the
    tasks read a split in row order. None when there are more than can be broadcast, or a task has two runs of one split."""
    counted = (
        placed.select("_file", "_row", "_split", F.spark_partition_id().alias("_task"), _place_in_task().alias("_at"))
        .groupBy("_task", "_file", "_split")
        .agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min("_row").alias("_low"))
    )
    counted = local_copy(counted, MAX_SPLITS, MAX_SPLITS * 256)
    if counted is None or not counted.where("_last - _first + 1 <> _n").isEmpty():
        return None
    # One row per split of the input, bounded above: numbered in one task.
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file", "_split", "_low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return counted.select("_task", F.xxhash64("_file").alias("_hash"), "_split", (before - F.col("_first")).alias("_sum"))


def _block_index(kept: DataFrame, columns: list[str], name: str, block: int) -> DataFrame:
    """Numbers by blocks of rows: kept rows are counted per block of a file and the counts added up, within
    a file over its blocks, then over files. What meets in one task is a block, or the blocks of one file."""
    kept = kept.withColumn("_block", F.expr(f"_row div {block}"))
    counts = kept.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    files = counts.groupBy("_file").agg(F.sum("_n").alias("_n"))
    files_before = F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(files_before, F.lit(0)).alias("_files_before"))
    blocks = counts.withColumn("_blocks_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(files, "_file")
    place = F.row_number().over(W.partitionBy("_file", "_block").orderBy("_row")) - 1
    number = (F.col("_files_before") + F.col("_blocks_before") + place).cast("long")
    return kept.join(blocks, ["_file", "_block"]).withColumn(name, number).select(name, *[c for c in columns if c != name])


def head_n(df: DataFrame, n: int, order: Order) -> DataFrame:
    """First `n` rows in `order`."""
    return df.orderBy(*order).limit(n)


def debug_limit(df: DataFrame, n: int, order: Order) -> DataFrame:
    """First `n` rows when `n` is positive, else every row."""
    return head_n(df, n, order) if n > 0 else df


def doc_limit(df: DataFrame, limit: int | None, batch: int, exact: bool = False) -> DataFrame:
    """Documents numbered below `limit`, rounded up to whole batches unless `exact`."""
    if not limit:
        return df
    bound = limit if exact else -(-limit // batch) * batch
    return df.where(F.col("doc_id") < bound)


def balanced_slices(df: DataFrame, k: int, order: Order, name: str = "slice") -> DataFrame:
    """Contiguous slices 0…k-1 in `order`; the first `n mod k` slices hold one row more.

    Raises when a slice would be empty.
    """
    indexed = dense_index(df, order, "_index")
    n = indexed.count()
    if n < k:
        raise ValueError(f"{n} rows cannot fill {k} slices")
    size, longer = divmod(n, k)
    edge = longer * (size + 1)
    return indexed.withColumn(
        name,
        F.when(F.col("_index") < edge, F.expr(f"_index div {size + 1}"))
        .otherwise(F.expr(f"{longer} + (_index - {edge}) div {size}"))
        .cast("int"),
    ).drop("_index")
