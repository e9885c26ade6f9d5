"""Rows in ascending id order over ranges of their own: each range is one task's sorted stream."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope.llm.frames import partitions, text_key, whole_text

LOWEST = -(1 << 63)


def ordered(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, _order, _tie): null ids come first, equal ids by their text's key."""
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(LOWEST)).alias("_order"), text_key(text_column).alias("_tie"),
    )


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame | None:
    """The rows range-partitioned and sorted, with a guest at the end of each range: the first row
    of the next range (after the last range, the first row of all). `_guest` is 1 for guests.
    None for an empty table.

    The ranges' first rows are found on ids alone and come to the driver, one per task; texts move once.
    """
    spark = docs.sparkSession
    rows = ordered(docs, id_column, text_column)
    ranges = partitions(spark)
    firsts = (
        rows.select("_order", "_tie").repartitionByRange(ranges, "_order", "_tie")
        .groupBy(F.spark_partition_id()).agg(F.min(F.struct("_order", "_tie")).alias("first")).select("first.*").collect()
    )
    firsts = sorted((r._order, r._tie) for r in firsts)
    if not firsts:
        return None
    guest_of = {first: (i - 1) % len(firsts) for i, first in enumerate(firsts)}

    def deal(batches):
        for batch in batches:
            keys = list(zip(batch.column("_order").to_pylist(), batch.column("_tie").to_pylist(), strict=True))
            yield _with(batch, [bisect_right(firsts, key) - 1 for key in keys], 0)
            for i, key in enumerate(keys):
                if key in guest_of:
                    yield _with(batch.slice(i, 1), [guest_of[key]], 1)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, _order long, _tie long, _range int, _guest int")
    return dealt.repartitionById(len(firsts), F.col("_range")).sortWithinPartitions("_range", "_guest", "_order", "_tie")


def _with(batch: pa.RecordBatch, ranges: list[int], guest: int) -> pa.RecordBatch:
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns["_range"] = pa.array(ranges, pa.int32())
    columns["_guest"] = pa.array(np.full(batch.num_rows, guest, np.int32))
    return pa.RecordBatch.from_pydict(columns)
