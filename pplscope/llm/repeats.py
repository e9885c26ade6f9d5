"""What the operators on repeated passages share: anchors counted per task, and the exact way for
anchors that are too frequent for one task.

A row is named by `_order` (its id, null as the lowest) and `_key` (hash of id and text), both read
from the data, so that every pass names it alike. Equal rows share a name and stay occurrences of
their own.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from pplscope import scratch
from pplscope.llm import words as W
from pplscope.llm.frames import slices, whole_text
from pplscope.llm.order import LOWEST

OFTEN_IN_TASK = 8
HOT, HOT_SHARE = 50_000, 1 << 20


def named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, text, _order, _key)."""
    text, row_id = whole_text(text_column), F.col(id_column).cast("long")
    return docs.select(
        row_id.alias("doc_id"), text.alias("text"), F.coalesce(row_id, F.lit(LOWEST)).alias("_order"),
        F.xxhash64(row_id, text).alias("_key"),
    )


def hot_anchors(rows: DataFrame, length: int, k: int, hot: int = HOT) -> Broadcast:
    """Sorted anchors of more than `hot` pieces and one in HOT_SHARE of all: at most HOT_SHARE of them.

    Each task reports the anchors it met OFTEN_IN_TASK times or more, so a frequent one is missed only
    where it has a few pieces in each of very many tasks.
    """

    def count(batches):
        met, total = Counter(), 0
        for part in slices(batches, "text"):
            anchors, times = np.unique(W.pieces(W.read(part.column("text")), length, k).anchor, return_counts=True)
            total += int(times.sum())
            for a, n in zip(anchors[times > 1].tolist(), times[times > 1].tolist(), strict=True):
                met[a] += n
        often = [(a, n) for a, n in met.items() if n >= OFTEN_IN_TASK]
        often.append((None, total))
        yield pa.RecordBatch.from_pydict({
            "anchor": pa.array([None if a is None else a - (1 << 63) for a, _ in often], pa.int64()), "n": pa.array([n for _, n in often], pa.int64())
        })

    spark = rows.sparkSession
    counted = rows.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    counted = scratch.materialize(counted, "anchors")
    total = counted.where("anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("anchor").isNotNull() & (F.col("n") > max(hot, total // HOT_SHARE))).select("anchor").collect()
    return spark.sparkContext.broadcast(np.sort(np.array([r.anchor + (1 << 63) for r in found], np.uint64)))


def among(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted array."""
    if not len(chosen):
        return np.zeros(len(values), bool)
    return chosen[np.minimum(np.searchsorted(chosen, values), len(chosen) - 1)] == values


def hot_windows(rows: DataFrame, length: int, k: int, hot: Broadcast) -> DataFrame | None:
    """(_order, _key, start, ref_order, ref_start) of the windows with hot anchors that occur more than
    once: counted by window with partial sums, then joined back, where Spark splits the frequent ones.
    None without hot anchors."""
    if not len(hot.value):
        return None

    def emit(batches):
        for part in slices(batches, "text"):
            words = W.read(part.column("text"))
            p = W.pieces(words, length, k)
            chosen = np.flatnonzero(among(p.anchor, hot.value))
            if len(chosen):
                piece, starts = expand(p.first[chosen], p.count[chosen])
                text = p.text[chosen][piece]
                yield pa.RecordBatch.from_pydict({
                    "window": pa.array(W.windows(words.hashes, length)[starts].view(np.int64)),
                    "_order": part.column("_order").take(pa.array(text)), "_key": part.column("_key").take(pa.array(text)),
                    "start": pa.array((starts - words.bounds[text]).astype(np.int32)),
                })

    table = rows.select("text", "_order", "_key").mapInArrow(emit, "window long, _order long, _key long, start int")
    table = scratch.materialize(table, "hot-windows")
    place = F.struct("_order", "_key", "start")
    twice = table.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).where("n > 1").drop("n")
    ref = F.when(F.col("low") == place, F.col("high")).otherwise(F.col("low"))
    return table.join(twice, "window").withColumn("ref", ref).select(
        "_order", "_key", "start", F.col("ref._order").alias("ref_order"), F.col("ref.start").alias("ref_start")
    )


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of run, value) of every value of the runs `first`, `first + 1`, …, `count` of each."""
    run = np.repeat(np.arange(len(first)), count)
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    return run, np.arange(len(run)) - begin[run] + first[run]
