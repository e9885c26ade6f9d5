"""Embedding similarity of selected chunk sets."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from pplscope.bounded import pinned, small_side
from pplscope.functions.vectors import dot, norm
from pplscope.operators import selection as S
from pplscope.operators.stats import density_histogram, filled_bins
from pplscope.scratch import materialize


class Encoder(Protocol):
    """Turns texts into vectors; built once per task."""

    def encode(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def embed_texts(
    df: DataFrame, make_encoder: Callable[[], Encoder], keys: list[str], text_col: str = "chunk_text"
) -> DataFrame:
    """`keys` and `embedding`, encoded in Arrow batches."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            vectors = encoder.encode(batch.column(text_col).to_pylist())
            columns = [batch.column(k) for k in keys]
            columns.append(pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "embedding"])

    schema = df.select(*keys).schema.add("embedding", ArrayType(FloatType()))
    return df.select(*keys, text_col).mapInArrow(encode, schema)


def pairwise_cosine(
    df: DataFrame, id_col: str, vec_col: str = "embedding", by: str | None = None, blocks: int = 4
) -> DataFrame:
    """Cosine of every unordered pair of vectors (within each `by` set): `id_i < id_j, cosine`.

    The output is quadratic in the set, which is why sets are top-n selections. Vectors are
    scaled to unit length once, hashed into `blocks`, and meet in an equi-join on the pair of
    blocks, so that a set of any size is spread over blocks × (blocks + 1) / 2 groups of pairs
    per set. Choose `blocks` so that set size / `blocks` vectors fit a task.
    """
    group = F.lit("all") if by is None else F.col(by)
    length = norm(F.col(vec_col))
    unit = F.transform(vec_col, lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("_length")), F.lit(0.0)))
    block = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")
    rows = (
        df.select(group.alias("_by"), F.col(id_col).alias("_id"), F.col(vec_col), length.alias("_length"), block.alias("_b"))
        .select("_by", "_id", "_b", unit.alias("_v"))
    )
    upper = rows.select("_by", F.col("_id").alias("i"), F.col("_v").alias("vi"), F.col("_b").alias("_lo"),
                        F.explode(F.sequence("_b", F.lit(blocks - 1))).alias("_hi"))
    lower = rows.select("_by", F.col("_id").alias("j"), F.col("_v").alias("vj"), F.col("_b").alias("_hi"),
                        F.explode(F.sequence(F.lit(0), "_b")).alias("_lo"))
    pairs = upper.join(lower, ["_by", "_lo", "_hi"]).where((F.col("_lo") < F.col("_hi")) | (F.col("i") < F.col("j")))
    out = pairs.select(
        F.col("_by").alias(by or "_by"),
        F.least("i", "j").alias("id_i"), F.greatest("i", "j").alias("id_j"),
        dot(F.col("vi"), F.col("vj")).alias("cosine"),
    )
    return out if by else out.drop("_by")


# A block of vectors that a task holds, and the fewest blocks of a set with enough tiles: vectors move as often as there are blocks.
HELD_VALUES = 1 << 23
LEAST_BLOCKS = 12


def cosine_histogram(
    df: DataFrame, id_col: str, vec_col: str = "embedding", by: str | None = None, bins: int = 50, block: int = 2048
) -> DataFrame:
    """`density_histogram` of the cosines of all pairs of vectors (within each `by` set), for sets of any size.

    Pairs are never rows: vectors meet in pairs of blocks, a task holds one block, lets the other one pass
    and multiplies them in tiles of `block` rows. It sends on their range, then, in a second pass, how many
    fall in each bin. Blocks are as large as a task may hold, so a vector moves as often as a set has
    blocks, not tiles. Vectors are of one length; one without length is at cosine 0 from all, null is left out.
    """
    spark = df.sparkSession
    group = F.lit("all") if by is None else F.col(by)
    scaled = materialize(
        df.where(F.col(vec_col).isNotNull()).select(group.alias("_by"), F.xxhash64(id_col).alias("_hash"), F.col(vec_col).alias("_v")),
        "vectors",
    )
    held = F.ceil(F.count("*") * F.max(F.size("_v")) / HELD_VALUES)
    parts = F.greatest(held, F.least(F.ceil(F.count("*") / block), F.lit(LEAST_BLOCKS)))
    sizes = small_side(scaled.groupBy("_by").agg(parts.cast("int").alias("_parts")))
    own = F.pmod("_hash", F.col("_parts")).cast("int")
    sent = (
        scaled.join(sizes, "_by").withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .select(
            "_by", F.least("_own", "_other").alias("_low_block"), F.greatest("_own", "_other").alias("_high_block"),
            (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "_v",
        )
    )
    keys = ["_by", "_low_block", "_high_block"]
    # A stated number, as the work of a partition does not follow its bytes.
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(ways, *keys).sortWithinPartitions(*keys, "_side")

    def units(batch: pa.RecordBatch, start: int, n: int) -> np.ndarray:
        vectors = batch.column("_v").slice(start, n).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        length = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)

    def within(rows: np.ndarray) -> Iterator[np.ndarray]:
        for at in range(0, len(rows), block):
            tile = rows[at : at + block]
            yield (tile @ tile.T)[np.triu_indices(len(tile), 1)]
            for other in range(at + block, len(rows), 4096):
                yield (tile @ rows[other : other + 4096].T).ravel()

    def products(batches: Iterator[pa.RecordBatch], kinds: list, extra: Sequence[str] = ()) -> Iterator[tuple]:
        """(the set, the `extra` columns of a row of it, cosines) tile by tile; `kinds` gets the type of the set."""
        current, first, members = None, (), []
        for batch in batches:
            runs = list(zip(*[batch.column(k).to_pylist() for k in [*keys, "_side"]]))
            start = 0
            for run, same in itertools.groupby(runs):
                n = sum(1 for _ in same)
                rows = units(batch, start, n)
                if run[:3] != current:
                    if current and current[1] == current[2] and members:
                        for found in within(np.concatenate(members)):
                            yield current[0], first, found
                    current, members = run[:3], []
                    kinds[:] = [batch.column("_by").type]
                    first = tuple(batch.column(c)[start].as_py() for c in extra)
                if run[3] == 0:
                    members.append(rows)
                elif members:
                    members = [np.concatenate(members)] if len(members) > 1 else members
                    for at in range(0, len(members[0]), block):
                        for other in range(0, n, 4096):
                            yield current[0], first, (members[0][at : at + block] @ rows[other : other + 4096].T).ravel()
                start += n
        if current and current[1] == current[2] and members:
            for found in within(np.concatenate(members)):
                yield current[0], first, found

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = {}, []
        for name, _, found in products(batches, kinds):
            if len(found):
                low, high, n = seen.get(name, (np.inf, -np.inf, 0))
                seen[name] = (np.minimum(low, found.min()), np.maximum(high, found.max()), n + len(found))
        for name, (low, high, n) in seen.items():
            yield pa.RecordBatch.from_pydict({"_by": pa.array([name], kinds[0]), "low": [float(low)], "high": [float(high)], "n": [n]})

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kinds = {}, []
        for name, (low, high), found in products(batches, kinds, ("_low", "_high")):
            place = np.clip(np.floor((found - low) / (high - low) * float(bins)) + 1, 1, bins)
            binned = np.bincount(place[place >= 1].astype(np.int32), minlength=bins + 1)
            seen[name] = seen.get(name, 0) + binned
        for name, binned in seen.items():
            some = np.flatnonzero(binned)
            yield pa.RecordBatch.from_pydict(
                {"_by": pa.array([name] * len(some), kinds[0]), "bin": some.astype(np.int32), "n": binned[some].astype(np.int64)})

    kind = df.select(group.alias("_by")).schema["_by"].dataType.simpleString()
    low, high = F.min("low"), F.max("high")
    half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    ranges = small_side(
        dealt(sent).mapInArrow(spans, f"_by {kind}, low double, high double, n long").groupBy("_by")
        .agg((low - half).alias("_low"), (high + half).alias("_high"), F.sum("n").alias("_total"))
    )
    binned = dealt(sent.join(ranges.select("_by", "_low", "_high"), "_by")).mapInArrow(counts, f"_by {kind}, bin int, n long")
    return filled_bins(ranges, binned.groupBy("_by", "bin").agg(F.sum("n").alias("n")), bins, by)


def selected_and_control(gamma: DataFrame, n: int = 100, seed: int | str = 0, side: str = "top") -> DataFrame:
    """The top (or bottom) `n` chunks and `n` random others, told apart by `set`."""
    if side not in ("top", "bottom"):
        raise ValueError(f"unknown side {side!r}")
    chosen = pinned(S.top_gamma(gamma, n) if side == "top" else S.bottom_gamma(gamma, n))
    control = S.random_control(gamma, chosen, n, seed)
    return chosen.withColumn("set", F.lit(side)).unionByName(control.withColumn("set", F.lit("random")))


def compare_sets(
    gamma: DataFrame, embeddings: DataFrame, n: int = 100, seed: int | str = 0, side: str = "top", bins: int = 50
) -> DataFrame:
    """Similarity histogram of the selected chunks next to that of their random control.

    `embeddings` carries `text_id, chunk_id, embedding`; only the 2n selected rows are joined.
    """
    members = pinned(selected_and_control(gamma, n, seed, side))
    return _histogram(embeddings.join(small_side(members.select("set", *S.KEYS)), S.KEYS), bins)


def compare_texts(
    gamma: DataFrame, chunks: DataFrame, make_encoder: Callable[[], Encoder], n: int = 100, seed: int | str = 0,
    side: str = "top", bins: int = 50, text_col: str = "chunk_text",
) -> DataFrame:
    """`compare_sets` without ready embeddings: only the 2n selected texts are looked up and embedded."""
    members = pinned(selected_and_control(gamma, n, seed, side))
    texts = chunks.select(*S.KEYS, text_col).join(small_side(members.select("set", *S.KEYS)), S.KEYS)
    return _histogram(embed_texts(texts, make_encoder, ["set", *S.KEYS], text_col), bins)


def _histogram(vectors: DataFrame, bins: int) -> DataFrame:
    # The 2n vectors are read once; both passes of the histogram work on this copy.
    vectors = pinned(vectors)
    keyed = vectors.withColumn("key", F.struct(*S.KEYS))
    return density_histogram(pairwise_cosine(keyed, "key", by="set"), "cosine", bins, by="set")
