"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, every shard a weight; a rack or region weighs what is in it.
A row descends from the top: at each level every child draws `-ln(u) / weight` with `u` a hash of
child and row, and the smallest draw wins. A child's draw depends on nothing but itself, so a
change of weight moves rows only into or out of subtrees whose weight changed. Growing adds a
region of its own for the new shard: the new region draws against the old ones, so rows move only
into it.

Everything is native. `place` is row-local; `number` gives each row a gapless slot in its shard
from counts of small buckets, so no shard is ever sorted as a whole. Null and empty texts have no
bytes; a row without an id is placed by its text; rows with equal ids go to equal shards and take
different slots; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from pplscope.llm.frames import whole_text

ROW_BYTES = 16
RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
ROWS_PER_BUCKET = 20_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: int
    rack: int
    weight: float = 1.0


def layout(shards: int, founded: int | None = None) -> list[Shard]:
    """The first `founded` shards (all by default) in regions of racks; later ones in a region each."""
    founded = shards if founded is None else founded
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    first = [Shard(i, i // per_region, i // SHARDS_PER_RACK % RACKS_PER_REGION) for i in range(min(founded, shards))]
    regions = -(-len(first) // per_region)
    return first + [Shard(i, regions + i - founded, 0) for i in range(founded, shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    """Exponential with rate `weight`; `u` has 52 bits and is never 0 or 1."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / F.lit(weight)


def _winner(draws: list[tuple[Column, int]]) -> Column:
    entries = [F.struct(d.alias("draw"), F.lit(i).alias("child")) for d, i in draws]
    return (entries[0] if len(entries) == 1 else F.least(*entries)).getField("child")


def shard_of(tree: list[Shard], key: Column) -> Column:
    """Descend region, rack and shard. Children without weight take nothing."""
    tree = [s for s in tree if s.weight > 0]
    weight: dict[tuple, float] = {}
    for s in tree:
        for node in ((s.region,), (s.region, s.rack), (s.region, s.rack, s.number)):
            weight[node] = weight.get(node, 0.0) + s.weight

    def descend(node: tuple) -> Column:
        if len(node) == 3:
            return F.lit(node[-1])
        children = sorted(n for n in weight if len(n) == len(node) + 1 and n[: len(node)] == node)
        if len(children) == 1:
            return descend(children[0])
        chosen = _winner([(_draw(key, "/".join(map(str, c)), weight[c]), c[-1]) for c in children])
        if len(node) == 2:
            return chosen
        # The winner is bound once; only its own subtree is drawn.
        return F.transform(F.array(chosen), lambda w: _branch(w, children))[0]

    def _branch(winner: Column, children: list[tuple]) -> Column:
        branch = F.when(winner == children[0][-1], descend(children[0]))
        for child in children[1:]:
            branch = branch.when(winner == child[-1], descend(child))
        return branch

    return descend(())


def place(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard): `grown_shard` is the place in the tree `grown`."""
    text = whole_text(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.coalesce(F.col(id_column).cast("string"), text).alias("_key"),
    )
    rows = rows.withColumn("_key", F.xxhash64("_key"))
    key = F.col("_key")
    return rows.withColumns({
        "shard": shard_of(tree, key), "grown_shard": shard_of(grown, key) if grown else F.lit(None).cast("int"),
    })


def number(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """Adds `slot`, gapless from 0 in each shard. `rows`, the table's size, only sets how finely shards are cut."""
    buckets = max(1, -(-rows // (shards * ROWS_PER_BUCKET)))
    cut = placed.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), "_key"), F.lit(buckets)))
    counts = cut.groupBy("shard", "_bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")
    offsets = counts.select("shard", "_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size"))
    return (
        cut.withColumn("_within", within)
        .join(offsets, ["shard", "_bucket"])
        .withColumn("slot", F.col("_before") + F.col("_within") - 1)
        .drop("_bucket", "_before", "_within")
    )


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, id_column: str = "doc_id",
           text_column: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, grown_shard) for every row."""
    placed = place(docs, tree, grown, id_column, text_column)
    return number(placed, len(tree), docs.count()).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
