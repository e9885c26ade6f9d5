"""Near-duplicate documents by ProbMinHash.

A text is a weighted set of shingles of five words (a shorter text is one shingle). A shingle weighs 1,
one that the text repeats REPEATED: bounded, so that copies that repeat a line twice or a hundred times
are alike, while a passage that is repeated in one text alone does count. Every shingle sends arrivals,
a Poisson process with its weight as rate and a hash of the shingle as its source of chance; each
arrival goes to one of `registers` registers, which keeps the shingle that came first. Two texts agree
in a register with the probability Jaccard of their weights, by which links are defined. A text's
arrivals end at a time by which its registers are full; texts with one still empty go on to twice that
time. Of each register's shingle the sketch keeps four bits.

Texts with an equal band (four registers) are candidates. What moves with a bucket is sketches; in
blocks of them, texts that pass the estimate are joined, and of all such pairs a block writes only as
many as join what they can join (a forest). The clusters these make hold every pair that passes and
shares a band. Then the shingles of clustered texts meet, once per cluster (in blocks where it is
large), and pairs that pass the estimate are verified there, likeliest first, leaving out those that
others have joined already. So pairs are never rows: both steps write fewer of them than texts, and no
link is passed over.

`classify` returns every row with its class. Linked are texts whose weighted shingles have a probability
Jaccard of `similarity` or more (on 32-bit hashes; two different shingles of a text of n words
meet with n in 2**32). Equal texts are one class and are handled as one. Null, empty and blank texts
have no shingles: each row of them is a class of its own, with no id in common. Rows without id
belong to classes, which are named by their smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope import scratch
from pplscope.bounded import small_side
from pplscope.llm import words as W
from pplscope.llm.components import components
from pplscope.llm.frames import by_place, slices, text_key, whole_text
from pplscope.llm.repeats import expand

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, BAND, BANDS = 512, 4, 32
REPEATED = 1.25
AT_ONCE = 4
# Sketches, and texts with their shingles, that a task compares with as many others.
BLOCK, SET_BLOCK = 10_000, 1_000
DEVIATIONS = 4.5


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, count, text) of each distinct shingle of each text, by text and shingle."""
    words = W.read(texts)
    start, text = W.whole(words.bounds, width)
    values = W.windows(words.hashes, width)[start]
    sizes = np.diff(words.bounds)
    for size in range(1, width):
        short = np.flatnonzero(sizes == size)
        if len(short):
            values = np.concatenate([values, W.windows(words.hashes, size)[words.bounds[:-1][short]]])
            text = np.concatenate([text, short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (text[1:] != text[:-1])])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.diff(np.append(new, len(values))), text[new]


def signatures(element: np.ndarray, weight: np.ndarray, owner: np.ndarray, count: int, registers: int = REGISTERS,
               patience: float = 4.0) -> np.ndarray:
    """First shingle of each register, one row of `registers` per owner; 0 for owners without elements."""
    first = np.full(count * registers, np.inf)
    winner = np.zeros(count * registers, np.uint64)
    total = np.bincount(owner, weight, count)
    with np.errstate(divide="ignore"):
        limit = registers * (np.log(registers) + patience) / total
    todo = np.arange(len(element))
    while len(todo):
        at, arrival = np.zeros(len(todo)), 0
        while len(todo):
            steps = np.arange(arrival, arrival + AT_ONCE, dtype=np.uint64) + np.uint64(1)
            chance = W.mix(element[todo][:, None] + steps * np.uint64(W.BYTE_FACTOR))
            wait = -np.log(((chance >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            times = at[:, None] + np.cumsum(wait, 1) / weight[todo][:, None]
            row, column = np.nonzero(times <= limit[owner[todo]][:, None])
            when, slot = times[row, column], owner[todo[row]] * registers + (chance[row, column] & np.uint64(registers - 1)).astype(np.int64)
            np.minimum.at(first, slot, when)
            won = first[slot] == when
            winner[slot[won]] = element[todo[row[won]]]
            on = times[:, -1] <= limit[owner[todo]]
            todo, at, arrival = todo[on], times[on, -1], arrival + AT_ONCE
        short = np.isinf(first.reshape(count, registers)).any(1) & (total > 0)
        limit[short] *= 2
        todo = np.flatnonzero(short[owner])
    return winner.reshape(count, registers)


def sketches(docs: DataFrame, text_column: str = "text", registers: int = REGISTERS, band: int = BAND, bands: int = BANDS) -> DataFrame:
    """(key, bands, sketch) of each distinct text that has words: hashes of its bands, half a byte per register."""
    rows = docs.select(whole_text(text_column).alias("text"), text_key(text_column).alias("key"))

    def sign(batches):
        for part in slices(batches, "text"):
            element, times, owner = shingles(part.column("text"))
            n = part.num_rows
            kept = np.unique(owner)
            found = signatures(element, np.where(times > 1, REPEATED, 1.0), owner, n, registers)[kept]
            keys = np.zeros((len(kept), bands), np.uint64)
            for i in range(band):
                keys = W.mix(keys * np.uint64(W.WORD_FACTOR) + found[:, i : bands * band : band])
            keys = W.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(W.BYTE_FACTOR))
            offsets = np.arange(0, keys.size + 1, bands, dtype=np.int32)
            marks = (W.mix(found) >> np.uint64(60)).astype(np.uint8)
            marks = marks[:, ::2] | marks[:, 1::2] << 4
            yield pa.RecordBatch.from_pydict({
                "key": part.column("key").take(pa.array(kept)),
                "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64))),
                "sketch": pa.array([m.tobytes() for m in marks], pa.binary()),
            })

    return rows.mapInArrow(sign, "key long, bands array<long>, sketch binary").dropDuplicates(["key"])


def _enough(registers: int, similarity: float) -> int:
    """Marks that texts of this similarity agree in but for DEVIATIONS standard deviations; different shingles
    have the same mark one time in sixteen."""
    share = similarity + (1 - similarity) / 16
    return int(registers * share - DEVIATIONS * (registers * share * (1 - share)) ** 0.5)


def _agreed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Marks that are equal, per row of sketches."""
    apart = x ^ y
    return ((apart & 0x0F) == 0).sum(1) + ((apart & 0xF0) == 0).sum(1)


def _sets(docs: DataFrame, wanted: DataFrame, text_column: str, width: int) -> DataFrame:
    """(key, once, again) of the wanted texts: shingles that occur once in the text, and those repeated."""
    rows = docs.select(whole_text(text_column).alias("text"), text_key(text_column).alias("key")).join(small_side(wanted), "key")

    def cut(batches):
        for part in slices(batches, "text"):
            element, times, owner = shingles(part.column("text"), width)
            short = (element >> np.uint64(32)).astype(np.uint32).view(np.int32)
            columns = {"key": part.column("key")}
            for name, chosen in (("once", times == 1), ("again", times > 1)):
                ends = np.searchsorted(owner[chosen], np.arange(part.num_rows + 1)).astype(np.int32)
                columns[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(short[chosen]))
            yield pa.RecordBatch.from_pydict(columns)

    return scratch.materialize(rows.dropDuplicates(["key"]).mapInArrow(cut, "key long, once array<int>, again array<int>"), "shingles")


class Sets:
    """The weighted shingles of a group's members, numbered: those of member i at `bounds[i]:bounds[i + 1]`,
    with their kind (1 occurs once, 2 is repeated)."""

    WEIGHTS = (0.0, 1.0, REPEATED)

    def __init__(self, once: list, again: list):
        parts = [np.unique(np.asarray(x, np.int32)) for pair in zip(once, again, strict=True) for x in pair]
        sizes = np.array([len(x) for x in parts], np.int64)
        self.kind = np.repeat(np.tile(np.array([1, 2], np.int8), len(once)), sizes)
        self.bounds = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(1))])
        known, self.number = np.unique(np.concatenate([np.zeros(0, np.int32), *parts]), return_inverse=True)
        self.sizes, self.seen = sizes.reshape(-1, 2), np.zeros(len(known), np.int8)

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Probability Jaccard of member i and each of the others: the sum over shared shingles of one over the
        sum of all larger ratios of weights."""
        own = slice(self.bounds[i], self.bounds[i + 1])
        self.seen[self.number[own]] = self.kind[own]
        which, at = expand(self.bounds[others], self.bounds[others + 1] - self.bounds[others])
        code = 9 * which + 3 * self.seen[self.number[at]].astype(np.int64) + self.kind[at]
        counts = np.bincount(code, minlength=9 * len(others)).reshape(-1, 3, 3).astype(np.float64)
        counts[:, 1:, 0] = self.sizes[i] - counts[:, 1:, 1:].sum(2)
        self.seen[self.number[own]] = 0
        total = np.zeros(len(others))
        for x in (1, 2):
            for y in (1, 2):
                ratio = np.array([[max(u / self.WEIGHTS[x], v / self.WEIGHTS[y]) for v in self.WEIGHTS] for u in self.WEIGHTS])
                total += counts[:, x, y] / np.maximum((counts * ratio).sum((1, 2)), 1e-9)
        return total


class Joined:
    """Members of a group and which are joined."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, i: int, j: int) -> bool:
        a, b = self.of[i].item(), self.of[j].item()
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        moved = self.members.pop(b)
        self.of[moved] = a
        self.members[a] += moved
        return True


def _sides(members: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, sketches, left, right): the members by side; a group of one block is compared with itself."""
    order = np.argsort(members["side"], kind="stable")
    side = members["side"][order]
    marks = np.frombuffer(b"".join(members["sketch"][i] for i in order), np.uint8).reshape(len(order), -1)
    left = np.flatnonzero(side == 0)
    return order, marks, left, left if not side.any() else np.flatnonzero(side == 1)


def _forests(batches, enough: int):
    """As many pairs of each group that pass the estimate as join all that such pairs join."""
    for members in _groups(batches):
        order, marks, left, right = _sides(members)
        keys, joined, found = members["key"][order], Joined(len(order)), []
        for i in left.tolist():
            others = right[right > i]
            others = others[joined.of[others] != joined.of[i]]
            for j in others[_agreed(marks[others], marks[i]) >= enough].tolist():
                if joined.join(i, j):
                    found.append((i, j))
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_pydict({"a": pa.array(keys[a], pa.int64()), "b": pa.array(keys[b], pa.int64())})


def _verify(batches, enough: int, similarity: float):
    """The links of each group that join something, among the pairs that pass the estimate."""
    for members in _groups(batches):
        order, marks, left, right = _sides(members)
        keys, joined, found = members["key"][order], Joined(len(order)), []
        sets = Sets(*[[members[c][i] for i in order] for c in ("once", "again")])
        for i in left.tolist():
            others = right[right > i]
            others = others[joined.of[others] != joined.of[i]]
            others = others[_agreed(marks[others], marks[i]) >= enough]
            for j in others[sets.alike(i, others) >= similarity - 1e-12].tolist():
                if joined.join(i, j):
                    found.append((keys[i], keys[j]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _groups(batches):
    """The rows of each group of a stream sorted by group; a group is bounded by two blocks."""
    held, current = None, None

    def flush(rows):
        return {c: rows[c].to_pylist() if c == "sketch" else rows[c].to_numpy() for c in rows.column_names}

    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = batch.column("group").to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]]) if len(names) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(a, b - a)
            if held is not None and names[a] == current:
                held = pa.concat_tables([held, part])
            else:
                if held is not None:
                    yield flush(held.combine_chunks())
                held, current = part, names[a]
    if held is not None:
        yield flush(held.combine_chunks())


def _dealt(rows: DataFrame, name: str, block: int) -> DataFrame:
    """Rows of a bucket or cluster `name` in groups: one per pair of its `parts` blocks, a row in those of its own block."""
    own = F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("parts")).cast("int")
    rest = [c for c in rows.columns if c not in (name, "parts")]
    return (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64(name, F.least("own", "other"), F.greatest("own", "other")).alias("group"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), *rest,
        )
        .repartition("group").sortWithinPartitions("group")
    )


def _parts(block: int):
    return F.ceil(F.count("*") / block).cast("int").alias("parts")


def links(docs: DataFrame, text_column: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY,
          registers: int = REGISTERS, band: int = BAND, bands: int = BANDS, block: int = BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(node, label): components of the distinct texts that have a link, by the keys of the texts."""
    signed = scratch.materialize(sketches(docs, text_column, registers, band, bands), "sketches")
    enough, pair = _enough(registers, similarity), "a long, b long"
    members = signed.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), _parts(block)).where("low <> high")
    met = members.join(shared.select("bucket", "parts"), "bucket").join(signed.select("key", "sketch"), "key")
    near = _dealt(met, "bucket", block).mapInArrow(lambda batches: _forests(batches, enough), pair)
    clusters = scratch.materialize(components(near).withColumnsRenamed({"node": "key", "label": "cluster"}).distinct(), "clusters")
    sets = _sets(docs, clusters.select("key"), text_column, width)
    sizes = clusters.groupBy("cluster").agg(_parts(set_block))
    placed = clusters.join(sizes, "cluster").join(signed.select("key", "sketch"), "key").join(sets, "key")
    found = _dealt(placed, "cluster", set_block).mapInArrow(lambda batches: _verify(batches, enough, similarity), pair)
    return components(found)


def classify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """(doc_id, class_id, class_size) of every row; `class_id` is the smallest id of the class."""
    labels = links(docs.select(F.col(text_column)), text_column, **how).withColumnRenamed("node", "key")
    text = whole_text(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text_key(text_column).alias("key"), text.rlike(r"[^\x20\x09-\x0D]").alias("has_words")
    )
    rows = rows.withColumn("own", F.when(~F.col("has_words"), F.xxhash64("doc_id", F.monotonically_increasing_id())))
    labelled = rows.join(labels, "key", "left").withColumn("label", F.coalesce("own", "label", "key"))
    classes = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    with_class = labelled.where("has_words").join(classes, "label")
    alone = labelled.where(~F.col("has_words")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_class.select("doc_id", "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **how) -> DataFrame:
    """The rows of `docs`, one per class: the one with the smallest id, of equal ids any one. Rows
    without words all stay, and all columns.

    Which rows stay is decided on ids and hashes; texts move once, to meet that. Only rows equal in id and
    text go through one more step, in which each task first keeps one of them.
    """
    rows, (row_id, text) = by_place(docs, id_column, text_column)
    rows = rows.withColumn("key", text_key(text))
    has_words = whole_text(text).rlike(r"[^\x20\x09-\x0D]")
    labels = links(docs.select(F.col(text_column)), text_column, **how).select(F.col("node").alias("key"), "label")
    narrow = rows.where(has_words).groupBy("key", F.col(row_id).alias("id")).agg(F.count("*").alias("times"))
    labelled = narrow.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    first = F.struct(F.col("id").isNull().alias("last"), "id", "key", "times")
    winners = scratch.materialize(labelled.groupBy("label").agg(F.min(first).alias("first")).select("first.id", "first.key", "first.times"), "kept")
    winners = winners.withColumnRenamed("key", "first_key")
    same = F.col(row_id).eqNullSafe(F.col("id")) & (F.col("key") == F.col("first_key"))
    kept = rows.where(has_words).join(winners.where("times = 1"), same, "left_semi")
    often = small_side(winners.where("times > 1"))
    again = rows.where(has_words).join(often, same, "left_semi").dropDuplicates(["key"])
    return kept.unionByName(again).unionByName(rows.where(~has_words)).drop("key").toDF(*docs.columns)
