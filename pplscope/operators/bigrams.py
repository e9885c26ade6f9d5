"""A model of counted word pairs as sorted arrays in files, which the scoring tasks map and search.

Two passes over the training texts: the first counts words, the second, in which words are numbers,
pairs; what moves are packed blocks of distinct words and pairs. Scoring then moves nothing: a task
looks the distinct pairs of a slice of its texts up in the pages it needs, whatever the model's size.

A word is a 64-bit hash, its place among the sorted hashes is its number. The two numbers of a pair,
side by side, are stirred by a bijection, so pairs are told apart exactly and lie evenly: the highest
bits name the file, the next ones a slot of it, and only the rest is stored.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from pplscope import scratch

# Executors get the batch functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "bucket int, kind int, block binary"
#: Bytes of text that are worked on at once. A longer text is a slice of its own.
SLICE = 1 << 22
#: Bytes of text for each file of words and of pairs, and the most files of each.
WORD_BYTES, PAIR_BYTES, MOST_FILES = 1 << 25, 1 << 24, 1 << 16
#: Distinct values a task holds before it hands them on, and values in one block.
HELD_VALUES, BLOCK_VALUES = 1 << 22, 1 << 18

BYTE_FACTOR = 0x9E3779B97F4A7C15
BYTE_VALUE = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
# The blanks of `functions.text.words`.
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[0x20, 0x0A, 0x0D, 0x09]] = True


def mounted_folder(spark: SparkSession) -> str | None:
    """A new folder under the shared one as a path of the file system; None where only Spark can read it."""
    path = scratch.new_path(spark, "bigrams")
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    return None if "://" in path else path


# --- Texts to hashes of words -----------------------------------------------------------------


def stirred(values: np.ndarray, bits: int = 64) -> np.ndarray:
    """A bijection of the numbers of so many bits."""
    mask, by = np.uint64((1 << bits) - 1), np.uint64(max(1, bits // 2))
    x = values ^ (values >> by)
    for factor in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        x = (x * np.uint64(factor)) & mask
        x ^= x >> by
    return x


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of `column`, cut between rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes.astype(np.int64)), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, end to end, and where each text's begin (one more than texts)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = IS_BLANK[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]])[: len(raw)] | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]])[: len(raw)] | edge[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    # A word's value is a polynomial in its bytes, by differences of running totals modulo 2**64.
    up, down = (np.full(len(raw), f, np.uint64) for f in (BYTE_FACTOR, pow(BYTE_FACTOR, -1, 1 << 64)))
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    up *= BYTE_VALUE[raw]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(up, out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    return stirred(hashes), np.searchsorted(starts, offsets)


def followed(bounds: np.ndarray) -> np.ndarray:
    """Which words have another behind them in their text."""
    out = np.ones(int(bounds[-1]), bool)
    out[bounds[1:][np.diff(bounds) > 0] - 1] = False
    return out


# --- Distinct values with counts, packed and dealt by bucket ----------------------------------


def top_bits(values: np.ndarray, taken: int, bits: int = 64) -> np.ndarray:
    return (values >> np.uint64(bits - taken)).astype(np.int64) if taken else np.zeros(len(values), np.int64)


def runs(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, stop) of equal neighbours."""
    if len(buckets):
        first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        yield from zip(buckets[first].tolist(), first.tolist(), [*first[1:].tolist(), len(buckets)], strict=True)


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values as byte planes of their differences, and counts."""
    steps = np.diff(values, prepend=values[:1])
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8)
    head = np.array([len(values), planes, values[0]], np.uint64)
    low = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :planes].T)
    large = counts[counts >= 255].astype(np.uint64)
    body = b"".join([head.tobytes(), low.tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), large.tobytes()])
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    body = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), "zstd", asbytes=True)
    n, planes, first = (int(x) for x in np.frombuffer(body, np.uint64, 3))
    at = 24 + n * planes
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :planes] = np.frombuffer(body, np.uint8, n * planes, 24).reshape(planes, n).T
    counts = np.frombuffer(body, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, np.uint64, -1, at + n).astype(np.int64)
    return np.uint64(first) + np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), counts


def summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, ascending, its counts added up."""
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)


NOTHING = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Tally:
    """Counts of values by kind, added up whenever what came since doubles what is held."""

    def __init__(self) -> None:
        self.sums, self.new, self.size, self.fresh = {}, {}, 0, 0

    def add(self, kind: int, values: np.ndarray, counts: np.ndarray) -> None:
        self.new.setdefault(kind, []).append((values, counts))
        self.fresh += len(values)
        if self.fresh > max(self.size, HELD_VALUES // 4):
            self.settle()

    def settle(self) -> None:
        for kind, parts in self.new.items():
            self.sums[kind] = summed(*map(np.concatenate, zip(self.sums.get(kind, NOTHING), *parts, strict=True)))
        self.new, self.fresh, self.size = {}, 0, sum(len(v) for v, _ in self.sums.values())

    def taken(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        self.settle()
        out, self.sums, self.size = self.sums, {}, 0
        return out

    @property
    def full(self) -> bool:
        return self.size >= HELD_VALUES


def dealt(tally: Tally, taken: int, bits: int = 64) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, block) of what a tally held."""
    for kind, (values, counts) in tally.taken().items():
        for bucket, start, stop in runs(top_bits(values, taken, bits)):
            for at in range(start, stop, BLOCK_VALUES):
                end = min(stop, at + BLOCK_VALUES)
                yield bucket, kind, pack(values[at:end], counts[at:end])


def as_batches(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of a few megabytes."""

    def record(held):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "block"])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2]) + 64
        if size > 1 << 23:
            yield record(held)
            held, size = [], 0
    if held:
        yield record(held)


def gathered(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows of each bucket together, one task per bucket."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """(bucket, values and counts by kind) of gathered rows."""
    rows = ((b, k, block) for part in batches for b, k, block in zip(
        part.column("bucket").to_pylist(), part.column("kind").to_pylist(), part.column("block"), strict=True))
    for bucket, group in groupby(rows, lambda r: r[0]):
        tally = Tally()
        for _, kind, block in group:
            tally.add(kind, *unpack(block.as_py()))
        yield bucket, tally.taken()


# --- Arrays in files --------------------------------------------------------------------------


def write(path: str, **arrays: np.ndarray) -> None:
    """Arrays of one file, whole or not at all: a task that runs again writes the same."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part, at = f"{path}.{uuid.uuid4().hex}", 0
    index = []
    for name, a in arrays.items():
        index.append((name, a.dtype.str, a.shape, at))
        at += -(-a.nbytes // 8) * 8
    head = repr(index).encode()
    with open(part, "wb") as file:
        file.write(len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8))
        for a in arrays.values():
            file.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    os.replace(part, path)


def mapped(path: str) -> dict[str, np.ndarray]:
    import ast

    raw = np.memmap(path, np.uint8, "r")
    size = int(raw[:8].view(np.int64)[0])
    body = raw[8 + -(-size // 8) * 8 :]
    out = {}
    for name, kind, shape, at in ast.literal_eval(raw[8 : 8 + size].tobytes().decode()):
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = body[at : at + n].view(kind).reshape(shape)
    return out


def narrow(table: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Counts in a byte each; the few that take more are listed beside them, by place."""
    flat = table.ravel()
    at = np.flatnonzero(flat >= 255)
    return {f"{prefix}": np.minimum(table, 255).astype(np.uint8), f"{prefix}_at": at.astype(np.uint64), f"{prefix}_of": flat[at].astype(np.uint64)}


def wide(arrays: dict[str, np.ndarray], prefix: str, rows: np.ndarray) -> np.ndarray:
    """Rows of a narrowed table."""
    table = arrays[prefix]
    out = table[rows].astype(np.int64)
    r, c = np.nonzero(out == 255)
    if len(r):
        place = rows[r].astype(np.uint64) * np.uint64(table.shape[1]) + c.astype(np.uint64)
        out[r, c] = arrays[f"{prefix}_of"][np.searchsorted(arrays[f"{prefix}_at"], place)]
    return out


def pair_arrays(found: dict[int, tuple[np.ndarray, np.ndarray]], models: int, inner: int) -> dict[str, np.ndarray]:
    """The arrays of one file from the counts of each model; of a pair's bits, `inner` tell those of a file apart.

    A pair that one model has is a byte, its model and its count; the others are listed by place.
    """
    kinds = sorted(found)
    keys = np.concatenate([found[j][0] for j in kinds])
    order = np.argsort(keys, kind="stable")
    keys = keys[order] & np.uint64((1 << inner) - 1)
    model = np.repeat(np.array(kinds), [len(found[j][0]) for j in kinds])[order]
    count = np.concatenate([found[j][1] for j in kinds])[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at, which = np.flatnonzero(first), np.cumsum(first) - 1
    n = len(at)
    size = np.diff(np.append(at, len(keys)))
    kind = np.uint8 if models <= 64 else np.uint16
    last = np.iinfo(kind).max
    code = model[at] + models * (count[at] - 1)
    many = np.flatnonzero((size > 1) | (code >= last))
    code = np.minimum(code, last)
    code[many] = last
    shared = np.zeros(n, bool)
    shared[many] = True
    some = np.flatnonzero(shared[which])
    table = np.zeros((len(many), models), np.int64)
    table[np.searchsorted(many, which[some]), model[some]] = count[some]
    slot_bits = min(inner, max(0, (n >> 3).bit_length()))
    left = inner - slot_bits
    values = keys[at]
    slots = np.concatenate([[0], np.cumsum(np.bincount(top_bits(values, slot_bits, inner), minlength=1 << slot_bits))])
    rest = (values & np.uint64((1 << left) - 1)).astype(np.min_scalar_type((1 << left) - 1))
    return {"rest": rest, "slots": slots.astype(np.uint32), "code": code.astype(kind), "many": many.astype(np.uint32), **narrow(table, "counts")}


def pair_counts(arrays: dict[str, np.ndarray], keys: np.ndarray, models: int, inner: int) -> np.ndarray:
    """The counts of each model of ascending keys of one file."""
    rest, slots = arrays["rest"], arrays["slots"]
    slot_bits = (len(slots) - 1).bit_length() - 1
    left = inner - slot_bits
    keys = keys & np.uint64((1 << inner) - 1)
    slot, own = top_bits(keys, slot_bits, inner), (keys & np.uint64((1 << left) - 1)).astype(rest.dtype)
    low, high = slots[slot].astype(np.int64), slots[slot + 1].astype(np.int64)
    end = high.copy()
    while (open_ := low < high).any():
        middle = np.minimum((low + high) >> 1, len(rest) - 1)
        less = open_ & (rest[middle] < own)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    place = np.minimum(low, len(rest) - 1)
    hit = np.flatnonzero((low < end) & (rest[place] == own))
    out, place = np.zeros((len(keys), models), np.int64), place[hit]
    code, last = arrays["code"][place].astype(np.int64), np.iinfo(arrays["code"].dtype).max
    one = code < last
    out[hit[one], code[one] % models] = code[one] // models + 1
    if not one.all():
        out[hit[~one]] = wide(arrays, "counts", np.searchsorted(arrays["many"], place[~one]))
    return out


# --- The model --------------------------------------------------------------------------------


@dataclass
class Bigrams:
    """Where the files are, and the few numbers about all of them."""

    folder: str
    models: int
    sizes: np.ndarray
    pair_sizes: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    opened: dict = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "opened": {}}

    @property
    def words(self) -> int:
        return int(self.sizes.sum())

    @property
    def word_bits(self) -> int:
        return max(1, self.words.bit_length())

    @property
    def base(self) -> np.ndarray:
        """Number of the first word of each file, and of all words."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def file(self, name: str) -> dict[str, np.ndarray]:
        if name not in self.opened:
            while len(self.opened) >= 256:
                self.opened.pop(next(iter(self.opened)))
            self.opened[name] = mapped(f"{self.folder}/{name}")
        return self.opened[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where training has none."""
        unique, back = np.unique(hashes, return_inverse=True)
        out, base = np.full(len(unique), -1, np.int64), self.base
        for b, start, stop in runs(top_bits(unique, len(self.sizes).bit_length() - 1)):
            if self.sizes[b]:
                known = self.file(f"words-{b}")["hashes"]
                at = np.minimum(np.searchsorted(known, unique[start:stop]), len(known) - 1)
                out[start:stop] = np.where(known[at] == unique[start:stop], base[b] + at, -1)
        return out[back]

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return stirred(a.astype(np.uint64) << np.uint64(self.word_bits) | b.astype(np.uint64), 2 * self.word_bits)

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        """How often each model has each of ascending numbers before another word."""
        out, base = np.zeros((len(numbers), self.models), np.int64), self.base
        for b, start, stop in runs(np.searchsorted(base, numbers, "right") - 1):
            out[start:stop] = wide(self.file(f"words-{b}"), "starts", numbers[start:stop] - base[b])
        return out

    def counts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How often each model has each pair."""
        keys, bits = self.keys(a, b), 2 * self.word_bits
        taken = len(self.pair_sizes).bit_length() - 1
        order = np.argsort(keys)
        keys, found = keys[order], np.zeros((len(keys), self.models), np.int64)
        for bucket, start, stop in runs(top_bits(keys, taken, bits)):
            if self.pair_sizes[bucket]:
                found[start:stop] = pair_counts(self.file(f"pairs-{bucket}"), keys[start:stop], self.models, bits - taken)
        out = np.empty_like(found)
        out[order] = found
        return out


def _power_of_two(least: float) -> int:
    n = 1
    while n < min(least, MOST_FILES):
        n *= 2
    return n


def train(texts: DataFrame, models: list[str], folder: str) -> Bigrams:
    """Count words, then pairs, of `texts` (`model, text`) by model and write the arrays. Rows of other models
    count for the vocabulary only."""
    texts = texts.select("model", F.col("text").cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    word_files, pair_files = _power_of_two(size / WORD_BYTES), _power_of_two(size / PAIR_BYTES)
    names, n_models = pa.array(models, pa.string()), len(models)

    def words_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes, what model each word's text trains (-1: none), which are followed, texts' bounds."""
        hashes, bounds = hashed_words(part.column("text"))
        model = pc.fill_null(pc.index_in(part.column("model").cast(pa.string()), names), -1).to_numpy(zero_copy_only=False)
        return hashes, np.repeat(model, np.diff(bounds)), followed(bounds), bounds

    def count_words(batches):
        def rows():
            tally, taken = Tally(), word_files.bit_length() - 1
            for part in slices(batches, "text", SLICE):
                hashes, model, on, _ = words_of(part)
                on &= model >= 0
                for j in np.unique(model[on]).tolist():
                    tally.add(j, *np.unique(hashes[on & (model == j)], return_counts=True))
                # Words that are nothing but the last of their text, or of other models, are in the vocabulary, too.
                lonely = np.setdiff1d(hashes[~on], hashes[on])
                tally.add(n_models, lonely, np.ones(len(lonely), np.int64))
                if tally.full:
                    yield from dealt(tally, taken)
            yield from dealt(tally, taken)

        return as_batches(rows())

    def write_words(batches):
        def rows():
            for bucket, found in by_bucket(batches):
                hashes = np.unique(np.concatenate([values for values, _ in found.values()]))
                starts = np.zeros((len(hashes), n_models), np.int64)
                for j, (values, counts) in found.items():
                    if j < n_models:
                        starts[np.searchsorted(hashes, values), j] = counts
                write(f"{folder}/words-{bucket}", hashes=hashes, **narrow(starts, "starts"))
                yield bucket, len(hashes), b""

        return as_batches(rows())

    sizes = np.zeros(word_files, np.int64)
    for row in gathered(texts.mapInArrow(count_words, SCHEMA), word_files).mapInArrow(write_words, SCHEMA).collect():
        sizes[row.bucket] = row.kind
    model = Bigrams(folder, n_models, sizes)
    if model.word_bits > 31:
        raise ValueError(f"{model.words} words; the two numbers of a pair take 62 bits at most")
    bits = 2 * model.word_bits
    taken = min(pair_files.bit_length() - 1, bits)
    model.pair_sizes = np.zeros(1 << taken, np.int64)

    def count_pairs(batches):
        def rows():
            tally = Tally()
            for part in slices(batches, "text", SLICE):
                hashes, trains, on, _ = words_of(part)
                numbers = model.numbers(hashes)
                first = np.flatnonzero(on & (trains >= 0))
                keys, trains = model.keys(numbers[first], numbers[first + 1]), trains[first]
                for j in np.unique(trains).tolist():
                    tally.add(j, *np.unique(keys[trains == j], return_counts=True))
                if tally.full:
                    yield from dealt(tally, taken, bits)
            yield from dealt(tally, taken, bits)

        return as_batches(rows())

    def write_pairs(batches):
        def rows():
            for bucket, found in by_bucket(batches):
                arrays = pair_arrays(found, n_models, bits - taken)
                write(f"{folder}/pairs-{bucket}", **arrays)
                yield bucket, len(arrays["rest"]), b""

        return as_batches(rows())

    if model.words:
        for row in gathered(texts.mapInArrow(count_pairs, SCHEMA), 1 << taken).mapInArrow(write_pairs, SCHEMA).collect():
            model.pair_sizes[row.bucket] = row.kind
    return model


def log_probs(model: Bigrams, texts: pa.Array, k: float, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-probs of distinct pairs by model, NaN where a chance is zero; which of them each pair of the texts is;
    where each text's pairs begin, one more than texts)."""
    hashes, bounds = hashed_words(texts)
    numbers = model.numbers(hashes) + 1
    first = np.flatnonzero(followed(bounds))
    pairs = numbers[first].astype(np.uint64) << np.uint64(32) | numbers[first + 1].astype(np.uint64)
    pairs, which = np.unique(pairs, return_inverse=True)
    a, b = (pairs >> np.uint64(32)).astype(np.int64) - 1, (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
    counts, starts = (np.zeros((len(pairs), model.models), np.int64) for _ in range(2))
    known = np.flatnonzero((a >= 0) & (b >= 0))
    counts[known] = model.counts(a[known], b[known])
    start, back = np.unique(a, return_inverse=True)
    has = start >= 0
    of_start = np.zeros((len(start), model.models), np.int64)
    of_start[has] = model.starts(start[has])
    below = of_start[back] + k * vocab
    if not below.all():
        raise ZeroDivisionError("a word that training doesn't have, with k or the vocabulary 0, has no log-prob")
    chance = (counts + k) / below
    logs = np.log(chance, out=np.full(chance.shape, np.nan), where=chance > 0)
    return logs, which, np.searchsorted(first, bounds)


def score(
    texts: DataFrame, model: Bigrams, keys: list[str], text_col: str, k: float, vocab: int, kind: str, build,
) -> DataFrame:
    """`keys` and the columns `kind` of every text, which `build` makes of what `log_probs` gives."""
    made = texts.sparkSession.createDataFrame([], kind).schema.fields
    rows = texts.select(*[F.col(c) for c in keys], F.col(text_col).cast("string").alias("_text"))
    schema = StructType([*rows.select(*keys).schema.fields, *[StructField(f.name, f.dataType) for f in made]])

    def run(batches):
        for part in slices(batches, "_text", SLICE):
            columns = [part.column(i) for i in range(len(keys))] + build(*log_probs(model, part.column("_text"), k, vocab))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
