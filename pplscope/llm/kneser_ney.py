"""Perplexity by an interpolated modified Kneser-Ney model of word pairs.

Spark counts, in three shuffles of packed blocks, and writes the model as sorted arrays, one file per
bucket, in a folder that all executors share; workers map the files into memory and search them. A
word is known by a 64-bit hash, its place in the sorted hashes is its number, and a pair is the two
numbers side by side; the pairs are dealt over files by a hash of that. So the model has every word
and pair of the training texts, whatever its size, and a worker reads the pages it needs.

A pair's probability is max(c - D(c), 0) / c(context) + gamma(context) * p(word); the word's is the same
over the number of different words before it, with the rest spread over all known words and one
unknown. D has three values for each, from the counts of counts (Chen and Goodman); where these leave
one undefined or out of range, as in tiny tables, all three are 0.5, 1 and 1.5. A text starts in a
context of its own and has an end, which is a token. The context of an unknown word is none: the
next word's own probability counts.

Defined results: a null text is empty, its score is that of the end alone. A row without id is never
held out. Equal rows count each. Without training texts every probability is one. Other columns are
not read. Two words share a hash with a chance of one in 2**64 for each two.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope import scratch
from pplscope.llm import blocks, words as W
from pplscope.llm.frames import slices, whole_text

SLICE = 1 << 22
#: Bytes of text for each file of words and of pairs. There are at most MOST_FILES of each.
WORD_BYTES, PAIR_BYTES, MOST_FILES = 1 << 27, 1 << 25, 1 << 16
END = np.uint64(0x5851F42D4C957F2D)
FALLBACK = (0.5, 1.0, 1.5)
CONTINUES, ONCE, TWICE, OFTEN = 1, 2, 3, 4
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for a model under the shared one, as a path of the file system."""
    path = scratch.new_path(spark, "kneser-ney")
    if path.startswith("file:"):
        return "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"model files are mapped into memory and {path} can't be: pass a folder that all executors have mounted")
    return path


def write(folder: str, name: str, values: np.ndarray) -> None:
    """An array as a file, whole or not at all: a task that runs again writes the same."""
    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as file:
        np.save(file, values)
    os.replace(part, f"{folder}/{name}.npy")


@lru_cache(4 * MOST_FILES)
def mapped(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as the largest takes."""
    return values.astype(np.min_scalar_type(int(values.max()))) if values.size else values.astype(np.uint8)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by the highest bits; there are a power of two."""
    bits = buckets.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def total(parts: Iterable[tuple[np.ndarray, np.ndarray]], limit: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values and summed counts of many blocks; what is held is added up whenever it doubles."""
    held, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > max(limit, len(held[0][0])):
            held, size = [blocks.summed(*map(np.concatenate, zip(*held, strict=True)))], 0
    return blocks.summed(*map(np.concatenate, zip(*held, strict=True)))


def discounts(n: Iterable[int]) -> tuple[float, float, float]:
    """D(1), D(2), D(3 and more) from how many things were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (int(x) for x in n)
    if min(n1, n2, n3) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return FALLBACK


def of_counts(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


@dataclass
class Model:
    """Where the arrays are, and the few numbers about all of them."""

    folder: str
    sizes: np.ndarray
    pair_files: int
    texts: int
    tokens: int
    pairs: int = 0
    pair_d: tuple[float, float, float] = FALLBACK
    word_d: tuple[float, float, float] = FALLBACK
    seen: tuple[int, int, int] = (0, 0, 0)
    pair_sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def base(self) -> np.ndarray:
        """Number of the first word of each file, and of all words."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    @property
    def words(self) -> int:
        return int(self.sizes.sum())

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, -1 where it is unknown."""
        unique, back = np.unique(hashes, return_inverse=True)
        out, base = np.full(len(unique), -1, np.int64), self.base
        for b, start, stop in blocks.runs(bucket_of(unique, len(self.sizes))):
            if self.sizes[b]:
                known = mapped(self.folder, f"words-{b}")
                at = np.minimum(np.searchsorted(known, unique[start:stop]), len(known) - 1)
                out[start:stop] = np.where(known[at] == unique[start:stop], base[b] + at, -1)
        return out[back]

    def of_words(self, name: str, numbers: np.ndarray, width: int = 1) -> np.ndarray:
        """Rows of a word array by number, which are ascending; the start of a text has the number after the last word."""
        out, base = np.zeros((len(numbers), width), np.int64), self.base
        for b, start, stop in blocks.runs(np.searchsorted(base, numbers, "right") - 1):
            out[start:stop] = mapped(self.folder, f"{name}-{b}")[numbers[start:stop] - base[b]].reshape(-1, width)
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each pair occurs in training."""
        bucket = bucket_of(W.mix(keys), self.pair_files)
        order = np.lexsort((keys, bucket))
        keys, found = keys[order], np.zeros(len(keys), np.int64)
        for b, start, stop in blocks.runs(bucket[order]):
            if self.pair_sizes[b]:
                known = mapped(self.folder, f"pairs-{b}")
                at = np.minimum(np.searchsorted(known, keys[start:stop]), len(known) - 1)
                found[start:stop] = np.where(known[at] == keys[start:stop], mapped(self.folder, f"times-{b}")[at], 0)
        out = np.empty(len(keys), np.int64)
        out[order] = found
        return out

    def word_probabilities(self, continues: np.ndarray) -> np.ndarray:
        """From the number of different words before a word; 0 for the unknown one."""
        if not self.pairs:
            return np.ones(len(continues)) / (self.words + 1)
        d = np.array([0.0, *self.word_d])[np.minimum(continues, 3)]
        rest = sum(x * n for x, n in zip(self.word_d, self.seen, strict=True)) / self.pairs
        return np.maximum(continues - d, 0) / self.pairs + rest / (self.words + 1)


def hashes(texts: pa.Array) -> W.Words:
    return W.read(pc.ascii_lower(pc.fill_null(texts, "")))


def in_context(numbers: np.ndarray, bounds: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, token, first): every text's words and end, what stands before each, where each text begins."""
    texts = len(bounds) - 1
    after = bounds[1:] + np.arange(texts)
    token = np.full(len(numbers) + texts, end, np.int64)
    token[np.delete(np.arange(len(token)), after)] = numbers
    before = np.concatenate([[start], token[:-1]]).astype(np.int64)
    first = np.concatenate([[0], after[:-1] + 1]).astype(np.int64)
    before[first] = start
    return before, token, first


def _key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | token.astype(np.uint64)


def _numbers(block: bytes) -> np.ndarray:
    return np.frombuffer(block, np.int64)


def train(docs: DataFrame, folder: str | None = None, text_column: str = "text",
          word_bytes: int = WORD_BYTES, pair_bytes: int = PAIR_BYTES) -> Model:
    """Count words, then pairs, then what words are seen with, and write the arrays."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    texts = docs.select(whole_text(text_column).alias("text"))
    size = blocks.text_bytes(texts)
    word_files, pair_files = (min(MOST_FILES, blocks.power_of_two(size / each)) for each in (word_bytes, pair_bytes))

    def count_words(batches):
        def rows():
            for part in slices(batches, "text", SLICE):
                found = np.append(hashes(part.column("text")).hashes, END)
                values, counts = np.unique(found, return_counts=True)
                counts[np.searchsorted(values, END)] += part.num_rows - 1
                yield from blocks.deal(bucket_of(values, word_files), values, counts, 1)

        return blocks.batch(rows())

    def write_words(batches):
        def rows():
            for bucket, parts in blocks.by_bucket(batches):
                values, counts = total(blocks.unpack(block) for _, block in parts)
                write(folder, f"words-{bucket}", values)
                write(folder, f"counts-{bucket}", narrow(counts))
                ends = counts[values == END].sum()
                yield bucket, 0, np.array([len(values), counts.sum(), ends], np.int64).tobytes()

        return blocks.batch(rows())

    written = blocks.gathered(texts.mapInArrow(count_words, blocks.SCHEMA), word_files).mapInArrow(write_words, blocks.SCHEMA).collect()
    sizes, tokens, ends = np.zeros(word_files, np.int64), 0, 0
    for row in written:
        sizes[row.bucket], n, end = _numbers(row.block)
        tokens, ends = tokens + int(n), ends + int(end)
    model = Model(folder, sizes, pair_files, ends, tokens, pair_sizes=np.zeros(pair_files, np.int64))
    if not model.words:
        return model
    if model.words >= (1 << 32) - 1:
        raise ValueError(f"{model.words} words; pairs hold numbers of 32 bits")

    def count_pairs(batches):
        end = int(model.numbers(np.array([END]))[0])

        def rows():
            for part in slices(batches, "text", SLICE):
                words = hashes(part.column("text"))
                before, token, _ = in_context(model.numbers(words.hashes), words.bounds, model.words, end)
                keys, counts = np.unique(_key(before, token), return_counts=True)
                bucket = bucket_of(W.mix(keys), pair_files)
                order = np.argsort(bucket, kind="stable")
                yield from blocks.deal(bucket[order], keys[order], counts[order], 1)

        return blocks.batch(rows())

    def write_pairs(batches):
        def rows():
            base = model.base
            for bucket, parts in blocks.by_bucket(batches):
                keys, counts = total(blocks.unpack(block) for _, block in parts)
                write(folder, f"pairs-{bucket}", keys)
                write(folder, f"times-{bucket}", narrow(counts))
                yield -1, bucket, np.array([len(keys), *of_counts(counts)], np.int64).tobytes()
                before, token = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
                shown = ((CONTINUES, token), (ONCE, before[counts == 1]), (TWICE, before[counts == 2]), (OFTEN, before[counts > 2]))
                for kind, numbers in shown:
                    values, n = np.unique(numbers, return_counts=True)
                    yield from blocks.deal(np.searchsorted(base, values.astype(np.int64), "right") - 1, values, n, kind)

        return blocks.batch(rows())

    found = blocks.gathered(texts.mapInArrow(count_pairs, blocks.SCHEMA), pair_files).mapInArrow(write_pairs, blocks.SCHEMA)
    found = scratch.materialize(found, "continuations")
    of_pairs = np.zeros(4, np.int64)
    for row in found.where("bucket < 0").collect():
        model.pair_sizes[row.kind], *n = _numbers(row.block)
        of_pairs += n

    def write_lower(batches):
        def rows():
            base = np.append(model.base, model.words + 1)
            for bucket, parts in blocks.by_bucket(batches):
                table = np.zeros((int(base[bucket + 1] - base[bucket]), 4), np.int64)
                for kind, block in parts:
                    values, counts = blocks.unpack(block)
                    table[values.astype(np.int64) - base[bucket], kind - 1] += counts
                write(folder, f"lower-{bucket}", narrow(table))
                continues = table[:, 0] if bucket < len(sizes) else table[:0, 0]
                often = [(continues == 1).sum(), (continues == 2).sum(), (continues > 2).sum()]
                yield bucket, 0, np.array([*of_counts(continues), *often, continues.sum()], np.int64).tobytes()

        return blocks.batch(rows())

    lower = blocks.gathered(found.where("bucket >= 0"), word_files + 1).mapInArrow(write_lower, blocks.SCHEMA)
    sums = np.sum([_numbers(row.block) for row in lower.collect()], axis=0)
    model.pair_d, model.word_d = discounts(of_pairs), discounts(sums[:4])
    model.seen, model.pairs = tuple(int(x) for x in sums[4:7]), int(sums[7])
    return model


def log_probabilities(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log10 of every token's probability, its count in training, where each text begins)."""
    words = hashes(texts)
    end = int(model.numbers(np.array([END]))[0])
    before, token, first = in_context(model.numbers(words.hashes), words.bounds, model.words, end)
    unique, back = np.unique(token, return_inverse=True)
    known = unique >= 0
    lower, counts = np.zeros((len(unique), 4), np.int64), np.zeros(len(unique), np.int64)
    if model.words:
        lower[known] = model.of_words("lower", unique[known], 4)
        counts[known] = model.of_words("counts", unique[known])[:, 0]
    chance = model.word_probabilities(lower[:, 0])[back]
    if model.words:
        context, of = np.unique(before, return_inverse=True)
        has = context >= 0
        times, spread = np.zeros(len(context)), np.ones(len(context))
        follow = model.of_words("lower", context[has], 4)[:, 1:]
        is_start = context[has] == model.words
        times[has] = np.where(is_start, model.texts, 0)
        times[np.flatnonzero(has)[~is_start]] = model.of_words("counts", context[has][~is_start])[:, 0]
        spread[has] = follow @ np.array(model.pair_d) / np.maximum(times[has], 1)
        # The end is never a context, so every known one occurs as often as it is followed.
        pair, which = np.flatnonzero((before >= 0) & (token >= 0)), None
        keys, which = np.unique(_key(before[pair], token[pair]), return_inverse=True)
        c = model.pair_counts(keys)[which]
        own = np.zeros(len(token))
        own[pair] = np.maximum(c - np.array([0.0, *model.pair_d])[np.minimum(c, 3)], 0) / times[of[pair]]
        chance = own + spread[of] * chance
    return np.log10(chance), counts[back], first


def score(docs: DataFrame, model: Model, held_out, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's log10 probability, next to that of counted words alone (each count and one half more)."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"), whole_text(text_column).alias("text"))

    def each(batches):
        for part in slices(batches, "text", SLICE):
            logs, counts, first = log_probabilities(model, part.column("text"))
            alone = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
            n = np.diff(np.append(first, len(logs)))
            columns = [
                part.column("doc_id"), part.column("held_out"), pa.array(n.astype(np.int64)),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), first)), pa.array(np.full(len(n), model.tokens, np.int64)),
                pa.array(np.add.reduceat(alone, first)), pa.array(np.add.reduceat(logs, first)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(each, RESULT)


def fold(id_column: str = "doc_id"):
    """Whether a row is held out: one in five by its id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def held_out_scores(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Scores of all rows by a model of those that are not held out."""
    return score(docs, train(docs.where(~fold()), folder), fold())
