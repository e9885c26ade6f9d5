"""Collocations: phrases that occur far more often than their parts suggest, by language.

A first pass finds which phrases can be frequent. N-grams are dealt by hash over buckets; each bucket
keeps a Misra-Gries summary whose capacity exceeds its mass divided by the least count, so no frequent
n-gram is lost: `lost`, what the summary took off every counter, stays under that count. What survives
is marked in a bit table of bounded size. A second pass counts the marked phrases exactly, as texts.
Hashes that fall together only let more phrases through to the exact count.

Defined results: a null text is empty, a null language is `und`; equal rows count each. Words are told
apart by their bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pplscope import scratch
from pplscope.bounded import lookup_with_hot_keys
from pplscope.llm import blocks, words as W
from pplscope.llm.frames import buffers, slices, whole_text
from pplscope.llm.repeats import expand

SLICE = 1 << 21
#: N-gram occurrences a bucket is made for, and bits of the table of survivors.
BUCKET_MASS, TABLE_BITS = 1 << 24, 1 << 27
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
HEAD, PART = 0, 1


@dataclass
class Pieces:
    """Words of some texts, end to end: lower-case bytes with single blanks, each word's place in them and hash,
    and what two words of one piece share."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    text: np.ndarray


def read(texts: pa.Array) -> Pieces:
    raw, offsets = buffers(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, np.where(raw == 9, 32, raw)).astype(np.uint8)
    blank = raw == 32
    kept = ~(blank & np.concatenate([[False], blank[:-1]]))
    before = np.concatenate([[0], np.cumsum(kept)])
    raw, offsets = raw[kept], before[offsets]
    apart = SEPARATORS[raw]
    gap = apart | (raw == 32)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~gap & (np.concatenate([[True], gap[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(~gap & (np.concatenate([gap[1:], [True]]) | edge[1:])) + 1
    up, down = W._bytes.get(len(raw))
    total = W._totals(W.BYTE_VALUE[raw] * up)
    hashes = W.mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    text = np.searchsorted(offsets, starts, "right") - 1
    return Pieces(raw, starts, ends, hashes, np.cumsum(apart)[starts] + text if len(starts) else text, text)


def language_keys(langs: list[str]) -> np.ndarray:
    """A 64-bit key per language."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def grams(words: Pieces, salt: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, whole) of every run of `length` words: its hash with its language and length, and whether it lies in one piece."""
    n = len(words.hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    key = W.mix(W.windows(words.hashes, length) ^ (salt[words.text[:n]] + np.uint64(length)))
    return key, words.piece[length - 1 :] == words.piece[:n]


class MisraGries:
    """Counts of at most `capacity` values. `lost` is the most that any count is too low."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.values, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, values: np.ndarray, counts: np.ndarray) -> None:
        """Add counts (or another summary's) up; the largest count beyond the capacity comes off all of them."""
        values, counts = blocks.summed(np.concatenate([self.values, values]), np.concatenate([self.counts, counts]))
        if len(values) > self.capacity:
            over = len(counts) - self.capacity - 1
            off = int(np.partition(counts, over)[over])
            self.lost += off
            left = counts > off
            values, counts = values[left], counts[left] - off
        self.values, self.counts = values, counts

    def may_reach(self, least: int) -> np.ndarray:
        """Every value whose true count is `least` or more, and perhaps others."""
        return self.values[self.counts + self.lost >= least]


def survivors(docs: DataFrame, max_words: int, least: int, buckets: int) -> DataFrame:
    """(bucket, kind, block): per bucket, the bit table of the n-grams that may occur `least` times.

    Tasks send what they count as summaries, and each bucket's mass ahead of them, from which the capacity follows.
    """
    shift = np.uint64(32 - (buckets.bit_length() - 1))

    def summarise(batches):
        mass = np.zeros(buckets, np.int64)

        def rows():
            for part in slices(batches, "text", SLICE):
                words, salt = read(part.column("text")), language_keys(part.column("lang").to_pylist())
                found = []
                for length in range(1, max_words + 1):
                    key, whole = grams(words, salt, length)
                    found.append(key[whole] >> shift)
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                bucket = (values >> np.uint64(32)).astype(np.int64)
                mass[:] += np.bincount(bucket, counts, buckets).astype(np.int64)
                yield from blocks.deal(bucket, values & np.uint64(0xFFFFFFFF), counts, PART)
            for b in np.flatnonzero(mass).tolist():
                yield b, HEAD, mass[b].tobytes()

        return blocks.batch(rows())

    def merge(batches):
        def rows():
            for bucket, parts in blocks.by_bucket(batches):
                mass, summary, held, size = 0, None, [], 0
                for kind, block in parts:
                    if kind == HEAD:
                        mass += int(np.frombuffer(block, np.int64)[0])
                        continue
                    summary = summary or MisraGries(mass // least)
                    held.append(blocks.unpack(block))
                    size += len(held[-1][0])
                    if size > max(summary.capacity, 1 << 18):
                        summary.merge(*map(np.concatenate, zip(*held, strict=True)))
                        held, size = [], 0
                if held:
                    summary.merge(*map(np.concatenate, zip(*held, strict=True)))
                yield bucket, PART, bit_table(summary.may_reach(least), TABLE_BITS // buckets)

        return blocks.batch(rows())

    return blocks.gathered(docs.mapInArrow(summarise, blocks.SCHEMA), buckets).mapInArrow(merge, blocks.SCHEMA)


def _places(values: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each value among so many bits, a power of two."""
    spread, mask = W.mix(values + np.uint64(1)), np.asarray(bits, np.uint64) - np.uint64(1)
    return spread & mask, (spread >> np.uint64(32)) & mask


def bit_table(values: np.ndarray, most: int) -> bytes:
    """Two bits of each value set in a table of about 16 bits a value, at most `most`."""
    bits = np.zeros(max(64, min(most, blocks.power_of_two(16 * len(values)))), bool)
    for place in _places(values, len(bits)):
        bits[place] = True
    return np.packbits(bits, bitorder="little").tobytes()


@dataclass
class Marked:
    """The bit tables of all buckets, one after another."""

    table: np.ndarray
    begin: np.ndarray
    bits: np.ndarray
    shift: int

    @classmethod
    def collect(cls, found: list, buckets: int) -> Marked:
        # A bucket that nothing reached shares the zero byte at the front.
        begin, bits, parts = np.zeros(buckets, np.int64), np.ones(buckets, np.int64), [b"\0"]
        at = np.cumsum([1] + [len(r.block) for r in found])
        for row, start in zip(found, at, strict=False):
            begin[row.bucket], bits[row.bucket] = start, 8 * len(row.block)
            parts.append(bytes(row.block))
        return cls(np.frombuffer(b"".join(parts), np.uint8), begin, bits, 32 - (buckets.bit_length() - 1))

    def has(self, key: np.ndarray) -> np.ndarray:
        value = key >> np.uint64(self.shift)
        bucket = (value >> np.uint64(32)).astype(np.int64)
        bits = self.bits[bucket].astype(np.uint64)
        out = np.ones(len(key), bool)
        for place in _places(value & np.uint64(0xFFFFFFFF), bits):
            out &= (self.table[self.begin[bucket] + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def phrase_counts(docs: DataFrame, max_words: int = 4, least: int = 30, bucket_mass: int = BUCKET_MASS) -> DataFrame:
    """(lang, phrase, size, n) of every phrase of 1 to `max_words` words that occurs `least` times or more in a
    language, exactly counted; and per language a row of size 0 with the number of its words."""
    spark = docs.sparkSession
    rows = docs.select(whole_text("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    # Words are at most half the bytes (and one a text): so many n-grams and no more.
    buckets = min(blocks.power_of_two(max_words * blocks.text_bytes(rows) / 2 / bucket_mass), TABLE_BITS // 64)
    marked = spark.sparkContext.broadcast(Marked.collect(survivors(rows, max_words, least, buckets).select("bucket", "block").collect(), buckets))

    def count(batches) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            lang = part.column("lang")
            words, salt = read(part.column("text")), language_keys(lang.to_pylist())
            if not len(words.hashes):
                continue
            each = np.bincount(words.text, minlength=part.num_rows)
            yield _phrases(lang, np.flatnonzero(each), np.zeros((0,), np.uint8), np.zeros(int((each > 0).sum()), np.int64), 0, each[each > 0])
            passed = None
            for length in range(1, max_words + 1):
                key, whole = grams(words, salt, length)
                passed = whole if passed is None else whole & passed[:-1] & passed[1:]
                at = np.flatnonzero(passed)
                at = at[marked.value.has(key[at])]
                passed = np.zeros(len(key), bool)
                passed[at] = True
                if not len(at):
                    break
                _, first, n = np.unique(key[at], return_index=True, return_counts=True)
                at = at[first]
                size = words.ends[at + length - 1] - words.starts[at]
                _, where = expand(words.starts[at], size)
                yield _phrases(lang, words.text[at], words.raw[where], size, length, n)

    counted = rows.mapInArrow(count, "lang string, phrase string, size int, n long")
    return counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def _phrases(lang: pa.Array, text: np.ndarray, raw: np.ndarray, sizes: np.ndarray, length: int, n: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    phrase = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))).cast(pa.string())
    columns = [lang.take(pa.array(text)), phrase, pa.array(np.full(len(sizes), length, np.int32)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "n"])


def _part_counts(cuts: DataFrame, counts: DataFrame, side: str, name: str) -> DataFrame:
    """The cuts with the count of the part named `side`. A part that very many phrases share goes out by broadcast."""
    uses = cuts.groupBy("lang", side).agg(F.count("*").alias("uses"))
    parts = counts.where("size >= 1").select("lang", F.col("phrase").alias(side), F.col("n").alias(name)).join(uses, ["lang", side])
    return lookup_with_hot_keys(cuts, parts, ["lang", side], "uses", spread=F.col("phrase"))


def best_cuts(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every phrase of two words or more at its worst cut."""
    phrases = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"),
        F.expr("substring_index(phrase, ' ', k - size)").alias("rest"),
    )
    both = _part_counts(_part_counts(cuts, counts, "first", "l"), counts, "rest", "r")
    score = F.expr("cast(2000000 as decimal(38,0)) * a div (cast(l as decimal(20,0)) + r)")
    return both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"
    )


def kept_by_longer(counts: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, longer): the largest count of the longer phrases that a phrase lies in."""
    words = F.split("phrase", " ")
    inside = [(i, n) for n in range(2, max_words) for i in range(1, max_words - n + 2)]
    subs = F.array(*[F.when(F.lit(n) < F.col("size"), F.when(F.lit(i + n - 1) <= F.col("size"), F.array_join(F.slice(words, i, n), " "))) for i, n in inside])
    found = counts.where("size >= 3").select("lang", "n", F.explode(subs).alias("phrase")).where("phrase IS NOT NULL")
    return found.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, top: int = 2000, bucket_mass: int = BUCKET_MASS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    A phrase goes when a longer one accounts for four fifths of its occurrences. The first of each of 64
    parts of a language are found before they meet, so no task ranks a whole language.
    """
    counts = scratch.materialize(phrase_counts(docs, max_words, least, bucket_mass), "phrases")
    scored = best_cuts(counts)
    if max_words > 2:
        longer = kept_by_longer(counts, max_words)
        swallowed = F.col("longer").cast("decimal(38,0)") * 5 >= F.col("a").cast("decimal(38,0)") * 4
        scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~swallowed).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (["lang", "part"], ["lang"]):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return scored.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
