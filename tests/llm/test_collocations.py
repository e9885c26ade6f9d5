"""Collocations by their definition, and what the summaries behind them promise."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pplscope.llm import blocks, collocations as C

DOCS = "text string, lang string, phrase int, n string, size string, rank int, bucket string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, max_words=4, least=30, top=2000):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, max_words + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in often.items():
            for m in range(2, len(p)):
                gone |= {p[i : i + m] for i in range(len(p) - m + 1) if 100 * a >= 80 * often[p[i : i + m]]}
        found = []
        for p, a in often.items():
            if p not in gone:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    common = ["the", "The", "of", "Zürich", "été", "😀", "a-b", "ÉA"]
    phrases = ["new york city hall", "new york", "in order to", "as well as the", "united  states", "a\tpriori"]
    def text():
        return "".join(r.choice([r.choice(phrases), r.choice(common), f"w{r.randint(0, 40)}"]) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.choice([0, 3, 80])))
    rows = [(text(), r.choice(["en", "en", "de", None, ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" \t. ", "xx"), ("new york city hall " * 3000, "en"), rows[0], rows[0]]


@pytest.mark.parametrize("mass", [1 << 24, 500])
def test_collocations_equal_their_definition(spark, mass):
    rows = corpus(mass)
    docs = spark.createDataFrame([(*x, 1, "n", "s", 2, "b") for x in rows], DOCS).repartition(3)
    assert sorted(map(tuple, C.collocations(docs, bucket_mass=mass).collect())) == brute(rows)
    got = C.collocations(docs, max_words=3, least=5, top=7, bucket_mass=mass)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 5, 7)


def test_empty_table(spark):
    got = C.collocations(spark.createDataFrame([], DOCS))
    assert got.count() == 0
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("seed", range(8))
def test_summaries_lose_no_frequent_value(seed):
    r = np.random.default_rng(seed)
    values = np.concatenate([r.zipf(1.3, 4000), r.integers(0, 500, 2000)]).astype(np.uint64) % np.uint64(3000)
    r.shuffle(values)
    least = int(r.integers(2, 60))
    summary, other = C.MisraGries(len(values) // least), C.MisraGries(len(values) // least)
    for i, part in enumerate(np.array_split(values, 17)):
        (summary if i % 3 else other).merge(*np.unique(part, return_counts=True))
    summary.lost += other.lost
    summary.merge(other.values, other.counts)
    assert summary.lost < least and len(summary.values) <= summary.capacity
    true, n = np.unique(values, return_counts=True)
    assert set(true[n >= least]) <= set(summary.may_reach(least))


def test_marked_values_are_found():
    r = np.random.default_rng(3)
    keys = r.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for buckets in (1, 8):
        short = np.unique(keys >> np.uint64(32 - (buckets.bit_length() - 1)))
        rows = [type("Row", (), {"bucket": b, "block": C.bit_table(short[short >> np.uint64(32) == b] & np.uint64(0xFFFFFFFF), 1 << 16)}) for b in range(buckets - 1)]
        marked = C.Marked.collect(rows, buckets)
        known = (keys >> np.uint64(32 - (buckets.bit_length() - 1))) >> np.uint64(32) < buckets - 1
        assert marked.has(keys)[known].all()
        if buckets > 1:
            assert not marked.has(keys)[~known].any()
            assert marked.has(r.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.1


def test_blocks_round_trip():
    r = np.random.default_rng(4)
    for n in (0, 1, 2, 1000):
        values = np.unique(r.integers(0, 1 << int(r.integers(1, 64)), n, dtype=np.uint64))
        counts = r.choice([1, 2, 254, 255, 256, 1 << 40], len(values))
        got = blocks.unpack(blocks.pack(values, counts))
        assert (got[0] == values).all() and (got[1] == counts).all()
    values = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert (blocks.unpack(blocks.pack(values, np.ones(3, np.int64)))[0] == values).all()
