"""The Kneser-Ney model against its definition in dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pplscope.llm import kneser_ney as K
from pplscope.llm.frames import table

DOCS = "doc_id long, text string, held_out string, lang int, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


class Plain:
    def __init__(self, texts):
        split = [tokens(t) for t in texts]
        self.c = Counter(w for t in split for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        # The start is told from a word of that spelling by its type.
        self.pair = Counter((0 if i == 0 else t[i - 1], w) for t in split for i, w in enumerate(t))
        self.context = Counter()
        for (a, _), n in self.pair.items():
            self.context[a] += n
        self.before = Counter(w for _, w in self.pair)
        self.d2 = K.discounts([sum(n == k for n in self.pair.values()) for k in (1, 2, 3, 4)])
        self.d1 = K.discounts([sum(n == k for n in self.before.values()) for k in (1, 2, 3, 4)])

    def word(self, w):
        if not self.pair:
            return 1.0
        rest = sum(self.d1[min(n, 3) - 1] for n in self.before.values()) / len(self.pair)
        n = self.before.get(w, 0)
        return (n - self.d1[min(n, 3) - 1] if n else 0) / len(self.pair) + rest / (self.v + 1)

    def p(self, a, w):
        if not self.context.get(a):
            return self.word(w)
        n = self.pair.get((a, w), 0)
        back = sum(self.d2[min(m, 3) - 1] for (b, _), m in self.pair.items() if b == a) / self.context[a]
        return (max(n - self.d2[min(n, 3) - 1], 0) if n else 0) / self.context[a] + back * self.word(w)

    def row(self, i, text):
        t = tokens(text)
        base = sum(math.log10((self.c.get(w, 0) + 0.5) / (self.n + 0.5 * (self.v + 1))) for w in t)
        return i, held(i), len(t), sum(w in self.c for w in t), self.n, base, sum(math.log10(self.p(0 if j == 0 else t[j - 1], w)) for j, w in enumerate(t))


def corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.7)) % 80}" for _ in range(200)] + ["É", "é", "Aa", "aA", "😀", "x.y"]
    rows = [(i, r.choice([" ", "\n", "\x0b "]).join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 7, 40])))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (None, "w1 w2 w1"), (None, None), rows[0], rows[0], (n + 3, "only here " * 2000)]


@pytest.mark.parametrize(("seed", "each"), [(1, 1 << 27), (2, 64)])
def test_scores_equal_the_definition(spark, tmp_path, seed, each):
    rows = corpus(seed, 80)
    docs = spark.createDataFrame([(*x, "h", 1, "s") for x in rows], DOCS).repartition(3)
    model = K.train(docs.where(~K.fold()), str(tmp_path / "model"), word_bytes=each, pair_bytes=each)
    got = sorted(map(tuple, K.score(docs, model, K.fold()).collect()), key=str)
    plain = Plain([t for i, t in rows if not held(i)])
    want = sorted((plain.row(i, t) for i, t in rows), key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    np.testing.assert_allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9)
    assert np.allclose(model.pair_d, plain.d2) and np.allclose(model.word_d, plain.d1)
    assert (each == 64) == (len(model.sizes) > 1)


def test_probabilities_add_up_to_one(spark, tmp_path):
    rows = corpus(3, 40)
    model = K.train(spark.createDataFrame([(*x, "h", 1, "s") for x in rows], DOCS), str(tmp_path / "model"))
    plain = Plain([t for _, t in rows])
    known = [w for w in plain.c if w is not None]
    for before in ([], ["w1"], ["w2"], ["never", "w1"], ["never"]):
        texts = pa.array([" ".join([*before, w]) for w in [*known, "neither"]])
        logs, _, first = K.log_probabilities(model, texts)
        mass = (10 ** logs[first + len(before)]).sum()
        logs, _, first = K.log_probabilities(model, pa.array([" ".join(before)]))
        assert math.isclose(mass + 10 ** logs[-1], 1, rel_tol=1e-9)


def test_without_rows_and_without_training(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert K.held_out_scores(none, str(tmp_path / "a")).count() == 0
    out = next(i for i in range(99) if held(i))
    only = spark.createDataFrame([(out, "a b", "h", 1, "s")], DOCS)
    assert tuple(K.held_out_scores(only, str(tmp_path / "b")).first()) == (out, True, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, small):
    rows = K.held_out_scores(table(spark, small, "documents")).where("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_a_folder_that_cannot_be_mapped_is_refused(spark, monkeypatch):
    monkeypatch.setattr(K.scratch, "new_path", lambda *_: "hdfs://store/x")
    with pytest.raises(ValueError, match="mounted"):
        K.shared_folder(spark)
