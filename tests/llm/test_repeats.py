"""Repeated passages: both operators against their definition, by brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pplscope.llm import queries, repeats, rlz, suffixes, words as W
from tools.compare import rows as as_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(rows, length):
    """Per row, which words lie in a window that starts anywhere else, too."""
    split = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        mask = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                mask[i : i + length] = [True] * length
        out.append((w, mask))
    return out


def corpus(seed: int, n: int = 60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["é😀", " ", "x y"]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randint(4, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 15))) for _ in range(r.randint(0, 6))]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    rows += [(n, "ha " * 50), (n + 1, "ha " * 49 + "ho"), (n + 2, None), (n + 3, ""), (None, rows[0][1]), (None, rows[1][1]), (5, rows[5][1])]
    return rows


@pytest.fixture(params=[50_000, 3])
def hot(request):
    return request.param


@pytest.mark.parametrize(("length", "gram"), [(12, 4), (7, 7)])
def test_rlz_equals_the_definition(spark, monkeypatch, hot, length, gram):
    monkeypatch.setattr(repeats, "OFTEN_IN_TASK", 1)
    rows = corpus(length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rlz.dedup(docs, length, gram, hot=hot).collect()
    want = Counter()
    for (i, _), (w, mask) in zip(rows, covered(rows, length), strict=True):
        want[i, len(w), sum(mask), " ".join(x for x, m in zip(w, mask, strict=True) if not m)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(WORD.findall(t or ""))
    for r in got:  # every factor stands in its reference
        for f in r.factors:
            own = [w[f.start : f.start + f.words] for w in text[r.doc_id]]
            ref = -(1 << 63)
            there = [w[f.ref_start : f.ref_start + f.words] for w in text[None if f.ref_doc == ref else f.ref_doc]]
            assert any(a == b for a in own for b in there)


@pytest.mark.parametrize(("length", "gram"), [(12, 4), (7, 6)])
def test_suffixes_equal_the_definition(spark, monkeypatch, hot, length, gram):
    monkeypatch.setattr(repeats, "OFTEN_IN_TASK", 1)
    rows = corpus(100 + length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.repeated_passages(docs, length, gram, hot=hot).collect()
    want = set()
    for (i, _), (_, mask) in zip(rows, covered(rows, length), strict=True):
        spans = tuple((m.start(), m.end() - m.start()) for m in re.finditer("x+", "".join("x" if m else "." for m in mask)))
        if spans:
            want.add((i, sum(mask), spans))
    assert {(r.doc_id, r.n_repeated, tuple((p.start, p.words) for p in r.passages)) for r in got} == want
    assert len(got) == len({(i, t) for (i, t), (_, m) in zip(rows, covered(rows, length), strict=True) if any(m)})


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rlz.dedup(none).count() == 0 and suffixes.repeated_passages(none).count() == 0


def test_words_and_windows():
    texts = pa.array(["a  b\x0bc é", None, "", " a b ", "\x85 \xa0"])
    words = W.read(texts.slice(0, 5))
    want = [WORD.findall(t or "") for t in texts.to_pylist()]
    assert np.diff(words.bounds).tolist() == [len(w) for w in want]
    raw = words.raw.tobytes()
    assert [raw[a:b].decode() for a, b in zip(words.starts, words.ends, strict=True)] == sum(want, [])
    assert words.hashes[0] == words.hashes[4] and len(set(words.hashes.tolist())) == len(set(sum(want, [])))
    assert W.read(texts.slice(3, 1)).hashes.tolist() == words.hashes[4:6].tolist()


@pytest.mark.parametrize("name", ["op2_suffix_repeats", "op5_rlz_dedup"])
def test_queries_equal_their_sql(spark, small, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df, result = queries.QUERIES[name](spark, small), db.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert as_rows(df.columns, [tuple(r) for r in df.collect()]) == as_rows(names, result.fetchall())


def test_kept_digest(spark, small):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_rlz_dedup"](spark, small).where("n_removed = 0").limit(20).collect():
        assert r.kept_sha256 == hashlib.sha256(" ".join(WORD.findall(text[r.doc_id])).encode()).hexdigest()
