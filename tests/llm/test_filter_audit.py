"""The filter audit against a replay of every order, document by document."""

from __future__ import annotations

import random
import re
from itertools import permutations
from math import factorial

from pplscope.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, words array<string>, part int, hash string, failed string, n string, first string"
LABELS = "doc_id long, quality int, toxic int, n string, good string"


def fails(text: str, copied: bool) -> str:
    w = WORD.findall(text)
    found = {
        "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)), "E": copied,
    }
    return "".join(f for f, bad in found.items() if bad)


def replay(rows, labels):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    good, toxic = ({i for i, *l in labels if l[k] == 1} for k in (0, 1))
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        parts.setdefault(lang or "", []).append((fails(text, i is not None and i > first[text]), i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        share, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = list(docs)
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                share[f] += len(hit)
                made.append((
                    part, "".join(order), step, len(left), len(hit), sum(f in d[0] for d in docs) - len(hit),
                    sum(d[0] == f for d in docs), sum(d[1] for d in hit), sum(d[2] for d in hit),
                ))
        out += [(*m, share[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def test_audit_equals_a_replay(spark):
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ä", "é😀", "&", "ABC", " x"]
    texts = [r.choice([" ", "\n", "\x0b\t"]).join(r.choice(vocabulary[: r.choice([3, 305])]) for _ in range(r.choice([0, 5, 199, 200, 201, 260]))) for _ in range(25)]
    rows = [(i, r.choice(texts), r.choice(["en", "de", None, ""])) for i in range(90)]
    rows += [(90, None, "en"), (91, "", "en"), (None, texts[0], "de"), (None, texts[0], "de"), (None, None, None), rows[3], rows[3], (3, "other", "en"), (95, "x" * 200_000 + " #", "de")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 99, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, ["c"], 7, "h", "f", "n", "first") for x in rows], DOCS).repartition(3)
    got = filter_audit.audit_documents(docs, spark.createDataFrame([(*x, "n", "g") for x in labels], LABELS))
    assert sorted(map(tuple, got.collect())) == replay(rows, [x for x in labels if x[0] is not None])
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(none, labels).count() == 0
    one = spark.createDataFrame([(1, "x", "en", None, None, None, None, None, None)], DOCS)
    assert filter_audit.audit_documents(one, labels).count() == 600


def test_shapley_values_solve_the_game():
    r = random.Random(2)
    for n in (1, 2, 3, 5):
        value = [0] + [r.randint(-50, 10**18) for _ in range((1 << n) - 1)]
        want = [0] * n
        for order in permutations(range(n)):
            before = 0
            for i in order:
                want[i] += value[before | 1 << i] - value[before]
                before |= 1 << i
        assert [x * factorial(n) for x in filter_audit.shapley(value, n)] == want
