"""Near-duplicate classes against brute force over all pairs, and the sampler's law."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pplscope.llm import components, probminhash, queries


def shingles(text):
    """Weights of the shingles: a repeated one weighs a quarter more."""
    w = (text or "").split()
    counted = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {s: 1.25 if n > 1 else 1.0 for s, n in counted.items()}


def probability_jaccard(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x.keys() & y.keys())


def classes(rows, similarity=0.8):
    """Components of all pairs at or over the similarity; rows without words alone. Pairs that share under
    half are passed over: with weights up to a quarter apart they are far from similar."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    sets, holders = [shingles(t) for _, t in rows], defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in shared.items():
            if 2 * n >= len(s) + len(sets[j]) - n and root(i) != root(j) and probability_jaccard(s, sets[j]) >= similarity - 1e-9:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return groups


def as_sets(groups):
    return sorted(map(sorted, groups.values()))


def by_class(found):
    groups = defaultdict(list)
    for r in found:
        groups[r.class_id].append(r.doc_id)
    return groups


def near_copies(seed, families=12):
    r = random.Random(seed)
    rows = []
    for _ in range(families):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 5, 8, 40, 120, 300]))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, max(0, len(base) // 25))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, rows[i][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [1000, 2])
def test_classes_equal_brute_force(spark, seed, block):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = probminhash.classify(docs, block=block, set_block=block).collect()
    assert as_sets(by_class(found)) == as_sets(classes(rows))
    sizes = Counter(r.class_id for r in found)
    assert all(r.class_size == sizes[r.class_id] and r.class_id <= r.doc_id for r in found)


def test_copies_that_repeat_lines_differently_often_are_linked(spark):
    r, rows = random.Random(7), []
    line = lambda n: " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))
    for times in (20, 100, 300):
        for _ in range(4):
            body, repeated = line(150), line(40)
            rows += [(len(rows), f"{body} {repeated}"), (len(rows) + 1, " ".join([body, *[repeated] * times]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert as_sets(by_class(probminhash.classify(docs).collect())) == as_sets(classes(rows)) == [[i, i + 1] for i in range(0, len(rows), 2)]


def test_edges_and_keep_one(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a  b"), (None, "a b"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "lone words here")]
    docs = spark.createDataFrame([(*r, "x", 1, None, 2.0) for r in rows], "doc_id long, text string, key string, label int, _key string, _label double")
    found = sorted(((r.doc_id or 0, r.class_id, r.class_size) for r in probminhash.classify(docs).collect()))
    assert found == [(0, 4, 3), (1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (7, 7, 2), (7, 7, 2), (9, 9, 1)]
    kept = probminhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 7, 9]
    assert {tuple(r)[2:] for r in kept.collect()} == {("x", 1, None, 2.0)}
    assert probminhash.classify(docs.limit(0)).count() == 0 and probminhash.keep_one(docs.limit(0)).count() == 0


def test_op4_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = queries.QUERIES["op4_probminhash_classes"](spark, small).collect()
    assert as_sets(by_class(found)) == as_sets(classes(rows))


def test_agreement_estimates_the_probability_jaccard():
    r = np.random.default_rng(4)
    elements = r.integers(1, 1 << 63, 300, dtype=np.uint64)
    x, y = r.gamma(0.5, size=300), r.gamma(0.5, size=300)
    x[:50], y[250:] = 0, 0
    want = sum(1 / np.maximum(x / a, y / b).sum() for a, b in zip(x, y, strict=True) if a and b)
    a, b = (probminhash.signatures(elements[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, 4096) for w in (x, y))
    assert abs((a == b).mean() - want) < 5 * (want * (1 - want) / 4096) ** 0.5
    assert (a == probminhash.signatures(elements[x > 0], 7 * x[x > 0], np.zeros((x > 0).sum(), int), 1, 4096)).all()


def test_likeness_of_sets_by_definition():
    r = np.random.default_rng(8)
    members = [{int(e): r.choice([1.0, 1.25]) for e in r.choice(60, r.integers(0, 50), replace=False)} for _ in range(12)]
    sets = probminhash.Sets(*[[[e - 30 for e, w in m.items() if w == weight] for m in members] for weight in (1.0, 1.25)])
    for i, x in enumerate(members):
        others = np.array([j for j in range(len(members)) if j != i])
        assert np.allclose(sets.alike(i, others), [probability_jaccard(x, members[j]) for j in others])
    assert len(sets.alike(0, np.zeros(0, np.int64))) == 0


def test_signature_does_not_depend_on_neighbours():
    r = np.random.default_rng(5)
    element, owner = r.integers(1, 1 << 63, 2000, dtype=np.uint64), np.sort(r.integers(0, 40, 2000))
    whole = probminhash.signatures(element, np.ones(2000), owner, 40)
    for i in (0, 7, 39):
        own = owner == i
        assert (whole[i] == probminhash.signatures(element[own], np.ones(own.sum()), np.zeros(own.sum(), int), 1, patience=9)[0]).all()


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(64)]
    found = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    assert {n: l for n, l in found.items() if n != l} == {n: root(n) for n in parent if root(n) != n}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
