"""The conditional random field and the latent retrieval, against brute force and held-out rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from pplscope.llm import decontam, queries, toxicity


def test_marginals_equal_all_paths():
    r = np.random.default_rng(1)
    sizes = [3, 0, 1, 5, 0, 4]
    emissions, pairs, first = r.normal(0, 2, sum(sizes)), np.exp(r.normal(0, 1, (2, 2))), np.exp(r.normal(0, 1, 2))
    starts = np.cumsum([0, *sizes])[:-1]
    toxic, joint = toxicity.marginals(emissions, starts, pairs, first)
    for a, n in zip(starts, sizes, strict=True):
        total, want, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for path in itertools.product((0, 1), repeat=n):
            p = first[path[0]] if n else 1.0
            for i, s in enumerate(path):
                p *= np.exp(emissions[a + i] * s) * (pairs[path[i - 1], s] if i else 1.0)
            total += p
            want += p * np.array(path)
            for i in range(1, n):
                both[i, path[i - 1], path[i]] += p
        if n:
            assert np.allclose(toxic[a : a + n], want / total)
            assert np.allclose(joint[a : a + n].reshape(n, 2, 2), both / total)


def labelled(n, seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for _ in range(n):
        text = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(["scum", "Idiot", "vequ" + r.choice("abcdefgh") + "s"]))
        rows.append((" ".join(text), int(toxic)))
    return rows


def test_learns_words_and_first_letters(spark):
    train, test = labelled(1500, 1), labelled(300, 2)
    model = toxicity.fit(*map(list, zip(*train, strict=True)))
    rows = [(i, t) for i, (t, _) in enumerate(test)] + [(None, None), (1000, ""), (1001, "Idiot unseen, scum!"), (1001, "Idiot unseen, scum!")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "score", "_toxicity"]
    got = found.collect()
    right = sum((r._toxicity.score >= 0.5) == bool(test[r.doc_id][1]) for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert right >= 0.97 * len(test)
    edge = {r.doc_id: r._toxicity for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert edge[None].score == edge[1000].score < 0.5 and edge[None].spans == []
    assert [(s.start, s.end) for s in edge[1001].spans] == [(0, 5), (14, 18)]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    scores = {r._toxicity.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()}
    assert len(scores) == 1 and scores.pop() < 0.5
    assert toxicity.score(docs.limit(0), toxicity.Model()).count() == 0


def test_op7_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op7_toxicity_crf"](spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(rows[i].predicted, t) for i, t in labels.items() if rows[i].held_out]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows.values())
    assert sum(p == t for p, t in held) >= 0.95 * len(held) and sum(p and not t for p, t in held) == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ([r.randint(1, 6) for _ in range(r.randint(1, 30))] for _ in range(2))
        assert decontam.common(a, decontam.masks(np.array(b)), len(b)) == lcs(a, b)


def benchmark_case():
    r = random.Random(4)
    words = ["the", "of", "and"] * 40 + [f"w{i}" for i in range(600)]
    sentence = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    items = [(i, " ".join(sentence(r.randint(6, 14)) for _ in range(r.randint(2, 5)))) for i in range(30)] + [(90, None), (91, " "), (92, "w1 w2 w3 w4")]
    docs, want = [], set()
    for i in range(300):
        parts = [sentence(12) for _ in range(r.randint(0, 40))]
        if i % 5 == 0:
            item = r.randrange(30)
            text = items[item][1].split()
            if i % 10 == 0:  # a paraphrase: some words changed, the answer kept
                for k in r.sample(range(len(text) - len(text) // 3), max(1, len(text) // 10)):
                    text[k] = "changed"
            parts.insert(r.randint(0, len(parts)), " ".join(text).upper().replace(" ", "  "))
            want.add((i, item))
        docs.append((i, " ".join(parts)))
    return items, docs + [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[1][1]), (1002, items[1][1])], want | {(None, 0), (1002, 1)}


@pytest.mark.parametrize("block", [500, 12])
def test_leaks_are_found_and_nothing_else(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    items, docs, want = benchmark_case()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, terms string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = decontam.drop_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_no_window_that_passes_is_lost_to_the_cosine(spark):
    r = random.Random(8)
    vocabulary = [f"v{i}" for i in range(900)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    items = [(i, " ".join(sentence(n) for n in (8, 8, 8, 7))) for i in range(60)] + [(60, "v1 v2 v3 v4")]
    topics = [vocabulary[k : k + 20] for k in range(0, 600, 20)]
    talk = lambda t, n: " ".join(r.choices(topics[t], k=n))
    docs = [(i, talk(i % 30, 100)) for i in range(60)]
    for i, text in items[:60]:  # words outside the last sentence replaced by those around, down to PARAPHRASE
        words, topic = text.split(), r.randrange(30)
        for k in r.sample(range(24), r.choice([4, 8, 12])):
            words[k] = r.choice(topics[topic])
        docs.append((100 + i, " ".join([talk(topic, r.randint(0, 50)), *words, talk(topic, r.randint(0, 50))])))
    block = decontam.Block([(i, t, None) for i, t in items])
    rows = [np.array([block.terms.get(w, 0) for w in decontam.WORD.findall(t.lower())], np.int32) for _, t in docs]
    want, bits = set(), [(decontam.masks(i.terms), decontam.masks(i.answer)) for i in block.items]
    for (doc, _), terms in zip(docs, rows, strict=True):  # every window next to every item
        for item, (whole, ending) in zip(block.items, bits, strict=True):
            for start in range(0, len(terms), decontam.STEP):
                window = terms[start : start + item.window * decontam.STEP].tolist()
                if sum(t in whole for t in window) < 0.6 * len(item.terms):
                    continue
                overlap = decontam.common(window, whole, len(item.terms)) / len(item.terms)
                answer = decontam.common(window, ending, len(item.answer)) / len(item.answer)
                if overlap == 1 or len(item.terms) >= 8 and (overlap >= 0.8 or overlap >= 0.6 and answer >= 0.9):
                    want.add((doc, item.number))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontam.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in found} == want and len(want) >= 55
    assert min(x.cosine for x in found) < decontam.COSINE


def test_clean_rows_without_id_or_with_one_in_common_stay(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu. nu xi omicron pi."
    rows = [(None, item), (None, "clean words alone"), (None, None), (1, f"before {item} after"), (1, "other clean words"), (2, "more"), (2, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {tuple(r) for r in kept.collect()} == {rows[i] for i in (1, 2, 4, 5)} and kept.count() == 4


def test_empty_tables(spark):
    docs, bench = (spark.createDataFrame([], f"{n} long, text string") for n in ("doc_id", "item_id"))
    one, item = (spark.createDataFrame([(1, "some words here")], f"{n} long, text string") for n in ("doc_id", "item_id"))
    assert decontam.leaks(docs, item).count() == 0 and decontam.leaks(one, bench).count() == 0


def test_op1_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    words = lambda t: decontam.WORD.findall(t.lower())
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    docs = [(r.doc_id, words(r.text)) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    grams = {}
    for i, w in items:
        for k in range(len(w) - 3):
            grams.setdefault(tuple(w[k : k + 4]), set()).add(i)
    by_item, want = dict(items), set()
    for i, w in docs:  # a subsequence of 0.8 has runs of four words
        near = {}
        for k in range(len(w) - 3):
            for item in grams.get(tuple(w[k : k + 4]), ()):
                near.setdefault(item, []).append(k)
        for item, places in near.items():
            n = len(by_item[item])
            if any(lcs(w[max(0, p - n // 2) : p + n], by_item[item]) >= 0.8 * n for p in places[:: max(1, len(places) // 8)]):
                want.add((i, item))
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_latent_decontamination"](spark, d).collect()}
    assert len(want & got) >= 0.9 * len(want) and all(by_item[i] for _, i in got)
    assert len(got - want) <= 0.05 * len(got)
