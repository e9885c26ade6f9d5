"""Shards of the hash tree and fingerprints by syncmers, against their definitions."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from pplscope.llm import hashtree, queries, syncmers


def test_op8(spark, small):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_hash_tree_shards"](spark, small).collect()
    assert len(rows) == len(source) and {r.law for r in rows} == {"key"}
    for r in rows:
        raw = source[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def ids(spark, n):
    return spark.range(n).selectExpr("id AS doc_id", "cast(id AS string) AS text")


def test_shares_follow_weights_and_moves_stay_in_changed_subtrees(spark):
    tree = hashtree.layout(40)
    heavier = [hashtree.Shard(s.number, s.region, s.rack, 3.0 if s.number == 9 else s.weight) for s in tree]
    rows = hashtree.place(ids(spark, 40_000), tree, heavier).collect()
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 40 and all(800 < c < 1200 for c in counts.values())
    heavy = Counter(r.grown_shard for r in rows)
    assert 2550 < heavy[9] < 3200
    region = {s.number: s.region for s in tree}
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert all(region[r.grown_shard] == 1 for r in moved)


def test_growing_moves_one_in_41_and_only_into_the_new_shard(spark):
    rows = hashtree.place(ids(spark, 40_000), hashtree.layout(40), hashtree.layout(41, founded=40)).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 800 < len(moved) < 1150


def test_slots_over_many_buckets_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hashtree, "ROWS_PER_BUCKET", 7)
    rows = [(i % 150, f"t{i % 150}", "s") for i in range(400)] + [(None, f"n{i}", "s") for i in range(200)] + [(900, None, "s"), (901, "", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = hashtree.assign(docs, hashtree.layout(8)).collect()
    assert len(got) == len(rows)
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in got if r.doc_id is None}) > 1
    assert {r.size for r in got if r.doc_id in (900, 901)} == {16}
    assert hashtree.assign(docs.limit(0), hashtree.layout(8)).count() == 0


def test_plan_has_no_python(spark, small):
    plan = queries.QUERIES["op8_hash_tree_shards"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_anchors(text, k, s):
    """Positions of the k-mers whose smallest s-mer, by the operator's own hash, is the first or last."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = syncmers._hashes(codes, s).tolist()
    return [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]


def test_anchors_are_closed_syncmers():
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "", "é😀" * 40, "short", "x" * 100, "a" * 24]
    for text, found in zip(texts, syncmers.anchors(texts), strict=True):
        want = brute_anchors(text, syncmers.K, syncmers.S)
        assert len(found) == (len(want) if want else int(bool(text)))
        if len(want) > 1:
            assert (found[:-1] & 255).tolist() == [b - a for a, b in zip(want, want[1:], strict=False)]
            assert max(b - a for a, b in zip(want, want[1:], strict=False)) <= syncmers.K - syncmers.S + 1
        alone = syncmers.anchors([text])[0]
        assert alone.tolist() == found.tolist()


def test_likeness():
    a, b = syncmers.anchors(["the quick brown fox jumps over the lazy dog again and again " * 4, "entirely different words stand in this one " * 6])
    none = a[:0]
    assert syncmers.likeness(a, a) == 1.0 and syncmers.likeness(none, none) == 1.0 and syncmers.likeness(a, none) == 0.0
    assert syncmers.likeness(a, b) < 0.1


@pytest.mark.parametrize("parts", [1, 6])
def test_op9_rows(spark, small, monkeypatch, parts):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(parts)
    source = sorted((r.doc_id, r.text) for r in docs.collect())
    rows = sorted(syncmers.compare_edits(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text) for r in rows] == source
    for i, r in enumerate(rows):
        text, following = source[i][1], source[(i + 1) % len(source)][1]
        q = len(text) // 4
        assert r.edited == text[: len(text) - q] + following[:q]
        if len(text) > 400 and len(following) > q:
            assert 0.6 < r.near_edited < 0.9
    apart = [r.near_next for r in rows]
    assert sorted(apart)[len(apart) // 2] < 0.05
    digest = {r.doc_id: r for r in queries.QUERIES["op9_syncmer_fingerprints"](spark, small).collect()}
    assert all(digest[r.doc_id].edited_sha256 == hashlib.sha256(r.edited.encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("rows", [[], [(5, "only one text")], [(None, None), (None, None), (3, "a"), (3, "a"), (3, "b")]])
def test_op9_edges(spark, rows):
    got = syncmers.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in got])) == sorted(str((i, t or "")) for i, t in rows)
