"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the collection itself, cut into blocks: the runs of words around each anchor (the
smallest k-gram of a window). Blocks with one anchor meet in one task, which indexes every window of
`length` words of theirs and factors each block against all others: a factor is a run of windows
that go on occurring at the place in the reference where the first of them was found; where the
reference ends or leaves the document's words, the next factor begins, and the windows over the
border are looked up on their own. Windows with equal words have equal anchors, so a document's
factors are those against the whole collection, and nothing is compared with all of it.

A word is covered when it lies in a window that also starts anywhere else, in the same document or
another one. Anchors with very many blocks take the way of `repeats.hot_windows`.

Null and empty texts have no words; texts shorter than a window have no factors; repeated rows are
occurrences of their own, so both are covered; rows without id are told apart by their text; an
empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope.llm import words as W
from pplscope.llm.frames import partitions, slices
from pplscope.llm.repeats import HOT, among, expand, hot_anchors, hot_windows, named

LENGTH, GRAM = 35, 10
PACK_BYTES = 8 << 20
FACTOR = "_order long, _key long, start int, windows int, ref_order long, ref_start int"
# One block of a payload, and one window of it: six bytes beside the anchor's eight tell windows apart.
BLOCK = np.dtype([("anchor", "<u8"), ("order", "<i8"), ("key", "<i8"), ("first", "<i4"), ("count", "<i4")])


def _blocks(rows: DataFrame, length: int, gram: int, hot, buckets: int) -> DataFrame:
    """(bucket, blocks, windows): the blocks of several texts, packed by the bucket of their anchor."""

    def pack(batches):
        held, size = [], 0
        for part in slices(batches, "text"):
            words = W.read(part.column("text"))
            p = W.pieces(words, length, gram)
            keep = np.flatnonzero(~among(p.anchor, hot.value))
            blocks = np.empty(len(keep), BLOCK)
            text = p.text[keep]
            blocks["anchor"], blocks["count"] = p.anchor[keep], p.count[keep]
            blocks["first"] = p.first[keep] - words.bounds[text]
            for name in ("order", "key"):
                blocks[name] = part.column("_" + name).to_numpy()[text]
            _, starts = expand(p.first[keep], p.count[keep])
            low = W.windows(words.hashes, length)[starts].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            held.append((blocks, low))
            size += low.nbytes + blocks.nbytes
            if size > PACK_BYTES:
                yield _packed(held, buckets)
                held, size = [], 0
        if held:
            yield _packed(held, buckets)

    return rows.select("text", "_order", "_key").mapInArrow(pack, "bucket int, blocks binary, windows binary")


def _packed(held, buckets: int) -> pa.RecordBatch:
    blocks, low = np.concatenate([b for b, _ in held]), np.concatenate([w for _, w in held])
    bucket = ((blocks["anchor"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    first = np.concatenate([[0], np.cumsum(blocks["count"], dtype=np.int64)])[:-1]
    _, source = expand(first[order], blocks["count"][order].astype(np.int64))
    blocks, low = blocks[order], low[source]
    used, at = np.unique(bucket[order], return_index=True)
    at = np.append(at, len(blocks))
    window_at = np.concatenate([[0], np.cumsum(blocks["count"], dtype=np.int64)])[at]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(used.astype(np.int32)),
        "blocks": pa.array([blocks[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        "windows": pa.array([low[a:b].tobytes() for a, b in zip(window_at[:-1], window_at[1:], strict=True)], pa.binary()),
    })


def _parse(batches):
    """Factor all blocks of a task against each other."""
    blocks, low = [], []
    for batch in batches:
        blocks += [np.frombuffer(x.as_buffer(), BLOCK) for x in batch.column("blocks")]
        low += [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("windows")]
    if not blocks:
        return
    blocks, low = np.concatenate(blocks), np.concatenate(low).reshape(-1, 6)
    value = np.zeros((len(low), 8), np.uint8)
    value[:, :6] = low
    del low
    block, start = expand(blocks["first"].astype(np.int64), blocks["count"].astype(np.int64))
    value = value.view("<u8").ravel() | ((blocks["anchor"] & np.uint64(0xFFFF)) << np.uint64(48))[block]

    # The index: equal windows side by side; only those that occur again matter.
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if not len(again):
        return
    doc, key, place, value = blocks["order"][block[again]], blocks["key"][block[again]], start[again], value[again]
    order = np.lexsort((place, key, doc, value))
    doc, key, place, value = doc[order], key[order], place[order], value[order]
    run_start = np.concatenate([[True], value[1:] != value[:-1]])
    run = np.cumsum(run_start) - 1
    firsts = np.flatnonzero(run_start)
    lasts = np.append(firsts[1:], len(value)) - 1
    ref = np.where(run_start, lasts[run], firsts[run])
    ref_doc, ref_key, ref_place = doc[ref], key[ref], place[ref]

    # Factors: the document and the reference go on together.
    order = np.lexsort((place, key, doc))
    doc, key, place, ref_doc, ref_key, ref_place = (x[order] for x in (doc, key, place, ref_doc, ref_key, ref_place))
    goes_on = (
        (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (place[1:] == place[:-1] + 1)
        & (ref_doc[1:] == ref_doc[:-1]) & (ref_key[1:] == ref_key[:-1]) & (ref_place[1:] == ref_place[:-1] + 1)
    )
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    yield pa.RecordBatch.from_pydict({
        "_order": pa.array(doc[begin]), "_key": pa.array(key[begin]), "start": pa.array(place[begin].astype(np.int32)),
        "windows": pa.array(np.diff(np.append(begin, len(doc))).astype(np.int32)),
        "ref_order": pa.array(ref_doc[begin]), "ref_start": pa.array(ref_place[begin].astype(np.int32)),
    })


def factors(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(_order, _key, start, windows, ref_order, ref_start): a factor covers the words from `start` on,
    `windows + length - 1` of them, which the reference document has from `ref_start` on."""
    often = hot_anchors(rows, length, gram, hot)
    buckets = partitions(rows.sparkSession)
    dealt = _blocks(rows, length, gram, often, buckets).repartitionById(buckets, F.col("bucket"))
    found = dealt.select("blocks", "windows").mapInArrow(_parse, FACTOR)
    more = hot_windows(rows, length, gram, often)
    return found if more is None else found.unionByName(more.withColumn("windows", F.lit(1)))


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text",
          hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, factors) per row: the words not covered, joined by a blank, and
    the factors (start and number of words, reference document and place) that cover the others."""
    rows = named(docs, id_column, text_column)
    by_row = (
        factors(rows, length, gram, hot)
        .groupBy("_order", "_key").agg(F.collect_list(F.struct("start", "windows", "ref_order", "ref_start")).alias("found"))
    )
    kind = "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:int,words:int,ref_doc:long,ref_start:int>>"

    def cut(batches):
        for part in slices(batches, "text"):
            words = W.read(part.column("text"))
            raw, out = words.raw.tobytes(), {"n_words": [], "n_removed": [], "kept": [], "factors": []}
            for i, found in enumerate(part.column("found").to_pylist()):
                a, b = words.bounds[i], words.bounds[i + 1]
                covered = np.zeros(b - a + 1, np.int64)
                listed = sorted({tuple(f.values()) for f in found or ()})
                for start, count, _, _ in listed:
                    covered[start] += 1
                    covered[start + count + length - 1] -= 1
                left = np.flatnonzero(np.cumsum(covered[:-1]) == 0) + a
                out["n_words"].append(int(b - a))
                out["n_removed"].append(int(b - a - len(left)))
                spans = zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)
                out["kept"].append(b" ".join([raw[s:e] for s, e in spans]).decode())
                out["factors"].append([
                    {"start": s, "words": n + length - 1, "ref_doc": d, "ref_start": r} for s, n, d, r in listed
                ])
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{
                n: pa.array(v, t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.string(), FACTORS), strict=True)
            }})

    return rows.join(by_row, ["_order", "_key"], "left").select("doc_id", "text", "found").mapInArrow(cut, kind)


FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))
