"""Repeated passages by a sparse suffix array.

Only suffixes that begin at content-selected positions are kept: each window of `length` words has
one, the place of its smallest k-gram, so two copies of a passage keep suffixes at the same places
in it. Suffixes whose first k-gram occurs once are dropped; the others are sorted by their words,
and neighbours compared: the common prefix of neighbours cuts the sorted order into runs that share
the words to the right of the anchor, and within a run suffixes are extended to the left. Where
right and left together reach `length` words, the passage is there twice. A suffix needs `length`
words to the right and `length - k` to the left and no more: longer passages have further anchors,
and what these find overlaps.

So a word is reported exactly when it lies in a window of `length` words that starts anywhere else,
too. Anchors with very many suffixes take the way of `repeats.hot_windows`.

Null and empty texts, and texts shorter than a window, have no passages. A row repeated as a whole
(id and text) is reported once. Rows without id are told apart by their text. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pplscope.llm import words as W
from pplscope.llm.frames import partitions, slices
from pplscope.llm.order import LOWEST
from pplscope.llm.repeats import HOT, among, hot_anchors, hot_windows, named

LENGTH, GRAM = 50, 12
PACK_BYTES = 8 << 20
PLACE = [("anchor", "<u8"), ("order", "<i8"), ("key", "<i8"), ("at", "<i4")]
PASSAGE = "_order long, _key long, start int, windows int, twin_order long, twin_start int"


def _pack(kind: np.dtype, held: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Records dealt to the bucket of their anchor, one row per bucket."""
    records = np.concatenate(held)
    bucket = ((records["anchor"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    records, at = records[order], np.append(at, len(order))
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(used.astype(np.int32)),
        "records": pa.array([records[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
    })


def _dealt(rows: DataFrame, kind: np.dtype, records, buckets: int) -> DataFrame:
    """`records(part)` of every slice of the rows, brought together by bucket."""

    def emit(batches):
        held, size = [], 0
        for part in slices(batches, "text"):
            found = records(part)
            held.append(found)
            size += found.nbytes
            if size > PACK_BYTES:
                yield _pack(kind, held, buckets)
                held, size = [], 0
        if size:
            yield _pack(kind, held, buckets)

    packed = rows.mapInArrow(emit, "bucket int, records binary")
    return packed.repartitionById(buckets, F.col("bucket")).select("records")


def _read(kind: np.dtype, batches) -> np.ndarray:
    found = [np.frombuffer(x.as_buffer(), kind) for batch in batches for x in batch.column("records")]
    return np.concatenate([np.zeros(0, kind), *found])


def _suffix_kind(length: int, gram: int) -> np.dtype:
    """Words as four bytes of their hash, most significant first so that bytes sort like words; the left
    ones nearest first. `rights` and `lefts` count those inside the text."""
    return np.dtype([*PLACE, ("rights", "u1"), ("lefts", "u1"), ("right", ">u4", (length,)), ("left", ">u4", (length - gram,))])


def _repeated_anchors(rows: DataFrame, length: int, gram: int, hot, buckets: int) -> DataFrame:
    """(_order, _key, at): per row the places of its anchors that occur anywhere else, hot ones apart."""
    kind = np.dtype(PLACE)

    def records(part):
        words = W.read(part.column("text"))
        p = W.pieces(words, length, gram)
        keep = np.flatnonzero(~among(p.anchor, hot.value))
        out = np.empty(len(keep), kind)
        out["anchor"], out["at"] = p.anchor[keep], p.at[keep] - words.bounds[p.text[keep]]
        for name in ("order", "key"):
            out[name] = part.column("_" + name).to_numpy()[p.text[keep]]
        return out

    def repeated(batches):
        found = _read(kind, batches)
        found = found[np.argsort(found["anchor"], kind="stable")]
        same = found["anchor"][1:] == found["anchor"][:-1]
        found = found[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(found) else found
        yield pa.RecordBatch.from_pydict({
            "_order": pa.array(found["order"].copy()), "_key": pa.array(found["key"].copy()), "at": pa.array(found["at"].copy())
        })

    dealt = _dealt(rows.select("text", "_order", "_key"), kind, records, buckets)
    places = dealt.mapInArrow(repeated, "_order long, _key long, at int")
    return places.groupBy("_order", "_key").agg(F.collect_set("at").alias("at"))


def _suffixes(part: pa.RecordBatch, length: int, gram: int, kind: np.dtype) -> np.ndarray:
    """The suffixes of some texts at their places `at`."""
    words = W.read(part.column("text"))
    lists = part.column("at")
    count = np.diff(np.asarray(lists.offsets))
    text = np.repeat(np.arange(len(count)), count)
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begin, end = words.bounds[:-1][text], words.bounds[1:][text]
    grams, place = W.windows(words.hashes, gram), begin + at
    padded = np.concatenate([np.zeros(length, np.uint32), (words.hashes >> np.uint64(32)).astype(np.uint32), np.zeros(length, np.uint32)])
    out = np.empty(len(at), kind)
    out["anchor"], out["at"] = grams[place], at
    for name in ("order", "key"):
        out[name] = part.column("_" + name).to_numpy()[text]
    out["rights"], out["lefts"] = np.minimum(end - place, length), np.minimum(place - begin, length - gram)
    out["right"] = padded[(place + length)[:, None] + np.arange(length)]
    out["left"] = padded[(place + length - 1)[:, None] - np.arange(length - gram)]
    return out


def compare_neighbours(found: np.ndarray, length: int, gram: int) -> pa.RecordBatch:
    """Passages of the suffixes: sort, cut into runs by common prefix, extend to the left."""
    n, lefts_most = len(found), length - gram
    keys = np.empty(n, np.dtype([("anchor", ">u8"), ("right", ">u4", (length,))]))
    keys["anchor"], keys["right"] = found["anchor"], found["right"]
    found = found[np.argsort(keys.view(f"S{keys.dtype.itemsize}").ravel(), kind="stable")]
    right, anchor = found["right"], found["anchor"]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(1), differ.argmax(1), length)
    common = np.minimum(common, np.minimum(found["rights"][1:], found["rights"][:-1]))
    common[anchor[1:] != anchor[:-1]] = 0
    hits = np.zeros((n, lefts_most + 1), bool)
    twin = np.full((n, lefts_most + 1), -1, np.int32)
    extension = np.zeros(n, np.uint64)
    by_row = np.lexsort((found["at"], found["key"], found["order"]))
    rank = np.empty(n, np.int64)
    rank[by_row] = np.arange(n)
    for left in range(lefts_most + 1):
        if left:
            extension = W.mix(extension * np.uint64(W.WORD_FACTOR) + found["left"][:, left - 1].astype(np.uint64) + np.uint64(1))
        run = np.concatenate([[0], np.cumsum(common < length - left)]).astype(np.uint64)
        fits = np.flatnonzero((found["lefts"] >= left) & (found["rights"] >= length - left))
        both = W.mix(run[fits] * np.uint64(W.BYTE_FACTOR) ^ extension[fits])
        order = np.lexsort((rank[fits], both))
        group = np.concatenate([[True], both[order][1:] != both[order][:-1]]) if len(fits) else np.zeros(0, bool)
        first = np.flatnonzero(group)
        last = np.append(first[1:], len(order)) - 1
        member = np.cumsum(group) - 1
        several = (last > first)[member]
        other = np.where(group, last[member], first[member])
        hits[fits[order[several]], left] = True
        twin[fits[order[several]], left] = fits[order[other[several]]]
    # Windows begin `left` words before the anchor: runs of neighbouring ones, from the leftmost on.
    hits, twin = hits[:, ::-1], twin[:, ::-1]
    begins = hits & ~np.concatenate([np.zeros((n, 1), bool), hits[:, :-1]], 1)
    ends = hits & ~np.concatenate([hits[:, 1:], np.zeros((n, 1), bool)], 1)
    row, column = np.nonzero(begins)
    _, stop = np.nonzero(ends)
    back, with_whom = lefts_most - column, twin[row, column]
    return pa.RecordBatch.from_pydict({
        "_order": pa.array(found["order"][row]), "_key": pa.array(found["key"][row]),
        "start": pa.array((found["at"][row] - back).astype(np.int32)), "windows": pa.array((stop - column + 1).astype(np.int32)),
        "twin_order": pa.array(found["order"][with_whom]), "twin_start": pa.array((found["at"][with_whom] - back).astype(np.int32)),
    })


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text_column: str = "text",
                      hot: int = HOT) -> DataFrame:
    """(doc_id, n_repeated, passages) of the rows that have any: maximal passages (start and number of
    words, and a document and place that has their beginning, too), apart and in order."""
    rows, kind = named(docs, id_column, text_column), _suffix_kind(length, gram)
    often, buckets = hot_anchors(rows, length, gram, hot), partitions(docs.sparkSession)
    with_places = rows.join(_repeated_anchors(rows, length, gram, often, buckets), ["_order", "_key"])
    suffixes = _dealt(
        with_places.select("text", "_order", "_key", "at"), kind, lambda part: _suffixes(part, length, gram, kind), buckets
    )

    def compare(batches):
        found = _read(kind, batches)
        if len(found):
            yield compare_neighbours(found, length, gram)

    found = suffixes.mapInArrow(compare, PASSAGE)
    more = hot_windows(rows, length, gram, often)
    if more is not None:
        more = more.withColumnsRenamed({"ref_order": "twin_order", "ref_start": "twin_start"}).withColumn("windows", F.lit(1))
        found = found.unionByName(more)
    by_row = found.groupBy("_order", "_key").agg(F.collect_set(F.struct("start", "windows", "twin_order", "twin_start")).alias("found"))
    listed = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("twin_doc", pa.int64()), ("twin_start", pa.int32())]))

    def merge(batches):
        for batch in batches:
            ids, totals, merged = [], [], []
            for order, found in zip(batch.column("_order").to_pylist(), batch.column("found").to_pylist(), strict=True):
                passages = []
                for f in sorted(found, key=lambda f: (f["start"], -f["windows"], f["twin_order"], f["twin_start"])):
                    end = f["start"] + f["windows"] + length - 1
                    if passages and f["start"] <= passages[-1]["start"] + passages[-1]["words"]:
                        passages[-1]["words"] = max(passages[-1]["words"], end - passages[-1]["start"])
                    else:
                        twin = None if f["twin_order"] == LOWEST else f["twin_order"]
                        passages.append({"start": f["start"], "words": end - f["start"], "twin_doc": twin, "twin_start": f["twin_start"]})
                ids.append(None if order == LOWEST else order)
                totals.append(sum(p["words"] for p in passages))
                merged.append(passages)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_repeated": pa.array(totals, pa.int64()), "passages": pa.array(merged, listed)
            })

    return by_row.mapInArrow(
        merge, "doc_id long, n_repeated long, passages array<struct<start:int,words:int,twin_doc:long,twin_start:int>>"
    )
