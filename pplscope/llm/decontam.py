"""Benchmark decontamination by latent semantic retrieval.

The items are a stated query set; they are taken in blocks of `BLOCK_ITEMS`, each block against all
documents. For a block:

1. every document's words become ids of the block's vocabulary (0 for words no item has);
2. passages, runs of PASSAGE words of all documents, give the terms' document frequencies;
3. the TF-IDF matrix A of all passages is decomposed by a randomised SVD in one pass: each task adds
   up its part of A'(A W) for a random W, and the leading right singular vectors follow from that
   sketch alone (Nystrom); what meets on the driver is terms times dimensions, bounded by the block;
4. windows of about an item's length slide over every document; their latent vectors are differences
   of running sums. Of the windows that hold enough of an item's rarer words, those near it in cosine
   are candidates, and so are those further away whose words, in any order, could still pass step 5:
   the cosine decides which windows are looked at first and leaves none out;
5. a candidate's longest common subsequence with the item decides: COPY of the item's words, in
   order, within about its length, or PARAPHRASE of them together with the item's answer (ANSWER of
   its words). The answer is the column of that name, or else the item's last sentence.

Null and empty texts have no words and no leaks; items without words find nothing; items shorter
than SHORT words must be there whole. Rows with equal ids are one document in the result of `leaks`;
`drop_contaminated` tells them apart by their texts. Empty tables give an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pplscope import scratch
from pplscope.llm.frames import by_place, partitions, slices, text_key, whole_text

BLOCK_ITEMS = 500
PIECE_WORDS = 1 << 17
PASSAGE = 32
DIMENSIONS, OVERSAMPLE = 32, 8
STEP = 6
COMMON_SHARE = 0.4
COSINE = 0.5
FAR_WINDOWS = 4_096
COPY, PARAPHRASE, ANSWER = 0.8, 0.6, 0.9
SHORT = 8
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LEAK = "doc_id long, key long, item_id long, first_word int, n_words int, cosine double, overlap double, answer double"


@dataclass
class Item:
    number: int
    terms: np.ndarray
    answer: np.ndarray
    window: int


def width_for(words: int) -> int:
    """Smallest window width, in steps, that holds an item wherever it begins: 4 steps, then half as much again."""
    width = 4
    while width * STEP < words + STEP:
        width += width // 2
    return width


class Block:
    """Some items, their vocabulary, and after `decompose` their latent vectors."""

    def __init__(self, items: list[tuple[int, str, str | None]]):
        self.terms: dict[str, int] = {}
        self.items = []
        for number, text, answer in items:
            words = self.ids_of(text)
            if len(words):
                ending = answer if answer else SENTENCE.split(text.strip())[-1]
                self.items.append(Item(number, words, self.ids_of(ending), width_for(len(words))))
        self.items.sort(key=lambda i: i.window)  # one class of windows after another
        self.size = len(self.terms) + 1
        self.idf = self.basis = None

    def ids_of(self, text: str) -> np.ndarray:
        return np.array([self.terms.setdefault(w, len(self.terms) + 1) for w in WORD.findall(text.lower())], np.int32)

    def start(self) -> np.ndarray:
        """The random matrix of the sketch, with orthonormal columns."""
        wide = min(DIMENSIONS + OVERSAMPLE, self.size)
        return np.linalg.qr(np.random.default_rng(1).standard_normal((self.size, wide)))[0].astype(np.float32)

    def decompose(self, start: np.ndarray, sketch: np.ndarray) -> None:
        """Leading right singular vectors of A from A'A `start`."""
        start, sketch = start.astype(np.float64), sketch.astype(np.float64)
        shift = 1e-10 * max(np.linalg.norm(sketch), 1e-30)
        moved = sketch + shift * start
        inner = start.T @ moved
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        root = vectors / np.sqrt(np.maximum(values, shift))
        basis, _, _ = np.linalg.svd(moved @ root, full_matrices=False)
        self.basis = (basis[:, :DIMENSIONS] * self.idf[:, None]).astype(np.float32)

    def telling(self) -> tuple[np.ndarray, np.ndarray]:
        """Which terms are counted for which item (terms by items), and how many a window needs.

        An item whose subsequence reaches PARAPHRASE lacks at most the other share of its words, whichever
        they are (a short one lacks none); so of its rarer words a window holds all but that many. Windows with fewer can't pass.
        """
        member, least = np.zeros((self.size, len(self.items)), np.uint8), np.zeros(len(self.items), np.int32)
        for i, item in enumerate(self.items):
            weight = self.idf[item.terms]
            rare = item.terms[weight >= np.quantile(weight, COMMON_SHARE)]
            member[rare, i] = 1
            lacking = (1 - PARAPHRASE) * len(item.terms) if len(item.terms) >= SHORT else 0
            least[i] = max(0, int(np.ceil(len(rare) - lacking - 1e-9)))
        return member, least

    def latent(self) -> np.ndarray:
        """Unit vectors of the items."""
        found = np.stack([self.basis[i.terms].sum(0) for i in self.items])
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def common(a: list[int], places: dict[int, int], size: int) -> int:
    """Longest common subsequence, a word of bits at a time: `places` has a bit mask per term."""
    full, row = (1 << size) - 1, (1 << size) - 1
    for term in a:
        here = places.get(term)
        if here:
            hit = row & here
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def masks(terms: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(terms.tolist()):
        out[t] = out.get(t, 0) | 1 << i
    return out


def _flat(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(term of every word, bounds of documents)."""
    column = part.column("terms")
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, offsets - offsets[0]


def _pieces(batches, words: int = PIECE_WORDS):
    """Slices of about so many words."""
    for batch in batches:
        ends, start = np.asarray(batch.column("terms").offsets).astype(np.int64)[1:], 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else ends[0] - len(batch.column("terms")[0])
            stop = max(start + 1, int(np.searchsorted(ends, done + words, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _passages(terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the known terms of each passage, by passage."""
    known = np.flatnonzero(terms)
    doc = np.searchsorted(bounds, known, "right") - 1
    first = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // PASSAGE))])[:-1]
    passage = first[doc] + (known - bounds[doc]) // PASSAGE
    code = np.sort(passage << 32 | terms[known])
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[new] >> 32, code[new] & 0xFFFFFFFF, np.diff(np.append(new, len(code)))


def _terms(docs: DataFrame, block, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, key, terms) of every document, written once; `key` is its text's."""

    def run(batches):
        get = block.value.terms.get
        for part in slices(batches, "text"):
            words = [WORD.findall(t.lower()) for t in part.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in words])]).astype(np.int32)
            flat = np.fromiter(map(get, chain.from_iterable(words), repeat(0)), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "key": part.column("key"), "terms": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            })

    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_key(text_column).alias("key"), whole_text(text_column).alias("text")
    )
    return scratch.materialize(rows.mapInArrow(run, "doc_id long, key long, terms array<int>"), "terms")


def _frequencies(terms: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """(passages with each term, passages)."""

    def run(batches):
        counts, total = np.zeros(size, np.int64), 0
        for part in _pieces(batches):
            flat, bounds = _flat(part)
            counts += np.bincount(_passages(flat, bounds)[1], minlength=size)
            total += int((-(-np.diff(bounds) // PASSAGE)).sum())
        counts[0] = total
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.arange(size, dtype=np.int32)), "n": pa.array(counts)})

    found = terms.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for r in found:
        counts[r.term] = r.n
    return counts, int(counts[0])


def _sketch(terms: DataFrame, block, start: np.ndarray) -> np.ndarray:
    """A'A `start`, from every passage's part of it: added up in tasks, then by groups of terms."""
    size, wide = start.shape
    shared = terms.sparkSession.sparkContext.broadcast(start)
    step = 256

    def run(batches):
        idf, total = block.value.idf, np.zeros((size, wide))  # sums in double
        weighted = (shared.value * idf[:, None]).astype(np.float32)
        for part in _pieces(batches):
            flat, bounds = _flat(part)
            passage, term, count = _passages(flat, bounds)
            if not len(term):
                continue
            rows = np.concatenate([[0], np.cumsum(-(-np.diff(bounds) // PASSAGE))])
            weight = count * idf[term]
            norm = np.bincount(passage, weight * weight, rows[-1])
            # Each passage's row of A W over its squared length: once for its own row, once for the other factor.
            projected = _added(weighted, _padded(flat, bounds, rows, PASSAGE)) / np.maximum(norm, 1e-12)[:, None]
            for column, values in enumerate(np.ascontiguousarray(projected.T)):
                total[:, column] += np.bincount(term, values[passage] * weight, size)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(np.arange(0, size, step, dtype=np.int32) // step),
            "sums": pa.array([total[i : i + step].tobytes() for i in range(0, size, step)], pa.binary()),
        })

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                values = np.frombuffer(raw.as_buffer(), np.float64)
                sums[part] = sums[part] + values if part in sums else values
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(sums), pa.int32()), "sums": pa.array([s.tobytes() for s in sums.values()], pa.binary())
        })

    kind = "part int, sums binary"
    parts = min(partitions(terms.sparkSession), -(-size // step))
    found = terms.select("terms").mapInArrow(run, kind).repartitionById(parts, F.pmod("part", F.lit(parts))).mapInArrow(add, kind)
    out = np.zeros((size, wide))
    for r in found.collect():
        values = np.frombuffer(r.sums, np.float64).reshape(-1, wide)
        out[r.part * step : r.part * step + len(values)] = values
    return out


def _padded(flat: np.ndarray, bounds: np.ndarray, row_bounds: np.ndarray, width: int) -> np.ndarray:
    """The words of all documents in rows of `width`, each document's last row filled up with 0."""
    out = np.zeros(int(row_bounds[-1]) * width, flat.dtype)
    sizes = np.diff(bounds)
    shift = np.repeat(row_bounds[:-1] * width - bounds[:-1], sizes)
    out[np.arange(len(flat)) + shift] = flat
    return out.reshape(-1, width)


def _added(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the table's rows named by each row (term 0 must be zero there)."""
    total = table[rows[:, 0]]
    for column in range(1, rows.shape[1]):
        total += table[rows[:, column]]
    return total


def could_pass(rows: np.ndarray, item: Item, size: int) -> np.ndarray:
    """Which windows (rows of terms) hold enough of an item's words, in any order, to pass as COPY or as
    PARAPHRASE with ANSWER. A common subsequence has no more words than two texts share, so none that
    passes is left out."""

    def shared(words: np.ndarray) -> np.ndarray:
        terms, times = np.unique(words, return_counts=True)
        place = np.full(size, len(terms), np.int64)
        place[terms] = np.arange(len(terms))
        code = place[rows] + np.arange(len(rows))[:, None] * (len(terms) + 1)
        held = np.bincount(code.ravel(), minlength=len(rows) * (len(terms) + 1)).reshape(len(rows), -1)[:, :-1]
        return np.minimum(held, times).sum(1) / max(1, len(words))

    overlap = shared(item.terms)
    if len(item.terms) < SHORT:
        return overlap >= 1.0
    return (overlap >= COPY) | ((overlap >= PARAPHRASE) & (shared(item.answer) >= ANSWER))


def search(flat: np.ndarray, bounds: np.ndarray, block: Block, latent: np.ndarray, cosine: float = COSINE):
    """(document, first word, item, cosine) of the candidate windows: those that hold enough of an item's words
    for any common subsequence to reach PARAPHRASE, and are next to it in latent space or `could_pass`.

    Windows begin at every STEP-th word of a document and are whole numbers of steps wide, so their
    vectors are sums of few step vectors.
    """
    sizes = np.diff(bounds)
    steps = -(-sizes // STEP)
    step_bounds = np.concatenate([[0], np.cumsum(steps)])
    doc = np.repeat(np.arange(len(sizes)), steps)
    if not len(doc):
        return
    first = bounds[doc] + (np.arange(len(doc)) - step_bounds[doc]) * STEP
    padded = _padded(flat, bounds, step_bounds, STEP)
    member, least = block.telling()
    running, held = np.zeros((len(doc) + 1, block.basis.shape[1])), np.zeros((len(doc) + 1, len(block.items)), np.uint16)
    np.cumsum(_added(block.basis, padded), 0, dtype=np.float64, out=running[1:])
    np.cumsum(_added(member, padded), 0, dtype=np.uint16, out=held[1:])  # modulo 2**16, as are its differences
    classes: dict[int, list[int]] = {}
    for i, item in enumerate(block.items):
        classes.setdefault(item.window, []).append(i)
    for width, chosen in classes.items():
        begin = np.arange(len(doc))
        stop = np.minimum(begin + width, step_bounds[doc + 1])
        # A window cut short by the document's end adds nothing to the one before it, unless it is the only one.
        begin = begin[(begin + width <= step_bounds[doc + 1]) | (begin == step_bounds[doc])]
        low, high = chosen[0], chosen[-1] + 1
        enough = held[stop[begin], low:high] - held[begin, low:high] >= least[low:high].astype(np.uint16)
        w, c = np.nonzero(enough)
        order = np.argsort(c, kind="stable")
        w, c = w[order], c[order] + low
        ends = np.searchsorted(c, np.arange(low, high + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            at = begin[w[ends[i] : ends[i + 1]]]
            window = (running[stop[at]] - running[at]).astype(np.float32)
            near = window @ latent[low + i] / np.maximum(np.linalg.norm(window, axis=1), 1e-9)
            kept = near >= cosine
            far = np.flatnonzero(~kept)
            for k in range(0, len(far), FAR_WINDOWS):
                part = far[k : k + FAR_WINDOWS]
                steps_of = at[part][:, None] + np.arange(width)
                rows = np.where((steps_of < stop[at[part]][:, None])[:, :, None], padded[np.minimum(steps_of, len(padded) - 1)], 0)
                kept[part] = could_pass(rows.reshape(len(part), width * STEP), block.items[low + i], block.size)
            at, near = at[kept], near[kept]
            yield doc[at], first[at], np.full(len(at), low + i), near


def _judge(flat: np.ndarray, bounds: np.ndarray, block: Block, found):
    """The best window of each document and item that passes: (document, item, start, words, cosine, overlap, answer)."""
    best: dict[tuple[int, int], tuple] = {}
    bits: dict[int, tuple] = {}
    for docs, starts, items, cosines in found:
        for doc, start, number, cosine in zip(docs.tolist(), starts.tolist(), items.tolist(), cosines.tolist(), strict=True):
            item = block.items[number]
            if number not in bits:
                bits[number] = masks(item.terms), masks(item.answer)
            a, b = start, min(bounds[doc + 1], start + item.window * STEP)
            words = flat[a:b].tolist()
            overlap = common(words, bits[number][0], len(item.terms)) / len(item.terms)
            answer = common(words, bits[number][1], len(item.answer)) / len(item.answer) if len(item.answer) else 0.0
            needed = 1.0 if len(item.terms) < SHORT else COPY
            passes = overlap >= needed or (len(item.terms) >= SHORT and overlap >= PARAPHRASE and answer >= ANSWER)
            if passes and overlap > best.get((doc, number), (0, 0, 0, 0.0, 0))[3]:
                best[doc, number] = int(a - bounds[doc]), int(b - a), cosine, overlap, answer
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, cosine, overlap, answer): the best place of each item in each
    document that holds it."""
    found = _places(docs, benchmark, id_column, text_column, cosine)
    rest = ("first_word", "n_words", "cosine", "overlap", "answer")
    one = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "answer", "cosine", F.negate("first_word").alias("back"), *rest[:2])).alias("best"))
    return one.select("doc_id", "item_id", *[F.col(f"best.{c}").alias(c) for c in rest])


def _places(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, cosine: float) -> DataFrame:
    """The columns of LEAK, a row per row of `docs` and item it holds."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL")
    out, held = [], []
    for row in items.toLocalIterator():
        held.append(tuple(row))
        if len(held) == BLOCK_ITEMS:
            out.append(_block_leaks(spark, docs, held, id_column, text_column, cosine))
            held = []
    if held:
        out.append(_block_leaks(spark, docs, held, id_column, text_column, cosine))
    found = None
    for part in out:
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], LEAK) if found is None else found


def _block_leaks(spark: SparkSession, docs: DataFrame, items: list, id_column: str, text_column: str, cosine: float) -> DataFrame | None:
    block = Block(items)
    if not block.items:
        return None
    terms = _terms(docs, spark.sparkContext.broadcast(block), id_column, text_column)
    counts, total = _frequencies(terms, block.size)
    block.idf = np.log((1.0 + total) / (1.0 + counts)) + 1e-3
    block.idf[0] = 0.0
    start = block.start()
    block.decompose(start, _sketch(terms, spark.sparkContext.broadcast(block), start))
    shared = spark.sparkContext.broadcast((block, block.latent()))

    def run(batches):
        block, latent = shared.value
        for part in _pieces(batches):
            flat, bounds = _flat(part)
            best = _judge(flat, bounds, block, search(flat, bounds, block, latent, cosine))
            if best:
                ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_pylist()
                rows = [(ids[d], keys[d], block.items[i].number, *v) for (d, i), v in best.items()]
                names = [c.split()[0] for c in LEAK.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return terms.mapInArrow(run, LEAK)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item; their columns are kept. Rows are told apart by id and text, so
    clean rows without id, or with the id of one that holds an item, stay."""
    found = _places(docs, benchmark, id_column, text_column, COSINE).select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key")).distinct()
    rows, (row_id, text) = by_place(docs, id_column, text_column)
    same = F.col(row_id).cast("long").eqNullSafe(F.col("found_id")) & (text_key(text) == F.col("found_key"))
    return rows.join(found, same, "left_anti").toDF(*docs.columns)
