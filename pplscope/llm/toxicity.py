"""Toxic spans by a linear-chain conditional random field over words.

`train` learns from labelled documents: which words, or first letters of words, appear in toxic
documents far more often than chance allows (a word of these in a toxic document is a toxic token),
then a two-state chain whose states are scored by a word's features and by the state before, then
how tagged tokens add up to a toxic document. `score` gives each document the forward-backward
marginals of its tokens: the spans where they exceed one half, and one score.

The model is fitted on a bounded sample of the labelled rows: `sample_rows` of them, chosen by a
hash of the id, texts over `sample_chars` not among them. Scoring reads every text whole and is
row-local. Null and empty texts have no tokens and get the score of no toxic token; repeated rows
repeat their result; rows without a label or without an id are never learned from; with no toxic
row to learn from every score is the same low base rate.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pplscope.llm.frames import by_place, slices, whole_text

SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 20_000
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6)
ROUNDS, RATE, SHRINK = 60, 0.5, 1.0
FOLDS = 5
STEPS = 256
CACHED_WORDS = 500_000
WORD = re.compile(r"\w+")


def held_out(id_column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_column).cast("string")) % FOLDS == 0


def features(word: str) -> list[str]:
    """The word, and its first letters where more follow."""
    word = word.lower()
    return ["=" + word, *[f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n]]


def _slot(feature: str) -> int:
    """Place of a feature's weight."""
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1)


def marginals(emissions: np.ndarray, starts: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many documents laid end to end.

    `emissions`: log-odds of the toxic state per token; `starts`: where documents begin; `pairs`:
    2x2 potentials from state to state; `first`: of the first state. Returns each token's probability
    of the toxic state, and the probability of both it and the token before being toxic (and the other
    three combinations), as an array of four columns; zero at starts.

    The chain is cut into columns of STEPS tokens which advance together: first each column's product
    of transfer matrices, then the states at the columns' borders, then all tokens. A document's first
    token has a transfer matrix with equal rows, so nothing passes from one document to the next.
    """
    n = len(emissions)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    columns = -(-n // STEPS)
    grow = np.ones(columns * STEPS)
    grow[:n] = np.exp(np.clip(emissions, -30, 30))
    is_start = np.zeros(columns * STEPS, bool)
    is_start[starts[starts < n]] = True
    is_start[n:] = True
    t = np.empty((2, 2, columns * STEPS))
    for i in (0, 1):
        for j in (0, 1):
            t[i, j] = np.where(is_start, first[j], pairs[i, j]) * (grow if j else 1.0)
    t = t.reshape(2, 2, columns, STEPS).transpose(3, 0, 1, 2).copy()

    product = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, columns)).copy()
    for s in range(STEPS):
        product = np.einsum("ijc,jkc->ikc", product, t[s])
        product /= product.sum((0, 1))
    into, out_of = np.empty((2, columns)), np.empty((2, columns))
    state = np.array([0.5, 0.5])
    for c in range(columns):
        into[:, c] = state
        state = state @ product[:, :, c]
        state = state / state.sum()
    state = np.array([0.5, 0.5])
    for c in reversed(range(columns)):
        out_of[:, c] = state
        state = product[:, :, c] @ state
        state = state / state.sum()

    ahead, back = np.empty((STEPS, 2, columns)), np.empty((STEPS, 2, columns))
    state = into
    for s in range(STEPS):
        state = state[0] * t[s, 0] + state[1] * t[s, 1]
        state = state / (state[0] + state[1])
        ahead[s] = state
    state = out_of
    for s in reversed(range(STEPS)):
        back[s] = state
        state = t[s, :, 0] * state[0] + t[s, :, 1] * state[1]
        state = state / (state[0] + state[1])
    both = ahead * back
    toxic = (both[:, 1] / both.sum(1)).T.ravel()[:n]
    before = np.concatenate([into[None], ahead[:-1]])
    joint = before[:, :, None] * t * back[:, None]
    joint /= joint.sum((1, 2), keepdims=True)
    joint = joint.transpose(3, 0, 1, 2).reshape(-1, 4)[:n]
    joint[is_start[:n]] = 0.0
    return toxic, joint


@dataclass
class Model:
    """Feature weights, transitions, and the logistic weights of a document's sums."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << FEATURE_BITS, np.float32))
    pairs: np.ndarray = field(default_factory=lambda: np.ones((2, 2)))
    first: np.ndarray = field(default_factory=lambda: np.ones(2))
    final: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0]))
    bias: float = -6.0

    def emission(self, word: str) -> float:
        return self.bias + float(self.weights[[_slot(f) for f in features(word)]].sum())


def evidence(toxic: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Per document: 1, log of one plus its expected toxic tokens, its largest marginal."""
    out = np.zeros((len(starts), 3))
    out[:, 0] = 1.0
    sizes = np.diff(np.append(starts, n))
    some = sizes > 0
    if n:
        out[some, 1] = np.log1p(np.add.reduceat(toxic, starts[some]))
        out[some, 2] = np.maximum.reduceat(toxic, starts[some])
    return out


def _telling(documents: list[set[str]], labels: np.ndarray) -> set[str]:
    """Features whose share of toxic documents could not come from chance: the binomial tail (by its
    exponent) is below one in the number of features tried."""
    toxic, all_of = Counter(), Counter()
    for found, label in zip(documents, labels, strict=True):
        all_of.update(found)
        if label:
            toxic.update(found)
    base = labels.mean()
    limit = np.log(len(all_of) + 1.0) + 2.0
    chosen = set()
    for feature, t in toxic.items():
        n = all_of[feature]
        share = t / n
        if share < 0.5 or share <= base:
            continue
        exponent = n * (share * np.log(share / base) + (0 if share == 1 else (1 - share) * np.log((1 - share) / (1 - base))))
        if exponent > limit:
            chosen.add(feature)
    return chosen


def fit(texts: list[str], labels: list[int], rounds: int = ROUNDS) -> Model:
    """Fit on labelled texts (in memory: the caller bounds them)."""
    rows = dict(zip(texts, labels, strict=True))  # a text that is there many times counts once
    texts, labels = list(rows), np.array(list(rows.values()), int)
    model = Model()
    if not len(labels) or labels.all() or not labels.any():
        return model
    words = [WORD.findall(t) for t in texts]
    names = {w: features(w) for w in set().union(*words)}
    telling = _telling([set().union(*(names[w] for w in set(ws))) for ws in words], labels)
    marked = {w for w, fs in names.items() if not telling.isdisjoint(fs)}

    # The chain is trained on the toxic documents and on as many others.
    toxic_docs = np.flatnonzero(labels)
    chosen = np.concatenate([toxic_docs, np.flatnonzero(labels == 0)[: len(toxic_docs)]])
    sequences = [words[i] for i in chosen]
    flat = [w for s in sequences for w in s]
    truth = np.array([bool(labels[i]) and w in marked for i, s in zip(chosen, sequences, strict=True) for w in s], float)
    starts = np.cumsum([0, *map(len, sequences)])[:-1].astype(np.int64)
    order = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    word_of = np.array([order[w] for w in flat], np.int64)
    slots = [np.array([_slot(f) for f in names[w]], np.int64) for w in order]
    slot_of, owner = np.concatenate(slots), np.repeat(np.arange(len(slots)), list(map(len, slots)))
    is_start = np.zeros(len(flat), bool)
    is_start[starts[starts < len(flat)]] = True
    previous = np.concatenate([[0.0], truth[:-1]])
    seen_pairs = np.array([[((previous == i) & (truth == j) & ~is_start).sum() for j in (0, 1)] for i in (0, 1)], float)
    weights, pairs, first, bias = np.zeros(1 << FEATURE_BITS), np.zeros((2, 2)), np.zeros(2), model.bias
    past = {"w": np.full(1 << FEATURE_BITS, 1e-6), "p": np.full((2, 2), 1e-6), "f": np.full(2, 1e-6), "b": 1e-6}

    def step(name: str, slope):
        past[name] = past[name] + slope**2
        return RATE * slope / np.sqrt(past[name])

    for _ in range(rounds):
        emissions = bias + np.bincount(owner, weights[slot_of], len(slots))
        toxic, joint = marginals(emissions[word_of], starts, np.exp(pairs), np.exp(first))
        missed = truth - toxic
        slope = np.bincount(slot_of, np.bincount(word_of, missed, len(slots))[owner], 1 << FEATURE_BITS) - SHRINK * weights
        weights += step("w", slope)
        bias += step("b", missed.sum() - SHRINK * bias)
        pairs += step("p", seen_pairs - joint.sum(0).reshape(2, 2) - SHRINK * pairs)
        at_start = truth[is_start].sum()
        expected = toxic[is_start].sum()
        first += step("f", np.array([expected - at_start, at_start - expected]) - SHRINK * first)
    model.weights, model.pairs, model.first, model.bias = weights.astype(np.float32), np.exp(pairs), np.exp(first), float(bias)

    # From tokens to documents: logistic regression, all sampled rows, by Newton's method.
    x = np.concatenate([tag(model, words[i : i + 500])[0] for i in range(0, len(words), 500)])
    final, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ final))
        final = final + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ final)
    model.final = final
    return model


def tag(model: Model, words: list[list[str]], known: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(evidence per document, marginal per token, starts) of documents given as words."""
    known = {} if known is None else known
    flat = [w for ws in words for w in ws]
    for w in set(flat):
        if w not in known:
            known[w] = model.emission(w)
    emissions = np.fromiter(map(known.__getitem__, flat), np.float64, len(flat))
    starts = np.cumsum([0, *map(len, words)])[:-1].astype(np.int64)
    toxic, _ = marginals(emissions, starts, model.pairs, model.first)
    return evidence(toxic, starts, len(flat)), toxic, starts


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a sample of the labelled rows that are not held out. The ids are chosen on `labels`
    alone; at most `sample_rows` ids, then as many texts of at most `sample_chars`, reach the driver."""
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_rows)
    )
    rows = docs.sparkSession.createDataFrame(ids.toArrow(), "doc_id long, toxic int")
    text = whole_text().alias("text")
    found = (
        docs.select("doc_id", text).where(F.length("text") <= sample_chars)
        .join(F.broadcast(rows), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id")
    )
    sample = found.select("text", "toxic").toArrow()
    return fit(sample.column("text").to_pylist(), sample.column("toxic").to_pylist())


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of `docs` by their names, and `_toxicity` (score, spans): spans in code points, end
    exclusive, with their largest marginal. `id_column` is not read; a column `_toxicity` that `docs` has
    is replaced (`reject` keeps it)."""
    scored = _scored(docs, model, text_column)
    kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if c != "_toxicity"]
    return scored.select(*[F.col(here).alias(name) for here, name in kept], F.col("toxicity").alias("_toxicity"))


def reject(docs: DataFrame, model: Model, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of `docs` that score below the threshold, all columns as they are."""
    return _scored(docs, model, text_column).where(F.col("toxicity.score") < threshold).select(
        *[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model, text_column: str) -> DataFrame:
    """The columns of `docs` as c0, c1, … and their toxicity."""
    rows, (text,) = by_place(docs, text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])

    def run(batches):
        known: dict[str, float] = {}
        model = shared.value
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            words = [WORD.findall(t) for t in texts]
            if len(known) > CACHED_WORDS:
                known = {}
            facts, toxic, starts = tag(model, words, known)
            scores = 1 / (1 + np.exp(-facts @ model.final))
            out = [
                {"score": float(s), "spans": _spans(text, toxic[a : a + len(ws)])}
                for s, text, a, ws in zip(scores, texts, starts, words, strict=True)
            ]
            columns = {n: part.column(n) for n in part.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(columns | {"toxicity": pa.array(out, kind)})

    schema = rows.limit(0).withColumn("toxicity", F.lit(None).cast(
        "struct<score:double,spans:array<struct<start:int,end:int,score:double>>>")).schema
    return rows.withColumn("text", whole_text(text)).mapInArrow(run, schema)


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    """Runs of tokens more likely toxic than not, as offsets."""
    if not len(toxic) or toxic.max() <= 0.5:
        return []
    places, out = [m.span() for m in WORD.finditer(text)], []
    for i in np.flatnonzero(toxic > 0.5).tolist():
        if out and out[-1]["last"] == i - 1:
            out[-1] |= {"end": places[i][1], "last": i, "score": max(out[-1]["score"], float(toxic[i]))}
        else:
            out.append({"start": places[i][0], "end": places[i][1], "score": float(toxic[i]), "last": i})
    return [{k: s[k] for k in ("start", "end", "score")} for s in out]
