"""Texts to token log-probs: a pluggable scorer in Arrow batches, and a counted bigram model."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from pplscope.bounded import lookup_with_hot_keys, small_side
from pplscope.functions.arrays import RAW_TYPE, TOKEN
from pplscope.functions.text import words
from pplscope.operators import bigrams
from pplscope.operators.chunking import spread_windows, stitch_windows
from pplscope.scratch import materialize

# Executors get the batch functions by value, so they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class TokenScore(NamedTuple):
    """Log-prob and text of one prompt token."""

    token_id: str
    logprob: float
    decoded_token: str


class Scorer(Protocol):
    """Scores prompts: per text, per token a TokenScore, or None where the model gives none
    (always for the first token). Built once per task from a factory."""

    def score(self, texts: Sequence[str]) -> list[list[TokenScore | None]]: ...


class WordLengthScorer:
    """Offline stand-in for a language model: a word's log-prob falls with its length."""

    def score(self, texts: Sequence[str]) -> list[list[TokenScore | None]]:
        def one(text: str) -> list[TokenScore | None]:
            tokens = [t for t in text.translate({10: " ", 13: " ", 9: " "}).split(" ") if t]
            return [TokenScore(t, -len(t) / 4.0, t) if i else None for i, t in enumerate(tokens)]

        return [one(t) for t in texts]


def _raw_array(scored: list[list[TokenScore | None]]) -> pa.Array:
    """Scores as Arrow lists of one-entry maps, put together column by column."""
    entries = [t for tokens in scored for t in tokens]
    given = [t for t in entries if t is not None]
    ids, logprobs, decoded = zip(*given) if given else ((), (), ())
    values = pa.StructArray.from_arrays(
        [pa.array(logprobs, pa.float32()), pa.array(decoded, pa.string())], ["logprob", "decoded_token"]
    )
    is_given = np.fromiter((t is not None for t in entries), bool, len(entries))
    ends = np.concatenate([[0], np.cumsum(is_given)]).astype(np.int32)
    missing = np.concatenate([~is_given, [False]])
    maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32(), mask=missing), pa.array(ids, pa.string()), values)
    sizes = np.fromiter((len(tokens) for tokens in scored), np.int32, len(scored))
    rows = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(rows, maps)


def _score(
    df: DataFrame, make_scorer: Callable[[], Scorer], keys: list[str], text_col: str, name: str, kind: str,
    build: Callable[[list[list[TokenScore | None]], pa.RecordBatch], pa.Array], batch_size: int = 1024, carried: Sequence[str] = (),
) -> DataFrame:
    """`keys` and what `build` makes of the scores (and the `carried` columns) of a batch, as `name`. Keys
    stay in the batch their text is scored in, and batches stream through the task; a failed task is
    simply run again by Spark. Null and empty texts have no tokens and don't reach the scorer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                texts = part.column(text_col).to_pylist()
                some = iter(scorer.score([t for t in texts if t]) if any(texts) else [])
                scored = [next(some) if t else [] for t in texts]
                columns = [part.column(k) for k in keys] + [build(scored, part)]
                yield pa.RecordBatch.from_arrays(columns, [*keys, name])

    built = df.sparkSession.range(0).select(F.lit(None).cast(kind).alias(name)).schema[name].dataType
    schema = StructType([*df.select(*keys).schema.fields, StructField(name, built)])
    return df.select(*keys, *carried, text_col).mapInArrow(run, schema)


def score_raw(
    df: DataFrame, make_scorer: Callable[[], Scorer], keys: list[str], text_col: str, batch_size: int = 1024
) -> DataFrame:
    """`keys` and `raw` (one entry per token)."""
    return _score(df, make_scorer, keys, text_col, "raw", RAW_TYPE, lambda scored, _: _raw_array(scored), batch_size)


def _lists(scored: list[list[TokenScore]], values: pa.Array) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(tokens) for tokens in scored])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _first_logprobs(scored: list[list[TokenScore | None]], _: pa.RecordBatch) -> pa.Array:
    """What `extract_first_logprob` takes from the raw scores."""
    given = [[t.logprob for t in tokens[1:] if t is not None] for tokens in scored]
    return _lists(given, pa.array([x for xs in given for x in xs], pa.float32()))


def _given_tokens(scored: list[list[TokenScore | None]], batch: pa.RecordBatch) -> pa.Array:
    """The scored tokens behind the first `_skip` entries."""
    skips = batch.column("_skip").to_pylist()
    given = [[t for t in tokens[skip:] if t is not None] for tokens, skip in zip(scored, skips)]
    flat = [t for tokens in given for t in tokens]
    return _lists(given, pa.StructArray.from_arrays(
        [pa.array([t.logprob for t in flat], pa.float32()), pa.array([t.decoded_token for t in flat], pa.string())],
        ["logprob", "decoded_token"],
    ))


def score_chunks(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    text_col: str = "chunk_text",
    keys: Sequence[str] = ("text_id", "chunk_id"),
    batch_size: int = 1024,
    partitions: int | None = None,
) -> DataFrame:
    """`keys` and `logprobs` of every chunk.

    `partitions` spreads the texts evenly first; leave it out when the input already is.
    """
    source = df.repartition(partitions) if partitions else df
    return _score(source, make_scorer, list(keys), text_col, "logprobs", "array<float>", _first_logprobs, batch_size)


def score_documents(
    df: DataFrame,
    make_scorer: Callable[[], Scorer],
    ctx: int,
    stride: int,
    mode: str = "fresh",
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """`doc_id, prompt_logprobs, decoded_tokens` of whole documents, scored window by window.

    A document's tokens are dealt out in stretches of some windows, `partitions` ways (by default as any
    shuffle), so a very long document is scored by many tasks and no row holds more than a stretch. Of a
    window's scores only the fresh ones leave the scorer's task (with `concat`: all). A document without
    tokens is one empty window. Ids name documents, so they are unique.
    """
    if mode not in ("fresh", "concat"):
        raise ValueError(f"unknown mode {mode!r}")
    tokens = df.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("tokens"))
    windows = spread_windows(tokens, ctx, stride, partitions)
    keys = ["doc_id", "window_id", "cur", "beg", "n_tokens"]
    skip = F.col("cur") - F.col("beg") if mode == "fresh" else F.lit(0)
    texts = windows.select(
        "doc_id", "window_id", F.lit(0).alias("cur"), F.lit(0).alias("beg"), "n_tokens", skip.alias("_skip"),
        F.array_join("window_tokens", " ").alias("prompt"),
    )
    scored = _score(texts, make_scorer, keys, "prompt", "scores", f"array<{TOKEN}>", _given_tokens, carried=["_skip"])
    stitched = stitch_windows(scored, mode)
    return stitched.select(
        "doc_id",
        F.transform("scores", lambda t: t["logprob"]).alias("prompt_logprobs"),
        F.transform("scores", lambda t: t["decoded_token"]).alias("decoded_tokens"),
    )


def coded_words(text: Column) -> Column:
    """Words as 64-bit codes: fixed width wherever only equality counts. Two of n different words share one
    with a chance of n squared in 2**65."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bigram_rows(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per adjacent word pair, as codes: `keys, pos, a, b`; a text with fewer than two words keeps
    one row with nulls."""
    tokens = df.select(*keys, coded_words(F.col(text_col)).alias("_t"))
    n = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("_t", F.lit(1), n).alias("a"), F.slice("_t", F.lit(2), n).alias("b"))
    return tokens.select(*keys, F.posexplode_outer(pairs).alias("pos", "p")).select(
        *keys, "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b")
    )


def vocabulary_size(df: DataFrame, text_col: str = "text") -> int:
    """Number of distinct words."""
    return df.select(F.explode(coded_words(F.col(text_col))).alias("w")).agg(F.count_distinct("w")).first()[0]


def bigram_table(train: DataFrame, scored: DataFrame, models: list[str], k: float, vocab: int) -> DataFrame:
    """Log-probs of each distinct word pair of `scored` (`a, b, uses, lp_0, lp_1…`), one column
    per model trained on that model's rows of `train` (`model, text`).

    Training and scored pairs are counted in one aggregate that combines before it shuffles, so
    a frequent pair costs one row per task; the join is between distinct pairs and words, not
    occurrences. Both tables are written once, because they are read more than once.
    """
    size = range(len(models))
    occurrences = bigram_rows(train, ["model"], "text").select("a", "b", "model").unionByName(
        scored.select("a", "b", F.lit(None).cast("string").alias("model"))
    )
    counts = [F.count_if(F.col("model") == m).alias(f"c_{j}") for j, m in zip(size, models)]
    pairs = materialize(
        occurrences.where(F.col("a").isNotNull()).groupBy("a", "b")
        .agg(F.count_if(F.col("model").isNull()).alias("uses"), *counts),
        "bigrams",
    )
    starts = pairs.groupBy("a").agg(
        *[F.sum(f"c_{j}").alias(f"n_{j}") for j in size], F.count_if(F.col("uses") > 0).alias("followers")
    )
    full = lookup_with_hot_keys(pairs.where("uses > 0"), starts, ["a"], "followers", spread=F.col("b"))
    logprob = [
        F.ln((F.col(f"c_{j}") + F.lit(k)) / (F.col(f"n_{j}") + F.lit(k * vocab))).alias(f"lp_{j}")
        for j in size
    ]
    return materialize(full.select("a", "b", "uses", *logprob), "bigram-logprobs")


def _once_and_again(texts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key no other row has, and the others (None: there are none). Only keys are compared."""
    repeated = materialize(texts.groupBy(*keys).count().where("count > 1").select(*[F.col(c).alias(f"_{c}") for c in keys]), "repeated")
    if repeated.isEmpty():
        return texts, None
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return tuple(texts.join(small_side(repeated), same, how) for how in ("left_anti", "left_semi"))


def ngram_scorer(
    train: DataFrame,
    texts: DataFrame,
    models: list[str],
    k: float = 0.1,
    vocab: int | None = None,
    keys: Sequence[str] = ("text_id", "chunk_id"),
    text_col: str = "chunk_text",
) -> DataFrame:
    """`keys, model, logprobs`: every text scored by one add-k bigram model per model name.

    `train` has `model, text`. All models share one pass over the texts, which look their word pairs up in
    the model's files (`bigrams`) and stay where they are; rows that share a key are put together, by
    position. Where the shared folder is not mounted, word pairs meet their log-probs in a shuffle.
    """
    keys, lps = list(keys), [f"lp_{j}" for j in range(len(models))]
    folder = bigrams.mounted_folder(train.sparkSession)
    if folder is None:
        scored = _logprobs_by_shuffle(train, texts, models, k, vocab, keys, text_col)
    else:
        model, place = _trained(train, models, folder)
        vocab = model.words if vocab is None else vocab

        def lists(logs: np.ndarray, which: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
            ends = pa.array(ends.astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(logs[which, j], from_pandas=True)) for j in place]

        def looked_up(rows: DataFrame) -> DataFrame:
            return bigrams.score(rows, model, keys, text_col, k, vocab, ", ".join(f"{lp} array<double>" for lp in lps), lists)

        once, again = _once_and_again(texts, keys)
        scored = looked_up(once)
        if again is not None:
            positions = F.transform("lp_0", lambda x, i: i).alias("pos")
            tokens = looked_up(again).select(*keys, F.arrays_zip(positions, *lps).alias("_t"))
            merged = tokens.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("_t"))).alias("_t"))
            scored = scored.unionByName(merged.select(*keys, *[F.col(f"_t.{lp}").alias(lp) for lp in lps]))
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), F.col(lp).alias("logprobs")) for m, lp in zip(models, lps)])
    return scored.select(*keys, F.explode(per_model).alias("_m")).select(*keys, "_m.*")


def _trained(train: DataFrame, models: list[str], folder: str) -> tuple[bigrams.Bigrams, list[int]]:
    """The model of each different name, and where each of `models` is in it."""
    names = list(dict.fromkeys(models))
    return bigrams.train(train, names, folder), [names.index(m) for m in models]


def _logprobs_by_shuffle(
    train: DataFrame, texts: DataFrame, models: list[str], k: float, vocab: int | None, keys: list[str], text_col: str
) -> DataFrame:
    """`keys, lp_0, lp_1…` as lists: each occurrence of a word pair looks its log-probs up once, with frequent
    pairs answered by a broadcast of fixed size, and one shuffle on the keys puts the tokens back in order."""
    vocab = vocabulary_size(train) if vocab is None else vocab
    pairs = bigram_rows(texts, keys, text_col)
    table = bigram_table(train, pairs, models, k, vocab)
    looked_up = lookup_with_hot_keys(pairs, table, ["a", "b"], "uses", spread=F.struct(*keys, "pos"))
    lps = [f"lp_{j}" for j in range(len(models))]
    ordered = looked_up.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull() & F.col("a").isNotNull(), F.struct("pos", *lps)))).alias("_t")
    )
    return ordered.select(*keys, *[F.col(f"_t.{lp}").alias(lp) for lp in lps])


# Log-probs are summed as whole numbers of 2**-33, so that a sum doesn't depend on the order.
SCALE = 1 << 33


def ngram_ppl(
    train: DataFrame,
    texts: DataFrame,
    models: list[str],
    k: float = 0.1,
    vocab: int | None = None,
    keys: Sequence[str] = ("text_id", "chunk_id"),
    text_col: str = "chunk_text",
) -> DataFrame:
    """`keys, model, ppl`: the perplexity of every text under the models of `ngram_scorer`, null for a text
    with nothing scored.

    Word pairs never come together as lists: their log-probs are added up per text and model in the task
    that looks them up, and only the sums move. These are exact to their scale, so models with equal
    log-probs tie.
    """
    keys, size = list(keys), range(len(models))
    folder = bigrams.mounted_folder(train.sparkSession)
    if folder is None:
        found = _sums_by_shuffle(train, texts, models, k, vocab, keys, text_col)
    else:
        model, place = _trained(train, models, folder)
        vocab = model.words if vocab is None else vocab

        def sums(logs: np.ndarray, which: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
            given = ~np.isnan(logs)
            whole = np.where(given, logs, 0.0) * SCALE
            whole = np.copysign(np.floor(np.abs(whole) + 0.5), whole).astype(np.int64)

            def total(values: np.ndarray) -> np.ndarray:
                return np.diff(np.concatenate([[0], np.cumsum(values[which])])[ends])

            n = [total(given[:, j]) for j in range(given.shape[1])]
            columns = [pa.array(total(whole[:, j]), mask=n[j] == 0) for j in range(len(n))]
            return [pa.array(n[place[0]]), *[columns[j] for j in place]]

        kind = ", ".join(["n long", *[f"s_{j} long" for j in size]])
        found = bigrams.score(texts, model, keys, text_col, k, vocab, kind, sums)
    sums_of_key = found.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", *[f"s_{j}" for j in size])])
    ppl = [F.when(F.col("n") > 0, F.exp(-F.col(f"s_{j}") / (F.col("n") * F.lit(float(SCALE))))) for j in size]
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), p.alias("ppl")) for m, p in zip(models, ppl)])
    return sums_of_key.select(*keys, F.explode(per_model).alias("m")).select(*keys, "m.*")


def _sums_by_shuffle(
    train: DataFrame, texts: DataFrame, models: list[str], k: float, vocab: int | None, keys: list[str], text_col: str
) -> DataFrame:
    """`keys, n, s_0, s_1…`: each occurrence of a word pair is three numbers until it has met its log-probs,
    which are added up in the task first."""
    vocab = vocabulary_size(train) if vocab is None else vocab
    pairs = bigram_rows(texts, keys, text_col).drop("pos")
    table = bigram_table(train, pairs, models, k, vocab)
    found = lookup_with_hot_keys(pairs, table, ["a", "b"], "uses", spread=F.struct(*keys, "b"))
    sums = [F.sum(F.round(F.col(f"lp_{j}") * SCALE).cast("long")).alias(f"s_{j}") for j in range(len(models))]
    return found.groupBy(*keys).agg(F.count("lp_0").alias("n"), *sums)
