"""Log-probs to perplexities, accuracies and the rank-correlation score per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from pplscope.bounded import small_side
from pplscope.functions.arrays import perplexity
from pplscope.functions.text import strip
from pplscope.operators.columns import logprob_columns

KEYS = ["text_id", "chunk_id"]


def chunk_perplexity(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace every log-prob column by its perplexity, exp(-mean); row-local."""
    names = logprob_columns(df) if columns is None else columns
    return df.withColumns({c: perplexity(F.col(c)) for c in names})


def mean_ppl_over_columns(df: DataFrame, columns: list[str], name: str = "ppl") -> DataFrame:
    """Mean of several perplexity columns of a row, skipping missing ones."""
    present = F.array_compact(F.array(*[F.col(c) for c in columns]))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.try_divide(total, F.size(present).cast("double"))
    return df.withColumn("_mean", mean).drop(*columns).withColumnRenamed("_mean", name)


def results_to_ppl(results: DataFrame) -> DataFrame:
    """`text_id, chunk_id, model, ppl` from results tagged by model."""
    columns = logprob_columns(results)
    kept = results.select(*KEYS, "model", *columns)
    return mean_ppl_over_columns(chunk_perplexity(kept, columns), columns).select(*KEYS, "model", "ppl")


def align_models(*per_model: DataFrame) -> DataFrame:
    """Perplexity tables of several models as one long table; rows meet by key, not position."""
    aligned = per_model[0]
    for other in per_model[1:]:
        aligned = aligned.unionByName(other)
    return aligned


def ppl_wide(ppl: DataFrame, models: list[str]) -> DataFrame:
    """One column per model. Perplexities combine before the one shuffle on the chunk keys."""
    columns = [F.max(F.when(F.col("model") == m, F.col("ppl"))).alias(m) for m in models]
    return ppl.groupBy(*KEYS).agg(*columns)


def model_accuracy(responses: DataFrame) -> DataFrame:
    """Mean correctness of each model's non-blank responses; null when it has none (or no
    correctness column)."""
    correct = F.col("is_correct") if "is_correct" in responses.columns else F.lit(None)
    usable = F.when(strip(F.col("model_response")) != "", correct.cast("boolean").cast("int"))
    return responses.groupBy("model").agg(F.avg(usable).alias("accuracy"))


def common_models(ppl: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Models with both perplexities and an accuracy, and that accuracy."""
    rated = accuracy.where(F.col("accuracy").isNotNull()).select("model", "accuracy")
    return ppl.select("model").distinct().join(rated, "model").orderBy("model")


def accuracy_sign_sums(accuracy: DataFrame) -> DataFrame:
    """Per model: how many models have a lower accuracy minus how many have a higher one.

    This sum over all ordered model pairs comes from two ranks; no pair is built. The table has
    one row per model.
    """
    lower = F.rank().over(W.orderBy("accuracy")) - 1
    higher = F.rank().over(W.orderBy(F.desc("accuracy"))) - 1
    return accuracy.select("model", (lower - higher).alias("sign_sum"))


def average_rank(ppl: DataFrame) -> DataFrame:
    """Rank of each model's perplexity within its chunk, ties averaged, missing left missing.

    One shuffle and one sort on the chunk keys serve the rank and the tie count.
    """
    missing = F.col("ppl").isNull()
    chunk = W.partitionBy(*KEYS)
    below = F.rank().over(chunk.orderBy("ppl")) - F.count_if(missing).over(chunk)
    ties = F.count(F.lit(1)).over(W.partitionBy(*KEYS, "ppl"))
    return ppl.withColumn("ppl_rank", F.when(~missing, below + (ties - 1) / F.lit(2.0)))


def _models_and_sums(ppl: DataFrame, accuracy: DataFrame, models: list[str] | None) -> DataFrame:
    if models is None:
        shared = common_models(ppl, accuracy)
    else:
        shared = accuracy.where(F.col("accuracy").isNotNull() & F.col("model").isin(models))
    return accuracy_sign_sums(shared.select("model", "accuracy"))


def gamma(ppl: DataFrame, accuracy: DataFrame, models: list[str] | None = None) -> DataFrame:
    """`text_id, chunk_id, gamma`: over ordered pairs of models, the sum of
    sign(accuracy difference) × (perplexity rank difference); null when a model is missing.

    One formula for any number of models: twice the sum of rank × sign sum. Ranks compare
    perplexities, so infinite ones rank (and tie) like others; NaN is missing. Of repeated rows of a
    chunk and model the largest perplexity counts. With no common model the sum is empty, 0.0.

    Give `models` when the perplexity table's models are known, to save the pass that lists them.
    """
    sums = _models_and_sums(ppl, accuracy, models)
    return gamma_by_rank(ppl, sums)


def gamma_by_rank(ppl: DataFrame, sums: DataFrame) -> DataFrame:
    """`gamma` from sign sums, one row per model. One shuffle on the chunk keys serves the merge of
    repeated rows, the ranks and the sum."""
    n_models = sums.count()
    value = F.when(F.col("sign_sum").isNotNull() & ~F.isnan("ppl"), F.col("ppl"))
    rated = ppl.join(small_side(sums), "model", "left").select(*KEYS, "model", "sign_sum", value.alias("ppl"))
    one = rated.repartition(*KEYS).groupBy(*KEYS, "model").agg(F.max("ppl").alias("ppl"), F.first("sign_sum").alias("sign_sum"))
    total = 2.0 * F.sum(F.col("ppl_rank") * F.col("sign_sum"))
    return average_rank(one).groupBy(*KEYS).agg(
        F.when(F.count("ppl") == n_models, F.coalesce(total, F.lit(0.0))).alias("gamma")
    )
