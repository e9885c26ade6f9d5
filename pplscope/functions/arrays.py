"""Array, map and grid columns: log-prob extraction, means, windows, histogram bins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TOKEN = "struct<logprob:float,decoded_token:string>"
# One scored prompt: per token a map from token id to its score; an unscored token is null.
RAW_TYPE = f"array<map<string,{TOKEN}>>"


def raw_from_json(col: Column) -> Column:
    """Decode a scorer's JSON (list of null or object) to RAW_TYPE."""
    return F.from_json(col, RAW_TYPE)


def extract_first_logprob(raw: Column) -> Column:
    """Log-prob of each prompt token: entry 0 never counts, null entries are skipped, and of
    each map the first value is taken. Refers to `raw` once, so that decoding it there is not repeated."""
    later = F.filter(raw, lambda x, i: (i > 0) & x.isNotNull())
    return F.transform(later, lambda x: F.get(F.map_values(x), F.lit(0))["logprob"])


def all_tokens(raw: Column) -> Column:
    """Every token score of every non-null entry, in order; null input gives an empty array."""
    present = F.filter(F.coalesce(raw, F.array().cast(RAW_TYPE)), lambda x: x.isNotNull())
    return F.flatten(F.transform(present, F.map_values))


def extract_all_logprobs(raw: Column) -> Column:
    """struct<prompt_logprobs, decoded_tokens> over `all_tokens`, which are worked out once for both (and
    for whoever takes the fields apart)."""

    def both(tokens: Column) -> Column:
        return F.struct(
            F.transform(tokens, lambda t: t["logprob"]).alias("prompt_logprobs"),
            F.transform(tokens, lambda t: t["decoded_token"]).alias("decoded_tokens"),
        )

    return F.get(F.transform(F.array(all_tokens(raw)), both), F.lit(0))


def array_mean(values: Column) -> Column:
    """Mean in double precision; null when empty or null."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.try_divide(total, F.size(values).cast("double"))


def perplexity(logprobs: Column) -> Column:
    """exp(-mean); null when empty, null or not a number."""
    return F.nanvl(F.exp(-array_mean(logprobs)), F.lit(None).cast("double"))


def log_grid(low: float = -4.0, high: float = 2.0, points: int = 50) -> Column:
    """`points` powers of ten with evenly spaced exponents from `low` to `high`."""
    step = (high - low) / (points - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.pow(F.lit(10.0), F.lit(low) + i * F.lit(step))
    )
