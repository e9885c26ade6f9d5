"""Column resolution, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pplscope.functions.text import strip


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` itself; raises before any job when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def columns_listing(df: DataFrame) -> list[str]:
    """Column names in order."""
    return list(df.columns)


def logprob_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains `logprob`."""
    return [c for c in df.columns if "logprob" in c]


def resolve_text_column(df: DataFrame) -> str:
    """`chunk_text`, else `text`, else an error."""
    for name in ("chunk_text", "text"):
        if name in df.columns:
            return name
    raise ValueError(f"neither chunk_text nor text is one of {df.columns}")


def int_keys(df: DataFrame) -> DataFrame:
    """`text_id` and `chunk_id` as int; numeric strings are accepted, anything else raises."""
    return df.withColumns({k: F.col(k).cast("int") for k in ("text_id", "chunk_id")})


def project_prompt(df: DataFrame, prompt_col: str = "chunk_text") -> DataFrame:
    """Keys and the one column to be scored."""
    require_columns(df, ["text_id", "chunk_id", prompt_col])
    return df.select("text_id", "chunk_id", F.col(prompt_col).alias("prompt"))


def nonempty_prompt(df: DataFrame, col: str = "text") -> DataFrame:
    """Rows whose text is neither null nor empty (blank text stays)."""
    return df.where(F.col(col) != "")


def nonblank_response(df: DataFrame, col: str = "model_response") -> DataFrame:
    """Rows whose response is neither missing nor blank."""
    return df.where(strip(F.col(col)) != "")


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by old name, e.g. perplexity columns to their model."""
    return df.withColumnsRenamed(names)
