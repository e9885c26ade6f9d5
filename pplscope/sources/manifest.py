"""Lists of file URLs and what of them is still to be fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pplscope.bounded import lookup_with_hot_keys
from pplscope.functions.text import url_file_name


def manifest_files(df: DataFrame, url_col: str = "url") -> DataFrame:
    """`url` and `filename` of each listed URL, with the other columns kept."""
    return df.withColumn("url", F.col(url_col)).withColumn("filename", url_file_name(F.col("url")))


def manifest_from_json(df: DataFrame, json_col: str = "value") -> DataFrame:
    """`position, url, filename` from a JSON list of URLs; anything else gives no rows."""
    urls = F.from_json(json_col, "array<string>")
    is_list = F.col(json_col).rlike(r"^\s*\[")
    listed = df.select(F.posexplode(F.when(is_list, urls)).alias("position", "url"))
    return manifest_files(listed)


def download_status(manifest: DataFrame, existing: DataFrame, order: str = "position") -> DataFrame:
    """Every listed URL with `status`: `present` when a file of its name exists, `pending` for
    the first listing of any other name, `repeated` for its later listings."""
    # One row per name before any join; a name listed very often is then looked up as a hot key.
    first = manifest.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    have = existing.select("filename").distinct().withColumn("_have", F.lit(True))
    names = first.join(have, "filename", "left")
    status = (
        F.when(F.col("_have"), F.lit("present")).when(F.col(order) == F.col("_first"), F.lit("pending"))
        .otherwise(F.lit("repeated"))
    )
    found = lookup_with_hot_keys(manifest, names, ["filename"], "_n", spread=F.col(order))
    return found.withColumn("status", status).select(*manifest.columns, "status")


def pending_downloads(manifest: DataFrame, existing: DataFrame, order: str = "position") -> DataFrame:
    """The listings still to fetch: names without a file, each once, at its first listing."""
    first = manifest.groupBy("filename").agg(F.min_by(F.struct(*manifest.columns), order).alias("_row"))
    missing = first.join(existing.select("filename"), "filename", "left_anti")
    return missing.select("_row.*")


def download_counts(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Listings already satisfied and still pending. A repeated name is satisfied by its first
    listing."""
    names = manifest.groupBy("filename").agg(F.count(F.lit(1)).alias("_n"))
    have = existing.select("filename").distinct().withColumn("_have", F.lit(True))
    pending = F.count_if(F.col("_have").isNull())
    return names.join(have, "filename", "left").agg(
        (F.sum("_n") - pending).alias("present"), pending.alias("pending"), F.sum("_n").alias("total")
    )
