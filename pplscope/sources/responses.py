"""Per-model files: response CSVs and result Parquet files, tagged by file name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pplscope.functions.text import strip_suffix_everywhere

RESPONSE_SCHEMA = "model_response string, is_correct string"
# The words a data-frame CSV reader takes for a missing value.
NA_WORDS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def na_to_null(col: Column) -> Column:
    """Null for the words that mean a missing value."""
    return F.when(~col.isin(*NA_WORDS), col)


def tag_by_model(df: DataFrame, file_to_model: dict[str, str] | None = None, suffix: str = ".csv") -> DataFrame:
    """Add `model` from the file a row was read from: the mapped name (rows of unmapped files are
    left out), or the file name without `suffix`. For a folder of part files the folder's name
    counts.

    One read of all files and a literal map; there is no loop over files. Must directly follow
    the read, where the file name is still known.
    """
    path = F.split("_metadata.file_path", "/")
    folder, own = F.try_element_at(path, F.lit(-2)), F.col("_metadata.file_name")
    name = F.when(own.startswith("part-") & folder.endswith(suffix), folder).otherwise(own)
    if file_to_model is None:
        return df.select("*", strip_suffix_everywhere(name, suffix).alias("model"))
    pairs = [F.lit(x) for item in file_to_model.items() for x in item]
    model = F.try_element_at(F.create_map(*pairs), name)
    return df.select("*", model.alias("model")).where(F.col("model").isNotNull())


def _files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The CSV files at the paths: names, globs, or folders of part files."""
    jvm, found = spark.sparkContext._jvm.org.apache.hadoop.fs, []
    for name in paths:
        path = jvm.Path(name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(path) or []:
            inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            found += [s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
    return found


def scan_responses_csv(spark: SparkSession, paths: str | list[str], file_to_model: dict[str, str] | None = None) -> DataFrame:
    """`model, model_response, is_correct` from CSV files with a header, one model per file.

    Quoted fields may span lines. Columns are found by each file's own header: files are grouped by
    header line and read once per distinct header; what a file lacks is null there. `is_correct` is
    left out only when no file has it.
    """
    files = _files(spark, [paths] if isinstance(paths, str) else list(paths))
    by_header: dict[str, list[str]] = {}
    for path in files:  # one model per file: as many files as models
        first = spark.read.text(path).limit(1).collect()
        by_header.setdefault(first[0].value if first else "", []).append(path)
    tables = [_responses_of_one_header(spark, group, file_to_model) for header, group in by_header.items() if header]
    if not tables:
        return _responses_of_one_header(spark, [paths] if isinstance(paths, str) else list(paths), file_to_model)
    joined = tables[0]
    for other in tables[1:]:
        joined = joined.unionByName(other, allowMissingColumns=True)
    return joined


def _responses_of_one_header(spark: SparkSession, paths: list[str], file_to_model: dict[str, str] | None) -> DataFrame:
    read = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("inferSchema", False).option("enforceSchema", False).csv(paths)
    )
    tagged = tag_by_model(read, file_to_model)
    response = na_to_null(F.col("model_response")).alias("model_response")
    if "is_correct" not in read.columns:
        return tagged.select("model", response)
    return tagged.select("model", response, na_to_null(F.col("is_correct")).cast("boolean").alias("is_correct"))


def scan_results(spark: SparkSession, paths: str | list[str], file_to_model: dict[str, str] | None = None) -> DataFrame:
    """Result files of several models as one table with a `model` column."""
    read = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return tag_by_model(read, file_to_model, suffix=".parquet")
