"""Parquet scans with an explicit row order, a stated division, and limits planned from footers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pplscope.operators.identity import scan_index


def scan_parquet(
    spark: SparkSession,
    path: str | list[str],
    with_order: bool = False,
    schema: StructType | str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Parquet table at `path`; columns and filters are pushed down by whoever uses it.

    `with_order` adds `_file, _row`, each row's place in the scan. `partitions` deals the rows out that
    many ways, whatever row groups the files have: a file is read by as many tasks as it has row groups,
    and a step that is costly per row should not depend on them.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(*([path] if isinstance(path, str) else path))
    columns = df.columns
    if with_order or partitions:
        df = df.select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
        )
    if partitions:
        # By place, so that a task that is run again deals its rows out as before.
        df = df.repartitionById(partitions, F.pmod(F.xxhash64("_file") + F.col("_row"), F.lit(partitions)).cast("int"))
    return df if with_order else df.select(*columns)


def scan_glob(
    spark: SparkSession, data_dir: str, pattern: str = "*.parquet", with_order: bool = True, **options
) -> DataFrame:
    """All Parquet files under `data_dir` matching `pattern`; scan order is by path, then row."""
    path = f"{data_dir.rstrip('/')}/{pattern}"
    try:
        return scan_parquet(spark, path, with_order=with_order, **options)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise FileNotFoundError(f"{data_dir} holds nothing that fits {pattern}") from error
        raise


def stream_prompts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`doc_id` and text of the non-empty prompts of an ordered scan, numbered in scan order."""
    return scan_index(df, keep=F.col(text_col) != "", name="doc_id").select("doc_id", text_col)


def files_in_order(spark: SparkSession, data_dir: str, pattern: str = "*.parquet") -> list[str]:
    """The files of a folder in scan order, or those of a table written as a folder of part files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{data_dir.rstrip('/')}/{pattern}" if pattern else data_dir)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: list[str] = []
    for status in fs.globStatus(top) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath().toString() for s in inside if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(found)


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet file, from its footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        return reader.getRecordCount()
    finally:
        reader.close()


def first_rows(
    spark: SparkSession, files: list[str], n: int, keep: Column | None = None, name: str = "doc_id",
    schema: StructType | str | None = None,
) -> DataFrame:
    """The first `n` rows of the files, in their order, that `keep` holds for, numbered from 0 as `scan_index` does.

    Footers tell how many files must be read to have `n` rows; only while too few of these are kept
    are more taken, at least as many rows again. What is read depends on `n`, not on how many files
    there are. Within the files taken, too, tasks stop at their own first `n` kept rows.
    """
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    taken, rows, wanted = 0, 0, n
    while True:
        while taken < len(files) and (rows < wanted or not taken):
            rows += footer_rows(spark, files[taken])
            taken += 1
        df = scan_parquet(spark, files[:taken], with_order=True, schema=schema)
        if taken == len(files) or df.where(keep).limit(n).count() >= n:
            break
        wanted = 2 * rows
    return scan_index(df, keep, name).where(F.col(name) < n)


def limited_prompts(
    spark: SparkSession, data_dir: str, pattern: str, limit: int, batch: int, exact: bool = False, text_col: str = "text"
) -> DataFrame:
    """`doc_limit` of `stream_prompts` of a folder, without reading more files than that takes."""
    files = files_in_order(spark, data_dir, pattern)
    if not files:
        raise FileNotFoundError(f"{data_dir} holds nothing that fits {pattern}")
    bound = limit if exact else -(-limit // batch) * batch
    return first_rows(spark, files, bound, F.col(text_col) != "").select("doc_id", text_col)


def first_in_scan(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first `n` rows of a table in scan order, `_file` and `_row` with them; every row when `n` is not positive."""
    if n <= 0:
        return scan_parquet(spark, path, with_order=True)
    df = first_rows(spark, files_in_order(spark, path, ""), n, name="_number")
    return df.drop("_number")
