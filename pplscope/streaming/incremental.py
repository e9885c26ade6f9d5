"""Score documents as their files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pplscope.bounded import small_side
from pplscope.operators.chunking import chunk_documents
from pplscope.operators.identity import SCAN_ORDER, dedup_keep_first
from pplscope.operators.scoring import Scorer, score_chunks


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def incremental_scoring(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    make_scorer: Callable[[], Scorer],
    schema: StructType | str = "id long, text string",
    chunk_size: int = 500,
    chunk_overlap: int = 100,
    max_files: int | None = None,
) -> None:
    """Clean, chunk and score the document files that arrived since the last call, and append
    their results to `out_dir/results`.

    An id that was seen before, in this batch or an earlier one, is dropped: the first arrival
    counts. Every batch writes its own `batch=` folders, so a batch that is run again after a
    failure replaces its output instead of doubling it. The ids of each batch are a narrow table
    of their own, the only history later batches read.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arriving = reader.parquet(in_dir).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    id_type = arriving.schema["id"].dataType.simpleString()

    def process(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        first = dedup_keep_first(batch, "id", SCAN_ORDER)
        seen = _table(session, f"{out_dir}/ids", f"id {id_type}, batch long")
        if seen is not None:
            # The batch's ids go to the history, not the history to the batch.
            arrived = small_side(first.select(F.col("id").alias("_id")))
            known = seen.where(F.col("batch") < number).join(arrived, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
            again = small_side(known.select(F.col("id").alias("_id")))
            first = first.join(again, F.col("id").eqNullSafe(F.col("_id")), "left_anti")
        chunks = chunk_documents(first, chunk_size, chunk_overlap)
        score_chunks(chunks, make_scorer).write.mode("overwrite").parquet(f"{out_dir}/results/batch={number}")
        first.select("id").write.mode("overwrite").parquet(f"{out_dir}/ids/batch={number}")

    query = (
        arriving.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """All results written so far."""
    return spark.read.parquet(f"{out_dir}/results").drop("batch")
