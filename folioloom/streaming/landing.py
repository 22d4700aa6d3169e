"""A landing folder of page tables: each arrived batch of whole books runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

PAGES = "book_id string, page_idx int, raw_text string"


def watch(spark: SparkSession, source: str, target: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> StreamingQuery:
    """Runs plan over each batch of new files and writes its result under the batch's number, so a retried batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
