"""The driver's tables, and documents as the pages of books."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bounds Arrow batches by bytes, unless the session has its own bound below Spark's default of a gigabyte or more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    if said is None or said in ("-1", "-1b", "0", "0b") or len(said.rstrip("bB")) > 9:
        spark.conf.set(key, size)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it comes in fewer partitions than they could work on; large inputs aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


#: Documents of one source in a block of doc_ids are numbered together; blocks are then laid one after another.
NUMBERED = 65_536


def book_pages(documents: DataFrame) -> DataFrame:
    """(book_id, page_idx, raw_text): a source is a book, its documents in order of doc_id are the pages.

    Only keys are numbered, block by block of doc_id, so that no window holds a
    whole source; texts are joined back to them.
    """
    keys = documents.select(F.col("source").alias("book_id"), "doc_id", F.floor(F.col("doc_id") / NUMBERED).alias("block"))
    before = Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keys.groupBy("book_id", "block").agg(F.count("*").alias("n")).select("book_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = keys.withColumn("k", F.row_number().over(Window.partitionBy("book_id", "block").orderBy("doc_id")) - 1)
    same = inside["book_id"].eqNullSafe(blocks["book_id"]) & inside["block"].eqNullSafe(blocks["block"])
    numbered = inside.join(blocks, same).select("doc_id", inside["book_id"], (F.col("base") + F.col("k")).cast("int").alias("page_idx"))
    # Small files can hold long texts, so neither side is broadcast by its file's size.
    return documents.select("doc_id", F.col("text").alias("raw_text")).hint("merge").join(numbered, "doc_id").select("book_id", "page_idx", "raw_text")
