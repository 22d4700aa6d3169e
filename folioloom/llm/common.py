"""Reading tables, batches that are bounded by bytes, and small helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shelf import Shelf, shared_folder  # noqa: F401  the operators' shelves


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python; records alone don't bound batches of long texts.
ARROW_BYTES = "8m"
#: Bytes of text that Python works on at a time.
BATCH_BYTES = 1_000_000


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has its own bound below Spark's default of a gigabyte or more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    if said is None or said in ("-1", "-1b", "0", "0b") or len(said.rstrip("bB")) > 9:
        spark.conf.set(key, ARROW_BYTES)


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches that are bounded by bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def batches(rows: Iterator[pa.RecordBatch], text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the Arrow batches with about limit bytes in the column number `text`, one row at least."""
    for batch in rows:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def sums_before(lengths: Column) -> Column:
    """Sums of the numbers before each of them; time is linear where lengths is a column, as blocks read it again."""
    return _before(lengths, lambda a, b: a + b)


def most_before(numbers: Column) -> Column:
    """The largest of 0 and the numbers before each of them; numbers as in sums_before."""
    return _before(numbers, lambda a, b: F.greatest(a, b))


def _before(numbers: Column, join) -> Column:
    """What join makes of the numbers before each; blocks keep the copying of growing arrays short."""
    block, n = 256, F.size(numbers)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(numbers, b * block + 1, F.lit(block)))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda a, x: F.struct(join(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), join))
    starts = F.aggregate(totals, empty, add, lambda a: a["out"])
    inside = F.zip_with(blocks, starts, lambda x, at: F.aggregate(x, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), add, lambda a: a["out"]))
    return F.when(n > 0, F.flatten(inside)).otherwise(F.array().cast("array<int>"))
