"""Tables written to the cluster's shared folder to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="folioloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Shelf:
    """Written tables of one run: put() writes and rereads one, drop() removes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)

    def put(self, df: DataFrame, partitions: int | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        df = df.coalesce(partitions) if partitions else df
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def put_bucketed(self, df: DataFrame, buckets: int, key: str) -> DataFrame:
        """The same as a table bucketed by key, which joins on key read without a shuffle."""
        self.count += 1
        name, path = f"shelf_{uuid.uuid4().hex}", f"{self.root}/{self.count:03d}"
        df.write.format("parquet").bucketBy(buckets, key).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        out._shelf_path = path
        return out

    def folder(self) -> str:
        """A new folder of this run for files that something else writes."""
        self.count += 1
        return f"{self.root}/{self.count:03d}"

    def drop(self, df: DataFrame) -> None:
        self._delete(df._shelf_path)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        """Removes the folder when the program ends; one whose session has ended stays."""
        if self.spark.sparkContext._jsc is not None and self.count:
            try:
                self._delete(self.root)
            except OSError:
                pass
