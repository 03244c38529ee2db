"""Tables in the folder that the cluster shares, to cut lineage and survive lost executors, and their removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import folder, fresh, table, write

__all__ = ["Scratch", "folder", "fresh", "remove", "table", "write"]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that write made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables that go when the work for which they were written is done."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame) -> DataFrame:
        self.paths.append(write(df))
        return self.spark.read.parquet(self.paths[-1])

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()
