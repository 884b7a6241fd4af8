"""Intermediate tables in the shared folder, and small row helpers."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolmark.session import new_folder


class Workspace:
    """Tables written below the shared folder, so that lost executors cost no rerun.

    ``keep`` cuts the lineage of a frame; ``drop`` removes a table that no
    later step reads. What a returned frame still reads has to stay.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = new_folder(spark, label)
        self._count = itertools.count()

    def path(self, name: str) -> str:
        return f"{self.root}/{next(self._count)}-{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, frame: DataFrame) -> None:
        for file in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            conf = self.spark._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
