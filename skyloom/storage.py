"""Tables that a job writes for itself, below the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """A folder of tables, gone with ``close``. What is written there cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/skyloom-shared"
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out.saved_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t.saved_at)

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
