"""Working tables of jobs that run in several steps, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the master is local and it is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lapsewise-")
    return base.rstrip("/")


class Working:
    """Tables of one job: written, read again, and deleted by the job itself when nothing reads them any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: list[str] = []

    def table(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made:04d}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_all_but(self, last: int = 0) -> None:
        """Delete the tables, but for the last ones."""
        gone, self.paths = (self.paths[:-last], self.paths[-last:]) if last else (self.paths, [])
        for path in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
