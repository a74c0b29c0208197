"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Unset, a local session gets one of its own; on a cluster, where each host would have its own, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        where = "file://" + tempfile.mkdtemp(prefix="skyledger-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


class Tables:
    """Written tables under the shared folder: they cut lineage and survive lost executors. They go when the session ends, or by clear()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/skyledger/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def settle(self, df: DataFrame) -> DataFrame:
        """cut() for a small result over long expressions: compiled in one method with a whole stage, they would pass the size up to which the JVM compiles it."""
        whole = "spark.sql.codegen.wholeStage"
        before = self.spark.conf.get(whole)
        self.spark.conf.set(whole, "false")
        try:
            return self.cut(df)
        finally:
            self.spark.conf.set(whole, before)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
