"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..plans.tables import shared_dir

#: Spark removes a query's shuffle files when the query ends: its table is written by then.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes tables under the shared folder, so that a lost executor costs a reread and not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/skyledger/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written and read again."""
        return self.table(df)[0]

    def table(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.root}/{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def clear(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop(self.root)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names, each with so many underscores before it that it is no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def schema_and(df: DataFrame, **more: str) -> StructType:
    """df's schema and further fields, as a new one (StructType.add changes its own)."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items())).fields])
