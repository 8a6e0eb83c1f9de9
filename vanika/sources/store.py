"""A folder of tables that runs add to: whole versions of a table, and batches of rows, each there once Spark has committed it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines see: in spark.checkpoint.dir, or, where that is unset, in the warehouse of a local session."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; a cluster needs a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Tables below root, on any file system that Spark reads.

    A folder of rows counts once its writer's _SUCCESS is there; what a broken run has left without it is never read, and the next run writes over it. So a reader sees
    whole versions and whole batches only, and a run that is started again after a failure goes on from what is committed. One run at a time may write.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, table: str) -> list[int]:
        """The committed folders of a table, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.root}/{table}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [(re.fullmatch(r"part_of=(\d+)", s.getPath().getName()), s.getPath()) for s in fs.listStatus(path)]
        return sorted(int(m[1]) for m, p in names if m and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _delete(self, table: str, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/part_of={number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _write(self, table: str, rows: DataFrame) -> int:
        number = max(self._numbers(table), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/part_of={number}")
        return number

    def _read(self, table: str, schema: str, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/part_of={n}" for n in numbers))

    def version(self, table: str, schema: str) -> DataFrame:
        """The newest version of a table; none: no rows."""
        return self._read(table, schema, self._numbers(table)[-1:])

    def replace(self, table: str, rows: DataFrame) -> None:
        """A new version, which may be made of the one before; versions before that go."""
        new = self._write(table, rows)
        for number in self._numbers(table):
            if number < new - 1:
                self._delete(table, number)

    def batches(self, table: str, schema: str) -> DataFrame:
        """All batches of a table."""
        return self._read(table, schema, self._numbers(table))

    def append(self, table: str, rows: DataFrame) -> int:
        """A new batch; its number."""
        return self._write(table, rows)

    def batch(self, table: str, schema: str, number: int) -> DataFrame:
        return self._read(table, schema, [number])
