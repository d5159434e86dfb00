"""Shared folder, materialised steps and packing of ids, for the operators beside it."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession


_local: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (``spark.checkpoint.dir``).

    Where a session on one machine names none, as in tests, a folder of this process serves; on a
    cluster that is an error, for executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tollhouse-shared-"))
        base = _local[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files that outlive executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


class Steps:
    """Tables that a job stores on its way, dropped once no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as ``stored`` gives it; an earlier table of that name goes when the new one is there."""
        path = shared_dir(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes the tables of these names, where there are any."""
        for name in names:
            if path := self.paths.pop(name, None):
                deleted(self.spark, path)


def split_count(df: DataFrame, least: int = 1) -> int:
    """Number of shuffle partitions of the session, ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(value: str | None) -> bytes:
    """UTF-8 of a text; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def ids_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.ascontiguousarray(ids, dtype="<u4").tobytes()

