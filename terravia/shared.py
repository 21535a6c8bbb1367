"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset and the session is local, a temporary folder is set; on a
    cluster without the setting this is an error, as no machine-local folder would do.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='terravia-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return spark.conf.get("spark.checkpoint.dir", None) or found


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; later steps read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(path: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)


class Scratch:
    """Tables of an iteration in the shared folder. A table that is put again takes its old version's place."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, fresh_path(spark, name)
        self._at: dict[str, str] = {}
        self._n = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written; the version before is removed once this one is there."""
        self._n += 1
        path = f"{self.path}/{name}-{self._n}"
        df.write.parquet(path)
        before, self._at[name] = self._at.get(name), path
        if before:
            discard(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")

    def appended(self, name: str, like: DataFrame) -> DataFrame:
        """All that was appended; there was something."""
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        """Remove what was put; what was appended stays, as results read it."""
        for path in self._at.values():
            discard(path)
        self._at = {}
