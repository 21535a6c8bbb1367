"""Whole files written from rows, and read back: a file a key under a root that all executors reach."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.operators.assets import safe_key
from terravia.shared import discard

#: Names that are no files of their own: what is being written, and Hadoop's checksums.
NO_FILE = re.compile(r"\..*(-[0-9a-f]{32}|\.crc)")
#: Rows that a task hands on at once.
BATCH = 1000


def write(rows: DataFrame, root: str) -> int:
    """Write each row's content (text or bytes) to root/key; how many files. Keys that would leave the root fail.

    A file is written under another name and moved, so a task that is run again, or twice, leaves the same files, and no reader sees half of one.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        made_dirs = set()
        for batch in batches:
            for key, content in zip(batch["key"], batch["content"], strict=True):
                path = f"{base}/{key}"
                folder, _, name = path.rpartition("/")
                if folder not in made_dirs:
                    system.create_dir(folder, recursive=True)
                    made_dirs.add(folder)
                draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(bytes(content))
                system.move(draft, path)
            yield pd.DataFrame({"n": [len(batch)]})

    key = F.coalesce(safe_key(F.col("key")), F.raise_error(F.concat(F.lit("key leaves the store: "), F.coalesce("key", F.lit("null")))))
    keyed = rows.select(key.alias("key"), F.col("content").cast("binary").alias("content"))
    made = _dealt(keyed).mapInPandas(put, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows over as many tasks as there are cores: little content makes many files, and a fixed count keeps small partitions from being merged into one task."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _in_batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _inside(system: fs.FileSystem, base: str, key: str, deep: bool) -> Iterator[tuple[str, int | None]]:
    """Keys and bytes of the files in a folder under base, with deep those of its folders too; else these have no bytes."""
    folder = f"{base}/{key}".rstrip("/")
    for found in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        at = f"{key}/{found.base_name}" if key else found.base_name
        if found.type == fs.FileType.File and not NO_FILE.fullmatch(found.base_name):
            yield at, found.size
        elif found.type == fs.FileType.Directory and deep:
            yield from _inside(system, base, at, True)
        elif found.type == fs.FileType.Directory:
            yield at, None


def _top(spark: SparkSession, root: str) -> DataFrame:
    """key, bytes of what lies directly under root, dealt over the tasks; folders have no bytes."""

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            yield from _in_batches(_inside(*fs.FileSystem.from_uri(root), "", False), ["key", "bytes"])

    return _dealt(spark.range(1).repartition(1).mapInPandas(top, "key string, bytes double"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """key, bytes of all files under root, empty ones too. Folders are listed by the tasks, so no name reaches the driver; a task holds the names of one folder."""

    def deeper(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            each = zip(batch["key"], batch["bytes"], strict=True)
            rows = (row for key, size in each for row in (_inside(system, base, key, True) if pd.isna(size) else [(key, size)]))
            yield from _in_batches(rows, ["key", "bytes"])

    return _top(spark, root).mapInPandas(deeper, "key string, bytes long")


def read(spark: SparkSession, root: str, told: Callable[[BinaryIO], str | None]) -> DataFrame:
    """key, bytes, value: what `told` says of each file under root, which it is given opened.

    Files are dealt over the tasks one by one, whatever folder they lie in. Spark's own reader of whole files leaves out those of no bytes, and plans all files in the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            values = []
            for key in batch["key"]:
                with system.open_input_file(f"{base}/{key}") as opened:
                    values.append(told(opened))
            yield batch.assign(value=pd.Series(values, dtype="object", index=batch.index))

    return _dealt(listed(spark, root)).mapInPandas(run, "key string, bytes long, value string")


def remove(spark: SparkSession, root: str) -> None:
    """Remove all files under root, dealt over the tasks one by one; then the folders, which are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for key in batch["key"]:
                try:
                    system.delete_file(f"{base}/{key}")
                except FileNotFoundError:
                    pass  # by a task that is run again
            yield pd.DataFrame({"n": [len(batch)]})

    _dealt(listed(spark, root)).mapInPandas(run, "n long").agg(F.sum("n")).collect()
    discard(root)
