"""A keyed store on files: a row a key, dealt into folders by a hash of the key.

`put` reads only the folders that new rows fall in, and rewrites only those in which something changes, all at once
(dynamic partition overwrite), so putting the same rows again writes nothing and other folders keep their
files. A store has one writer at a time; readers see a folder before or after it is replaced. Keys are plain nested names (`a/b.png`);
one that would leave the store is refused.

Defined cases: of several rows with one key in a batch the greatest stands, by the column `at` if there is one, then by the others. Null keys are refused.
"""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.operators.assets import safe_key
from terravia.shared import kept

PARTS = 64


def _part(parts: int):
    return F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")


def _exists(path: str) -> bool:
    system, name = fs.FileSystem.from_uri(path)
    return any(f.base_name.startswith("part=") for f in system.get_file_info(fs.FileSelector(name, allow_not_found=True)))


def _in_parts(spark: SparkSession, path: str, like: DataFrame, numbers: list[int]) -> DataFrame:
    if not _exists(path):
        return spark.createDataFrame([], like.schema)
    return spark.read.schema(like.schema).parquet(path).where(F.col("part").isin(numbers)).select(like.columns)


def _keyed(rows: DataFrame, parts: int) -> DataFrame:
    """One row a key, with its folder; unsafe keys fail."""
    plain = safe_key(F.col("key"))
    checked = rows.withColumn("key", F.coalesce(plain, F.raise_error(F.concat(F.lit("key leaves the store: "), F.coalesce("key", F.lit("null"))))))
    rest = [c for c in rows.columns if c != "key"]
    lead = (["at"] if "at" in rest else []) + [c for c in rest if c != "at"]
    one = checked.groupBy("key").agg(F.max(F.struct(*lead)).alias("m")).select("key", *(F.col(f"m.{c}").alias(c) for c in rest)) if rest else checked.select("key").distinct()
    return one.withColumn("part", _part(parts))


def _rewrite(rows: DataFrame, path: str) -> None:
    (
        rows.repartition("part").sortWithinPartitions("part", "key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    )


def _numbers(rows: DataFrame) -> list[int]:
    return sorted(r["part"] for r in rows.select("part").distinct().collect())  # at most the number of folders


def put(rows: DataFrame, path: str, parts: int = PARTS) -> int:
    """Set the rows' keys to what the rows hold; how many keys changed. rows: key and any other columns, the same ones in every batch."""
    spark = rows.sparkSession
    new = kept(_keyed(rows, parts))
    there = _in_parts(spark, path, new, _numbers(new))
    changed = kept(new.exceptAll(there.join(new.select("key"), "key", "left_semi").select(new.columns)))
    n = changed.count()
    if n:
        others = _in_parts(spark, path, new, _numbers(changed)).join(changed.select("key"), "key", "left_anti").select(new.columns)
        # written elsewhere first: what is replaced is also read
        _rewrite(kept(others.unionByName(changed)), path)
    return n


def delete(keys: DataFrame, path: str, parts: int = PARTS) -> int:
    """Take keys (key) out; how many were there. A folder that loses its last row is removed."""
    spark = keys.sparkSession
    if not _exists(path):
        return 0
    gone = kept(keys.select(safe_key(F.col("key")).alias("key")).where("key IS NOT NULL").distinct().withColumn("part", _part(parts)))
    whole = spark.read.parquet(path)
    near = whole.where(F.col("part").isin(_numbers(gone)))
    hit = kept(near.join(gone.select("key"), "key", "left_semi").select("key", "part"))
    n = hit.count()
    if n:
        touched = _numbers(hit)
        left = kept(whole.where(F.col("part").isin(touched)).join(hit.select("key"), "key", "left_anti").select(whole.columns))
        _rewrite(left, path)
        system, name = fs.FileSystem.from_uri(path)
        for empty in set(touched) - set(_numbers(left)):
            system.delete_dir(f"{name}/part={empty}")
    return n


def get(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store."""
    return spark.read.parquet(path).drop("part")


def sweep(spark: SparkSession, path: str, before: float, parts: int = PARTS) -> int:
    """Take out what is older than a time (column at); how many rows went."""
    if not _exists(path):
        return 0
    return delete(spark.read.parquet(path).where(F.col("at") < before).select("key"), path, parts)
