"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.shared import fresh_path, kept  # noqa: F401  the operators take them from here

#: What a word is: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(path: str) -> None:
    """Remove a folder of intermediate rows that nothing reads any more."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    if system.get_file_info(name).type == fs.FileType.Directory:
        system.delete_dir(name)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        names.append(name)
        taken.add(name.lower())
    return names


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, joint: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima of integers: joint over all up to each. Steps of 1, 2, 4 ...: a fold would copy what it gathers for every value."""
    powers = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda p: p < F.size(values))
    return F.aggregate(powers, values, lambda a, p: F.transform(a, lambda x, i: F.when(i >= p, joint(x, F.get(a, i - p))).otherwise(x)))


def filtered(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition), evaluated above df's own columns.

    A condition on computed columns is otherwise moved below them, with their whole
    definitions put in its place as often as they refer to each other. A column that is not
    deterministic holds it where it is.
    """
    (at,) = unused(df, "at")
    return df.withColumn(at, F.monotonically_increasing_id()).where(condition & (F.col(at) >= 0)).drop(at)
