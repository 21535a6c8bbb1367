"""Vector compression: each of a vector's parts becomes the index of its nearest codebook entry.

Components become integers, floor(SCALE * x), and all that follows is exact. A vector is cut
into PARTS equal parts; each part position has a codebook of up to ENTRIES entries. Codebooks
start as the parts of the vectors with the smallest ids. A round broadcasts the codebooks;
each Arrow batch gets the squared distances of its parts to all entries as
|c|^2 - 2 x.c (|x|^2 is the same for every entry) by int64 matrix products, takes the first
smallest, and adds up the parts of each entry, so that a task hands on one row an entry;
these are merged by a grouped shuffle, and an entry becomes floor(sum / count). An entry that
no part chose stays. What reaches the driver is ENTRIES vectors at first and PARTS * ENTRIES
sums a round, whatever the number of vectors.

Defined cases: a null vector, or one with a null or non-finite component, is left out. The length of
all vectors is that of the one with the smallest id among those that PARTS divides. A vector
of another length (an empty one too), or with a component of magnitude LIMIT or more, whose
squares could leave 64 bits, cannot be coded: it stays in the result with a null code and a
null error, and takes no part in the codebooks. Rows with one id are rows of their own, in order of
their vectors where they compete for the codebook; null ids come last. Ties go to the lower
index. With fewer than ENTRIES vectors the codebooks are smaller; without any, empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravia.llm.common import kept, table, unused

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integers stay under 2^27, so that sums of squares over a part of some 2^8 components fit in 64 bits.
LIMIT = float(1 << 17)
#: Vectors whose distances are held at a time.
HELD = 2048
#: Labels that are broadcast with their sums at most; beyond, sums are spread over SALTS copies and joined.
BROADCAST_LABELS, SALTS = 100_000, 32


def integers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors can be coded, their integer components). Vectors are of float or double."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    fit = np.flatnonzero(sizes == length)
    flat = column.take(pa.array(fit)).flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(fit), length)
    good = (np.abs(values) < LIMIT).all(axis=1)  # NaN compares as false
    return fit[good], np.floor(values[good] * SCALE).astype(np.int64)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first nearest entry, squared distance) of each row."""
    index, error = np.empty(len(part), dtype=np.int64), np.empty(len(part), dtype=np.int64)
    norms = (entries * entries).sum(axis=1)
    for a in range(0, len(part), HELD):
        x = part[a : a + HELD]
        distance = norms - 2 * (x @ entries.T)
        best = distance.argmin(axis=1)
        index[a : a + HELD] = best
        error[a : a + HELD] = distance[np.arange(len(x)), best] + (x * x).sum(axis=1)
    return index, error


def _whole(vector: str) -> Column:
    """Whether a vector has neither nulls nor components that are not finite; null for a null one."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def cleaned(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows without null vectors and such as have null or non-finite components."""
    return rows.where(F.coalesce(_whole(vector), F.lit(False)))


def first_codebooks(rows: DataFrame, length: int, parts: int, entries: int, key: str, vector: str) -> np.ndarray:
    """(part, entry, position): the parts of the vectors with the smallest keys."""
    fit = rows.where((F.size(vector) == length) & F.forall(vector, lambda x: F.abs(x) < LIMIT))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("floors")
    first = fit.select(key, floors).orderBy(F.asc_nulls_last(key), "floors").limit(entries).collect()
    return np.array([r["floors"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: Broadcast, vector: str) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (count, sum of each component) of the parts whose nearest entry it is."""
    width = books.value.shape[2]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, _ = books.value.shape
        total, count = np.zeros(books.value.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), parts * width)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                index, _ = nearest(part, books.value[p])
                np.add.at(total[p], index, part)
                count[p] += np.bincount(index, minlength=entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, i]) for i in range(width))], ["part", "entry", "n", *(f"s{i}" for i in range(width))])

    columns = [f"s{i}" for i in range(width)]
    made = rows.select(vector).mapInArrow(summed, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in columns))
    merged = made.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *columns]))
    return {(r["part"], r["entry"]): (r["n"], list(r[3:])) for r in merged.collect()}  # at most PARTS * ENTRIES rows


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, key: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """The codebooks (part, entry, position) of cleaned rows; of shape (parts, 0, 0) without a vector that can be coded."""
    first = rows.where((F.size(vector) > 0) & (F.size(vector) % parts == 0)).orderBy(F.asc_nulls_last(key), F.size(vector)).select(F.size(vector)).first()
    if first is None:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    books = first_codebooks(rows, first[0], parts, entries, key, vector)
    if not books.size:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(books)
        books = books.copy()
        for (part, entry), (n, sums) in _sums(rows, sent, vector).items():
            books[part, entry] = [s // n for s in sums]
        sent.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray, vector: str = "embedding") -> DataFrame:
    """rows with `code` (an index of two hexadecimal digits for each part) and `error`, the squared distance, in place of the vector and of columns of these names."""
    others = [c for c in rows.columns if c not in (vector, "code", "error")]
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = sent.value.shape
        for batch in batches:
            codes: list[str | None] = [None] * batch.num_rows
            errors, known = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=bool)
            if width:
                at, x = integers(batch.column(vector), parts * width)
                index = np.empty((len(at), parts), dtype=np.uint8)
                for p in range(parts):
                    index[:, p], far = nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), sent.value[p])
                    errors[at] += far
                known[at] = True
                for i, row in zip(at.tolist(), index, strict=True):
                    codes[i] = row.tobytes().hex()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(codes, pa.string()), pa.array(errors, mask=~known)], [*others, "code", "error"])

    kept_columns = rows.select(*others, vector)
    return kept_columns.mapInArrow(coded, kept_columns.drop(vector).schema.add("code", "string").add("error", "long"))


def decode(code: str, books: np.ndarray) -> list[float]:
    """The vector that a code stands for."""
    return [x / SCALE for p, e in enumerate(bytes.fromhex(code)) for x in books[p, e].tolist()]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_group_sum(rows: DataFrame, group: str, value: str, into: str, broadcast_groups: int = BROADCAST_LABELS, salts: int = SALTS) -> DataFrame:
    """rows with the sum of `value` over the rows of an equal `group`, nulls together. A group may hold most rows."""
    g, s = unused(rows, "group", "salt")
    sums = kept(rows.groupBy(F.col(group).alias(g)).agg(F.sum(value).alias(into)))
    if sums.count() <= broadcast_groups:
        return rows.join(F.broadcast(sums), rows[group].eqNullSafe(sums[g])).drop(g)
    salted = sums.withColumn(s, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    others = rows.withColumn(s, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return others.join(salted, others[group].eqNullSafe(salted[g]) & (others[s] == salted[s])).select(*(others[c] for c in rows.columns), into)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    books = fit(rows)
    coded = with_group_sum(kept(encode(rows, books)), "label", "error", "label_error")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in SQL, for vectors of one length."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
             FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT r, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(part))""",
        f"""b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM
                 (SELECT r, part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} USING (part)) GROUP BY r, part)"""
        )
        if k < rounds:
            steps.append(
                f"""b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM b{k} LEFT JOIN
                     (SELECT part, entry, list(q ORDER BY i) AS m FROM
                        (SELECT part, entry, i, ((sum(z) - (((sum(z) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS q FROM
                           (SELECT part, entry, unnest(x) AS z, unnest(range(len(x))) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY part, entry, i)
                      GROUP BY part, entry) USING (part, entry))"""
            )
    last = rounds
    steps.append(f"""e AS (SELECT r, sum(d)::BIGINT AS error, string_agg(printf('%02x', entry), '' ORDER BY part) AS code FROM a{last} GROUP BY r)""")
    steps.append(f"""h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{last})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN e USING (r), h"
