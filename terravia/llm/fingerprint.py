"""Document fingerprints by quartile bucket digests.

Every three successive bytes of a text are hashed into one of BUCKETS buckets. The
digest holds the text's length on a logarithmic scale, and for each bucket the quartile
of its count among all the buckets, in two bits. Two digests are compared by a
difference score: the quartile steps between them, plus a charge for unequal lengths,
bounded by `WORST`; likeness is one minus the share of it.

For the query each document is also compared with its successor by doc_id, and with an
edited text that ends in the successor's beginning. Documents are dealt by doc_id into
ranges of about RANGE_BYTES of text, a partition each. Their bounds are quantiles of a
sample of ids, taken by a hash with a chance in proportion to the size of the text: of
about SAMPLED ids a range, which reach the driver. The first document of each range is sent to the
preceding range as well, so every range can be walked alone in order; texts are shuffled
once, and no task sees more than its range. Ids are cut between, not within: rows of one
doc_id, or without one, share a range.

Defined cases: a null text is an empty one; texts of under three bytes have no triplets
and the digest of zero counts. Order is by doc_id, then text; rows with a null doc_id
come last. The last document's successor is the first; a single document succeeds
itself. Repeated rows are kept, each with a result. Likeness is symmetric and 1 for
equal texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 512
#: Odd multiplier of the multiplicative hash of three bytes.
MULTIPLIER = 0x9E3779B1
LENGTH_STEP = 1.25
LENGTH_CHARGE = 12
WORST = BUCKETS // 2
#: Bytes of text counted at a time.
HELD = 1 << 22
#: So many ranges Spark's driver schedules well; beyond, ranges get larger. Ids sampled for each.
MOST_RANGES, RANGE_BYTES, SAMPLED = 65536, 8 << 20, 16


def bucket_counts(datas: list[bytes]) -> np.ndarray:
    """For each text, how many of its byte triplets fall in each bucket."""
    counts = np.zeros((len(datas), BUCKETS), dtype=np.int64)
    # a triplet belongs to the piece in which it starts
    pieces = [(i, d[a : a + HELD + 2]) for i, d in enumerate(datas) for a in range(0, max(1, len(d) - 2), HELD)]
    at = 0
    while at < len(pieces):
        size, end = 0, at
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= HELD):
            size += len(pieces[end][1])
            end += 1
        owners, parts = zip(*pieces[at:end], strict=True)
        lengths = np.array([len(p) for p in parts])
        x = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint32)
        if len(x) >= 3:
            h = ((x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(MULTIPLIER)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            owner = np.repeat(np.arange(end - at, dtype=np.int64), lengths)
            whole = owner[:-2] == owner[2:]
            flat = np.bincount((owner[:-2] * BUCKETS + h)[whole], minlength=(end - at) * BUCKETS)
            np.add.at(counts, list(owners), flat.reshape(end - at, BUCKETS))
        at = end
    return counts


def digests(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """(quartile by text and bucket, length code by text)."""
    datas = [t.encode() for t in texts]
    if not datas:
        return np.zeros((0, BUCKETS), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    counts = bucket_counts(datas)
    ordered = np.sort(counts, axis=1)
    quartile = np.zeros(counts.shape, dtype=np.uint8)
    for q in (1, 2, 3):
        quartile += counts > ordered[:, q * BUCKETS // 4 - 1 : q * BUCKETS // 4]
    length = np.floor(np.log1p([len(d) for d in datas]) / np.log(LENGTH_STEP)).astype(np.int64)
    return quartile, length


def encode(quartile: np.ndarray, length: np.ndarray) -> list[str]:
    """Length code in two hexadecimal digits, then two bits a bucket."""
    four = quartile.reshape(len(quartile), -1, 4)
    packed = four[..., 0] | (four[..., 1] << 2) | (four[..., 2] << 4) | (four[..., 3] << 6)
    return [f"{min(n, 255):02x}{row.tobytes().hex()}" for n, row in zip(length, packed, strict=True)]


def decode(digest: str) -> tuple[np.ndarray, int]:
    packed = np.frombuffer(bytes.fromhex(digest[2:]), dtype=np.uint8)
    return np.stack([(packed >> s) & 3 for s in (0, 2, 4, 6)], axis=1).reshape(-1), int(digest[:2], 16)


def likeness(qa: np.ndarray, na: np.ndarray, qb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """0 to 1, row by row."""
    steps = np.abs(qa.astype(np.int16) - qb.astype(np.int16)).sum(axis=-1)
    return 1.0 - np.minimum(WORST, steps + LENGTH_CHARGE * np.abs(na - nb)) / WORST


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (range, guest, doc_id, text): each range's own rows, then the guest that succeeds its last."""
    before: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if before is None else pd.concat([before, frame], ignore_index=True)
        before = frame.tail(1)
        yield from _successive(frame)


def _successive(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
    own, missing, ranges = (~frame["guest"]).tolist(), frame["missing"].tolist(), frame["range"].tolist()
    b = 0
    while b < len(texts) - 1:
        a, size = b, 0
        while b < len(texts) - 1 and (b == a or size < HELD):
            size += len(texts[b])
            b += 1
        part = texts[a : b + 1]
        q, n = digests(part)
        rows = [i for i in range(b - a) if own[a + i] and ranges[a + i] == ranges[a + i + 1]]
        if not rows:
            continue
        edited = [part[i][: len(part[i]) - len(part[i]) // 4] + part[i + 1][: len(part[i]) // 4] for i in rows]
        eq, en = digests(edited)
        after = [i + 1 for i in rows]
        yield pd.DataFrame(
            {
                "doc_id": pd.array([None if missing[a + i] else ids[a + i] for i in rows], dtype="Int64"),
                "n_chars": [len(part[i]) for i in rows],
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": encode(q[rows], n[rows]),
                "edited_fingerprint": encode(eq, en),
                "near_edited": likeness(q[rows], n[rows], eq, en),
                "near_next": likeness(q[rows], n[rows], q[after], n[after]),
            }
        )


def range_bounds(docs: DataFrame, ranges: int, total: int) -> list[int]:
    """At most ranges - 1 doc_ids that cut the ids into ranges of about as much text; total: of octet_length(text) + 1 over all."""
    if ranges < 2:
        return []
    share = (F.octet_length("text") + 1) * F.lit(float(SAMPLED * ranges)) / total
    draw = F.pmod(F.xxhash64("doc_id", F.lit("range")), F.lit(1 << 40)) / float(1 << 40)
    sample = np.sort(np.array([r[0] for r in docs.where(draw < share).select("doc_id").collect()], dtype=np.int64))
    at = [len(sample) * i // ranges for i in range(1, ranges)]
    return sorted(set(sample[at].tolist())) if len(sample) else []


def with_successors(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    if ranges is None:
        ranges = min(MOST_RANGES, max(16, total // RANGE_BYTES))
    bounds = np.array(range_bounds(docs.where(~F.col("missing")), ranges, total), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(np.where(missing, len(bounds) + 1, np.searchsorted(bounds, ids, side="right")).astype("int32"))

    # the first id of each range that has rows goes to the range before it as well, the first of all to the last
    firsts = docs.select("missing", "doc_id").withColumn("range", range_of("doc_id", "missing")).groupBy("range").agg(F.min("doc_id").alias("first"), F.first("missing").alias("missing")).orderBy("range").collect()
    hosts = {(r["missing"], r["first"]): firsts[i - 1]["range"] for i, r in enumerate(firsts)}
    heads = np.array(sorted(x for m, x in hosts if not m), dtype=np.int64)
    goes_to = np.array([hosts[False, x] for x in heads.tolist()], dtype=np.int32)
    missing_to = hosts.get((True, 0), -1)

    @F.pandas_udf("int")
    def host_of(ids: pd.Series, missing: pd.Series) -> pd.Series:
        """The range that a row visits as a guest; -1 for most rows."""
        out = np.full(len(ids), -1, dtype=np.int32)
        if len(heads):
            at = np.minimum(np.searchsorted(heads, ids), len(heads) - 1)
            out = np.where(heads[at] == ids, goes_to[at], -1)
        return pd.Series(np.where(missing, missing_to, out).astype("int32"))

    placed = docs.withColumns({"own": range_of("doc_id", "missing"), "host": host_of("doc_id", "missing")})
    place = lambda c, guest: F.struct(F.col(c).alias("range"), F.lit(guest).alias("guest"))
    at = F.when(F.col("host") < 0, F.array(place("own", False))).otherwise(F.array(place("own", False), place("host", True)))
    dealt = placed.select("doc_id", "missing", "text", F.explode(at).alias("at")).select("at.range", "at.guest", "missing", "doc_id", "text")
    # the range is the number of the partition: hashing it would put several into one
    in_order = dealt.repartitionById(len(bounds) + 2, F.col("range")).sortWithinPartitions("range", "guest", "missing", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order.mapInPandas(_walk, schema)


def op6(docs: DataFrame) -> DataFrame:
    return with_successors(docs)
