"""SimHash near-duplicate groups by multi-index hashing.

A fingerprint has 64 bits; a bit is set where over half the XXH64 values (seed 42) of
the text's word shingles have it. Two documents are linked if their fingerprints
differ in at most `distance` bits; a group is a connected component of links.

Method. Distinct fingerprints are cut into `segments` segments. By the pigeonhole rule
two fingerprints within the distance agree up to a small radius in one segment, so each
fingerprint enumerates the Hamming balls of those radii in its segments, the table of
segment values is matched by an equality join, and the whole distance is verified in
the join's condition, so that only links leave it. A segment value that over
`bucket_cap` distinct fingerprints share would make a bucket quadratic: those
fingerprints, and the ones whose balls reach them, are linked exactly another way:
two fingerprints are within r bits if and only if balls of radius ceil(r/2) and
floor(r/2) around them meet in a midpoint; grouped by midpoint, a star of links joins
what meets there. No pair is lost and no bucket is expanded into all its pairs.
Components come from alternating star contractions, checkpointed every round.

Defined cases: a null or empty text, or one of white space, has fingerprint zero and
is linked like any other. A text of fewer words than a shingle is one shingle. Equal
texts have equal fingerprints. A row with a null doc_id gets a fingerprint but takes
no part in linking (component_id null); repeated rows each get a result row. Ties do
not arise: the component is named by its smallest doc_id. Empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import kept

SEED = 42
LANES = np.uint64(0x0001000100010001)
#: So many shingles are counted at a time; a 16-bit lane holds 65,535.
PIECE = 1 << 15
#: Shingles whose hashes are held at a time.
HELD = 1 << 18
MASK32 = (1 << 32) - 1


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each piece, how many of its hashes have each of the 64 bits; pieces are at most PIECE long."""
    counts = np.empty((len(starts), 64), dtype=np.int64)
    for bit in range(16):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
        for lane in range(4):
            counts[:, bit + 16 * lane] = (sums >> np.uint64(16 * lane)) & np.uint64(0xFFFF)
    return counts


def fingerprints(texts: Iterable[str | None], shingle: int) -> np.ndarray:
    """The fingerprints of texts, as int64 with the same 64 bits."""
    texts = list(texts)
    counts, totals = np.zeros((len(texts), 64), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    hashes: list[int] = []
    starts: list[int] = []
    owners: list[int] = []
    digest = xxhash.xxh64_intdigest

    def flush() -> None:
        if hashes:
            np.add.at(counts, owners, _bit_counts(np.array(hashes, dtype=np.uint64), np.array(starts)))
        hashes.clear(), starts.clear(), owners.clear()

    for i, text in enumerate(texts):
        # bytes.lower() folds A-Z alone, and bytes.split() cuts at the six ASCII white-space characters
        tokens = (text or "").encode().lower().split()
        if not tokens:
            continue
        n = totals[i] = max(1, len(tokens) - shingle + 1)
        for at in range(0, n, PIECE):
            part = tokens[at : at + PIECE + shingle - 1]
            starts.append(len(hashes))
            owners.append(i)
            if len(part) <= shingle:
                hashes.append(digest(b" ".join(part), SEED))
            else:
                hashes += [digest(b" ".join(s), SEED) for s in zip(*(part[k:] for k in range(shingle)), strict=False)]
            if len(hashes) >= HELD:
                flush()
    flush()
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints(batch, shingle))

    return of(text)


def _flips(width: int, radius: int) -> list[int]:
    """The XOR masks of a Hamming ball."""
    return [sum(1 << b for b in which) for r in range(radius + 1) for which in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) by segment; segments whose radius would be below zero need no probe."""
    edges = [round(64 * i / segments) for i in range(segments + 1)]
    small = distance // segments
    spare = distance - segments * small
    return [(a, b - a, small if i <= spare else small - 1) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _segment(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, distance: int, segments: int = 2, bucket_cap: int = 2048) -> DataFrame:
    """Pairs (a, b) of ids, a != b, that join all groups. prints: distinct (fp, id); pairs may repeat."""
    plan = segment_plan(distance, segments)
    key = lambda i, value: F.struct(F.lit(i).cast("byte").alias("seg"), value.alias("val"))
    rows = prints.select("fp", "id")
    table = rows.select("fp", "id", F.explode(F.array(*(key(i, _segment(F.col("fp"), s, w)) for i, (s, w, r) in enumerate(plan) if r >= 0))).alias("k")).select("fp", "id", "k.seg", "k.val")
    def ball(i: int, shift: int, width: int, radius: int) -> Column:
        return F.transform(F.array(*(F.lit(m) for m in _flips(width, radius))), lambda m: key(i, _segment(F.col("fp"), shift, width).bitwiseXOR(m)))

    balls = [ball(i, *segment) for i, segment in enumerate(plan) if segment[2] >= 0]
    probes = rows.select("fp", "id", F.explode(F.concat(*balls)).alias("k")).select(F.col("fp").alias("pfp"), F.col("id").alias("pid"), F.col("k.seg").alias("seg"), F.col("k.val").alias("val"))
    crowded = table.groupBy("seg", "val").count().where(F.col("count") > bucket_cap).select("seg", "val")
    any_crowded = not crowded.isEmpty()
    sparse = table.join(crowded, ["seg", "val"], "left_anti") if any_crowded else table
    near = F.bit_count(F.col("pfp").bitwiseXOR(F.col("fp"))) <= distance
    meets = (probes["seg"] == sparse["seg"]) & (probes["val"] == sparse["val"]) & (F.col("pfp") < F.col("fp")) & near
    found = probes.join(sparse, meets).select(F.col("pid").alias("a"), F.col("id").alias("b"))
    if not any_crowded:
        return found
    crowded = kept(crowded)
    inside = table.join(crowded, ["seg", "val"], "left_semi").select("fp", "id")
    reaching = probes.join(crowded, ["seg", "val"], "left_semi").select(F.col("pfp").alias("fp"), F.col("pid").alias("id"))
    return found.unionByName(_by_midpoints(kept(inside.unionByName(reaching).distinct()), distance))


def _by_midpoints(rows: DataFrame, distance: int) -> DataFrame:
    """Links that join all of rows within the distance; a midpoint has at most as many rows as a ball has values."""
    outer, inner = distance - distance // 2, distance // 2
    fp = F.col("fp")
    ball = lambda radius: F.transform(F.array(*(F.lit(_signed(m)) for m in _flips(64, radius))), lambda m: fp.bitwiseXOR(m))
    far = rows.select("id", F.explode(ball(outer)).alias("mid"))
    near = rows.select("id", F.explode(ball(inner)).alias("mid"))
    centres = near.groupBy("mid").agg(F.min("id").alias("b"))
    firsts = far.groupBy("mid").agg(F.min("id").alias("a"))
    star = far.join(centres, "mid").select(F.col("id").alias("a"), "b")
    other = near.join(firsts, "mid").select("a", F.col("id").alias("b"))
    return star.unionByName(other).where("a != b").distinct()


def roots(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for each id in a pair but the roots: the smallest id that links reach.

    Large-star and small-star rounds alternate until the edges no longer change. Each
    round is checkpointed; what reaches the driver is a count and a checksum.
    """
    edges = kept(pairs.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before = None
    for _ in range(max_rounds):
        mark = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))"), F.sum(F.expr("xxhash64(lo, hi) % 1000003"))).first())
        if mark == before or mark[0] == 0:
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min(F.least("hi", "lo")).alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") != F.col("m"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo"))
        edges = kept(small.where("hi != lo").distinct())
    raise RuntimeError("the star contraction did not settle")


def components(docs: DataFrame, shingle: int = 3, distance: int = 2, segments: int = 2, bucket_cap: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs."""
    prints = kept(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")))
    groups = kept(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id")))
    named = groups.join(roots(links(groups, distance, segments, bucket_cap)), "id", "left").select("fp", F.coalesce("root", "id").alias("component"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def op10(docs: DataFrame) -> DataFrame:
    return components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
