"""Groups of near copies: a similarity of 0.8 or more over five-word shingles, verified exactly.

Two texts are linked if the Jaccard similarity of their sets of word shingles reaches
`SIMILARITY`; a group is a connected component of links. Candidates come from two indexes:

* SimHash fingerprints within `DISTANCE` bits, by multi-index hashing (simhash.links);
* bands of minima. A pair at 0.8 is commonly 7 to 14 of 64 fingerprint bits apart, and
  Hamming balls of that radius cannot be enumerated, so each text also has BANDS * ROWS
  minima of its shingles' hashes; texts that share a whole band are candidates. A pair at
  exactly 0.8 shares none with a probability of (1 - 0.8 ** ROWS) ** BANDS, 1.3e-7; a more
  similar pair with a far smaller one.

Texts with the same set of shingles are one node from the start, so a group of copies
costs one row. In each bucket first all members are compared with one of them, another
one in every band. Buckets whose members then lie in one component need no more; in the
others the pairs of members from different components are compared, so no candidate pair
is left out and no group is expanded into all its pairs. Pairs whose sizes alone keep them
under 0.8 are not looked at, and within the join that meets the members of different components
most pairs under 0.8 are ruled out by bitmaps of parities: two such bitmaps differ in at
most as many bits as the sets differ in members, and at 0.8 sets differ in at most a
ninth of their joint sizes. Both bounds are exact; what they cannot rule out is verified.

Defined cases: words are cut and lower-cased as for SimHash. A text of fewer words than a
shingle is one shingle; texts without words are copies of each other. Rows with a null
doc_id take no part. Rows that share a doc_id are judged by their own texts. Of a group the
row with the smallest doc_id stays, of several such the one with the smallest hash of its
text, and of rows that repeat both the first by their other columns. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terravia.llm import simhash
from terravia.llm.common import kept, unused

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 5
DISTANCE = 3
#: Bits of a set's bitmap of parities. Sets of over nine times as many members are never ruled out by it.
PARITY_BITS = 1024
#: Hashes whose minima are taken at a time.
HELD = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def _odd(n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    tokens = (text or "").encode().lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens))] if tokens else [], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = len(tokens) - words + 1
    joint = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(_odd(words)):
        joint += hashed[k : k + n] * factor
    return np.unique(_mixed(joint))


def band_values(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A value for each set (of one hash at least) and band."""
    minima = np.full((bands * rows, len(sets)), ~np.uint64(0))
    factors = _odd(bands * rows)
    pieces = [(i, s[a : a + HELD]) for i, s in enumerate(sets) for a in range(0, len(s), HELD)]
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= HELD):
            size += len(pieces[end][1])
            end += 1
        owners = np.array([i for i, _ in pieces[at:end]])
        starts = np.cumsum([0, *(len(p) for _, p in pieces[at : end - 1])])
        hashes = np.concatenate([p for _, p in pieces[at:end]])
        for k, factor in enumerate(factors):
            np.minimum.at(minima[k], owners, np.minimum.reduceat(hashes * factor, starts))
        at = end
    joint = np.zeros((bands, len(sets)), dtype=np.uint64)
    for r in range(rows):
        joint = _mixed(joint + minima[r::rows])
    return _mixed(joint + np.arange(bands, dtype=np.uint64)[:, None]).T


def parities(hashes: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """A bitmap as int64: each member of a set flips one of its bits."""
    flips = np.bincount((_mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8), bitorder="little").view(np.int64)


def differing(one: Column, two: Column, bits: int = PARITY_BITS) -> Column:
    """How many bits two bitmaps differ in."""
    return sum((F.bit_count(one[i].bitwiseXOR(two[i])) for i in range(1, bits // 64)), F.bit_count(one[0].bitwiseXOR(two[0])))


def sketch(text: Column) -> Column:
    """struct<key, bands, size, parity>: equal keys for equal sets of shingles; no bands for an empty set."""

    @F.pandas_udf("key binary, bands array<bigint>, size int, parity array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch]
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(sets)
            if some:
                for i, values in zip(some, band_values([sets[i] for i in some]).view(np.int64), strict=True):
                    bands[i] = values
            yield pd.DataFrame({"key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "bands": bands, "size": [len(s) for s in sets], "parity": [parities(s) for s in sets]})

    return of(text)


def shingles(text: Column) -> Column:
    @F.pandas_udf("array<bigint>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in batch])

    return of(text)


def verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts reach the similarity. rows: row, doc_id, copy; one of equal rows of docs is enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(rows.select("row", "doc_id", "copy"), "row")
    texts = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").join(ids, ["doc_id", "copy"])
    texts = texts.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "copy").orderBy("row"))).where("nth = 1")
    sets = kept(texts.select("row", shingles(F.col("text")).alias("s")))
    one, two = sets.select(F.col("row").alias("a"), F.col("s").alias("sa")), sets.select(F.col("row").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b").distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) for nodes within DISTANCE bits: a node and the first with its fingerprint, and the first ones with each other."""
    groups = kept(nodes.groupBy("fp").agg(F.min("id").alias("id")))
    same = nodes.join(groups.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    return same.unionByName(simhash.links(groups, DISTANCE))


def similar_sizes(one: Column, two: Column) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return F.least(one, two) >= SIMILARITY * F.greatest(one, two)


def _rooted(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text), root (a number for the group) for each row of docs with a doc_id."""
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    marks = docs.select("doc_id", F.xxhash64("text").alias("copy"), simhash.fingerprint(F.col("text"), WORDS).alias("fp"), sketch(F.col("text")).alias("s"))
    rows = kept(marks.select(F.monotonically_increasing_id().alias("row"), "doc_id", "copy", "fp", "s.*"))
    # a node is the first row of each set of shingles
    firsts = kept(rows.groupBy("key").agg(F.min("row").alias("id")))
    nodes = kept(rows.join(firsts.select("key", F.col("id").alias("row")), ["key", "row"], "left_semi").select(F.col("row").alias("id"), "fp", "bands", "size", "parity"))

    filed = nodes.select("id", "size", F.explode("bands").alias("bucket"))
    lead = F.min(F.struct(F.xxhash64("bucket", "id").alias("h"), "id", "size"))
    centres = filed.groupBy("bucket").agg(F.count("*").alias("n"), lead.alias("c")).where("n > 1").select("bucket", F.col("c.id").alias("centre"), F.col("c.size").alias("centre_size"))
    shared = kept(filed.join(centres, "bucket"))
    to_centre = shared.where(similar_sizes(F.col("size"), F.col("centre_size"))).select(F.col("id").alias("a"), F.col("centre").alias("b"))
    near = to_centre.unionByName(_fingerprint_pairs(nodes.select("id", "fp")))
    pairs = lambda p: kept(p.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    tried = pairs(near)
    links = kept(verified(docs, rows, tried))

    found = shared.join(simhash.roots(links).withColumnRenamed("root", "c"), "id", "left").select("bucket", "id", F.coalesce("c", "id").alias("c"))
    mixed = found.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("bucket")
    apart = kept(found.join(mixed, "bucket", "left_semi").join(nodes.select("id", "size", "parity"), "id"))
    other = apart.select("bucket", *(F.col(c).alias(f"{c}_2") for c in ("id", "c", "size", "parity")))
    most = (F.col("size") + F.col("size_2")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    unlike = (F.col("id") > F.col("id_2")) & (F.col("c") != F.col("c_2")) & similar_sizes(F.col("size"), F.col("size_2")) & (differing(F.col("parity"), F.col("parity_2")) <= most)
    crossing = apart.join(other, (apart["bucket"] == other["bucket"]) & unlike).select(F.col("id").alias("a"), F.col("id_2").alias("b"))
    more = verified(docs, rows, pairs(crossing).join(tried, ["a", "b"], "left_anti"))

    named = kept(simhash.roots(links.unionByName(more)))
    placed = rows.select("doc_id", "copy", "key").join(firsts, "key").join(named, "id", "left")
    return placed.select("doc_id", "copy", F.coalesce("root", "id").alias("root"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs with a doc_id."""
    rooted = kept(_rooted(docs))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")


def stage(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies. Rows with a null doc_id all stay."""
    d, k, nth = unused(docs, "d", "k", "nth")
    first = _rooted(docs).groupBy("root").agg(F.min(F.struct("doc_id", "copy")).alias("m")).select(F.col("m.doc_id").alias(d), F.col("m.copy").alias(k))
    stay = docs.join(first, (docs["doc_id"] == F.col(d)) & (F.xxhash64(docs["text"]) == F.col(k)))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    once = stay.withColumn(nth, F.row_number().over(Window.partitionBy(d, k).orderBy(order))).where(F.col(nth) == 1)
    return once.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
