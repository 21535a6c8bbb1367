"""Best-fit packing into bins of several permitted lengths.

Pieces (whole documents, or cuts of the longest permitted length where a document is
longer; nothing is dropped) are dealt into shards by a hash of their key, sorted by
falling length inside each shard, and packed: a piece goes into the open bin with the
least room that still holds it. Where no bin does, a bin is opened in the permitted
length that costs least for the tokens it can expect: cost(c) = FIXED + c + c*c/QUADRATIC,
a sequence's overhead, its linear work and its attention, over the piece and as much of
the rest as the shorter pieces still to come can fill. At the end every bin is cut down
to the shortest permitted length that holds its contents.

A shard holds about ROWS_A_SHARD documents whatever the size of the table, so tasks stay
equal; only keys and lengths are shuffled, no text. Open bins are kept by their room,
of which there are no more values than the longest length has tokens.

Defined cases: a null or empty text has length `extra` (its end mark). A key that
repeats, or is null, makes pieces of its own; hashing the length as well spreads such
rows no further than their lengths differ, so a shard is packed in runs of at most MOST_HELD pieces, each into
bins of its own, and no more is held however many rows are alike. Keys are of any type. Ties: equal lengths are packed by key, then
piece. Empty tables give no bins.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravia.llm.common import WORD

LENGTHS = (512, 1024, 2048, 4096, 8192)
FIXED, QUADRATIC = 256, 16384
ROWS_A_SHARD = 16384
#: Pieces of a shard that are packed together at most; a shard of unlike rows has fewer.
MOST_HELD = 1 << 18


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / QUADRATIC


class Packer:
    """Best fit over pieces that come by falling length."""

    def __init__(self, capacities: Sequence[int], lengths: np.ndarray):
        self.capacities = sorted(capacities)
        values = np.arange(self.capacities[-1] + 1)
        #: Tokens in pieces of up to each length; those of the present length that are placed are in `done`.
        self.mass = np.cumsum(np.bincount(lengths, minlength=len(values)) * values)
        self.length, self.done = -1, 0
        self.rooms: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.used: list[int] = []
        self.opened: list[int] = []

    def _cheapest(self, n: int) -> int:
        """The permitted length with the least cost for a token that a new bin for n tokens can expect."""

        def price(c: int) -> float:
            room = c - n
            to_come = self.mass[room] if room < n else self.mass[n] - self.done - n
            return cost(c) / (n + min(room, int(to_come)))

        return min((c for c in self.capacities if c >= n), key=lambda c: (price(c), c))

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        if n != self.length:
            self.length, self.done = n, 0
        at = bisect_left(self.rooms, n)
        if at < len(self.rooms):
            room = self.rooms[at]
            bins = self.by_room[room]
            which = bins.pop()
            if not bins:
                del self.by_room[room], self.rooms[at]
        else:
            which, room = len(self.used), self._cheapest(n)
            self.used.append(0)
            self.opened.append(room)
        offset = self.used[which]
        self.used[which] += n
        self.done += n
        if room > n:
            if room - n not in self.by_room:
                insort(self.rooms, room - n)
                self.by_room[room - n] = []
            self.by_room[room - n].append(which)
        return which, offset

    def final(self) -> list[int]:
        """The capacity of each bin, cut down to its contents."""
        return [self.capacities[bisect_left(self.capacities, u)] for u in self.used]


def _pack_shard(shard: pd.DataFrame, capacities: Sequence[int], begun: int = 0) -> pd.DataFrame:
    """The pieces with their bins, numbered from `begun` on."""
    lengths = shard["length"].to_numpy()
    packer = Packer(capacities, lengths)
    placed = [packer.place(n) for n in lengths.tolist()]
    sizes = packer.final()
    bins = np.array([b for b, _ in placed], dtype=np.int64)
    return shard.assign(
        bin_id=(shard["shard"].to_numpy().astype(np.int64) << 32) | (bins + begun),
        bin_offset=np.array([o for _, o in placed], dtype=np.int64),
        capacity=np.array(sizes, dtype=np.int64)[bins],
    ).drop(columns="shard")


def pack(lengths: DataFrame, key: str = "doc_id", length: str = "length", capacities: Sequence[int] = LENGTHS, shards: int | None = None) -> DataFrame:
    """key, piece, length, bin_id, bin_offset, capacity for every piece. lengths: key, length (1 at least)."""
    most = max(capacities)
    rows = lengths.select(F.col(key), F.greatest(F.lit(1), F.col(length)).cast("long").alias("length"))
    if shards is None:
        shards = max(1, -(-lengths.count() // ROWS_A_SHARD))
    cut = rows.select(key, "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {most}"))).alias("piece"))
    cut = cut.select(key, "piece", F.least(F.lit(most).cast("long"), F.col("length") - F.col("piece") * most).alias("length"))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64(key, "piece", "length"), F.lit(shards)))
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), key, "piece")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = begun = 0
        shard = None

        def packed() -> pd.DataFrame:
            nonlocal held, size, begun
            done = _pack_shard(pd.concat(held, ignore_index=True), capacities, begun)
            begun = int((done["bin_id"] & 0xFFFFFFFF).max()) + 1
            held, size = [], 0
            return done

        for frame in frames:
            for number, part in frame.groupby("shard", sort=False):
                if number != shard:
                    if held:
                        yield packed()
                    shard, begun = number, 0
                while len(part):
                    fits = part.iloc[: MOST_HELD - size]
                    held.append(fits)
                    size += len(fits)
                    part = part.iloc[len(fits) :]
                    if size >= MOST_HELD:
                        yield packed()
        if held:
            yield packed()

    # keys travel as text: beside nulls, numbers would become floating
    kind = rows.schema[key].dataType
    told = ordered.withColumn(key, F.col(key).cast("string")).mapInPandas(run, f"`{key}` string, piece long, length long, bin_id long, bin_offset long, capacity long")
    return told.withColumn(key, F.col(key).cast(kind))


def n_tokens(text: Column, extra: int = 1) -> Column:
    """Words of the text, and its end mark."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long") + extra


def op9(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", n_tokens(F.col("text")).alias("length"))).withColumnRenamed("length", "n_tokens")


def stage(docs: DataFrame) -> DataFrame:
    return op9(docs)
