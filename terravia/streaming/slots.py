"""First come, first served over a bounded number of slots, as a stream and as its batch twin.

Events (pool, jid, kind, at): a job is `submit`ted, and starts at once if one of its pool's slots is free, else when
its turn comes; `done` or `error` gives a slot back. Events of one time go by kind (slots are given back first), then job.

The stream keeps what has arrived until the watermark has passed it, in a list, and takes events in the order of their own times, so events
that are late within the watermark change nothing. Each pool's waiting jobs are a list in its state, its free slots a value; finished jobs are kept
for their time to live and then forgotten, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("done", "error")
STARTED = "pool long, jid long, state string, at long"


def started(events: DataFrame, slots: int) -> DataFrame:
    """pool, jid, at: when each submitted job starts; jobs that never get a slot have no row. events: pool, jid, kind, at.

    Without a walk: the k-th job of a pool starts when it is there and all but `slots` of the k that are before it or itself have given their slots back,
    which is at the (k - slots)-th end; both are counted along their own order.
    """
    order = Window.partitionBy("pool").orderBy("at", "jid")
    came = events.where("kind = 'submit'").select("pool", "jid", "at", (F.row_number().over(order) - slots).alias("nth"))
    ends = events.where(F.col("kind").isin(*FINISHED)).select("pool", F.col("at").alias("free"), F.row_number().over(order).alias("nth"))
    met = came.join(ends, ["pool", "nth"], "left")
    return met.where("nth <= 0 OR free IS NOT NULL").select("pool", "jid", F.greatest("at", F.coalesce("free", "at")).alias("at"))


def _rows(rows: list[tuple[int, int, str, int]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["pool", "jid", "state", "at"]).astype({"pool": "int64", "jid": "int64", "state": "object", "at": "int64"})


class Slots(StatefulProcessor):
    """Rows: pool, jid, state (running, done, error, forgotten), at (milliseconds)."""

    def __init__(self, slots: int, ttl_ms: int):
        self.slots, self.ttl_ms = slots, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrived = handle.getListState("arrived", "at long, rank int, jid long, kind string")
        self.waiting = handle.getListState("waiting", "jid long")
        self.finished = handle.getListState("finished", "jid long, until long")
        self.free = handle.getValueState("free", "n int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        times = set()
        for frame in rows:
            for jid, kind, at in zip(frame["jid"], frame["kind"], frame["ms"], strict=True):
                self.arrived.appendValue((int(at), int(kind == "submit"), int(jid), str(kind)))
                times.add(max(int(at), late + 1))
        for at in sorted(times):
            self.handle.registerTimer(at)
        yield _rows([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        held = sorted(tuple(e) for e in self.arrived.get())
        due, rest = [e for e in held if e[0] <= now], [e for e in held if e[0] > now]
        waiting = [w[0] for w in self.waiting.get()]
        finished = [tuple(f) for f in self.finished.get()]
        free = self.free.get()[0] if self.free.exists() else self.slots
        for at, _, jid, kind in due:
            if kind == "submit":
                waiting.append(jid)
            elif kind in FINISHED:
                out.append((key[0], jid, kind, at))
                finished.append((jid, at + self.ttl_ms))
                self.handle.registerTimer(max(at + self.ttl_ms, now + 1))
                free += 1
            while free > 0 and waiting:
                out.append((key[0], waiting.pop(0), "running", at))
                free -= 1
        out += [(key[0], jid, "forgotten", until) for jid, until in finished if until <= now]
        finished = [f for f in finished if f[1] > now]
        for state, values in ((self.arrived, rest), (self.waiting, [(w,) for w in waiting]), (self.finished, finished)):
            if values:
                state.put(values)
            elif state.exists():
                state.clear()
        self.free.update((free,))
        yield _rows(out)

    def close(self) -> None:
        pass


def states(events: DataFrame, slots: int, ttl_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """pool, jid, state, at of a stream of events (pool, jid, kind, ts). The session's state store must be RocksDB's."""
    rows = events.withWatermark("ts", late).select(F.col("pool").cast("long").alias("pool"), F.col("jid").cast("long").alias("jid"), "kind", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("pool").transformWithStateInPandas(Slots(slots, ttl_ms), STARTED, "append", "EventTime")
