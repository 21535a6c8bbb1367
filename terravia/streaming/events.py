"""Structured Streaming forms of the lifecycle operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = {"signup": "queued", "click": "running", "view": "running", "purchase": "done", "error": "error"}


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive; ts becomes a timestamp for the watermark."""
    schema = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: bursts of events with pauses shorter than the gap."""
    windows = F.session_window("ts", gap)
    found = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy("user_id", windows.alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    found = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key that arrives while the watermark still remembers it."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def job_states(events: DataFrame, ttl_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """jid, state, updates: each job's state after every batch that touches it; jobs at rest for the time to live, by the events' own clock, are dropped.

    The newest event decides, so events that arrive out of order do no harm.
    """
    rows = events.withWatermark("ts", late).select(F.col("user_id").alias("jid"), "ts", F.unix_millis("ts").alias("at"), "event_id", "event_type")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, eid, name, n = state.get if state.exists else (-1, -1, "queued", 0)
        for batch in batches:
            n += len(batch)
            last = batch.sort_values(["at", "event_id"]).iloc[-1]
            if (int(last["at"]), int(last["event_id"])) > (at, eid):
                at, eid, name = int(last["at"]), int(last["event_id"]), STATES[last["event_type"]]
        state.update((at, eid, name, n))
        state.setTimeoutTimestamp(max(at + ttl_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"jid": [key[0]], "state": [name], "updates": [n]})

    return rows.groupBy("jid").applyInPandasWithState(step, "jid long, state string, updates long", "at long, eid long, name string, n long", "update", GroupStateTimeout.EventTimeTimeout)


#: Parts of an accumulated table, by a hash of the key.
PARTS = 256


def accumulate(stream: DataFrame, path: str, checkpoint: str):
    """Append to a table what a stream brings that the table does not hold, by content key; runs until the stream is drained.

    The table lies in PARTS folders by a hash of the key (column part), and a batch looks
    only into those that its own keys fall in.
    """

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["key"]).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).persist()
        parts = [r["part"] for r in fresh.select("part").distinct().collect()]  # at most PARTS numbers
        if parts and _exists(spark, path):
            known = spark.read.schema(fresh.schema).option("ignoreMissingFiles", True).parquet(path).where(F.col("part").isin(parts)).select("part", "key")
            new = fresh.join(known, ["part", "key"], "left_anti")
        else:
            new = fresh
        new.write.mode("append").partitionBy("part").parquet(path)
        fresh.unpersist()

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
