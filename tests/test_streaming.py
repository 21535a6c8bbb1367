"""Streams drained over files give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from terravia.streaming import events as S
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in order of time, in a few files."""
    path = str(tmp_path_factory.mktemp("parts") / "e")
    spark.read.parquet(f"{SMALL}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def batch(spark, parts):
    return spark.read.parquet(parts).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_sessions(spark, parts, tmp_path):
    stream = drain(S.sessions(S.event_stream(spark, parts, 8)), "sess", "append", tmp_path)
    whole = sorted(S.sessions(batch(spark, parts)).collect())
    got = sorted(stream.collect())
    assert set(got) <= set(whole) and len(got) >= 0.9 * len(whole)


def test_first_seen(spark, parts, tmp_path):
    keys = ["event_id"]
    twice = S.event_stream(spark, parts, 8)
    got = drain(S.first_seen(twice.union(twice), keys), "firsts", "append", tmp_path)
    assert got.count() == batch(spark, parts).count()


def test_job_states(spark, parts, tmp_path):
    got = drain(S.job_states(S.event_stream(spark, parts, 1), ttl_ms=90 * 86_400_000, late="60 days"), "jobs", "update", tmp_path)
    last = {}
    for r in got.collect():
        if r.updates >= last.get(r.jid, ("", -1))[1]:
            last[r.jid] = (r.state, r.updates)
    newest = {}
    for r in batch(spark, parts).collect():
        k = (r.ts, r.event_id)
        n = newest.get(r.user_id, ((None, None), 0))[1] if r.user_id in newest else 0
        if r.user_id not in newest or k > newest[r.user_id][0]:
            newest[r.user_id] = (k, n + 1, S.STATES[r.event_type])
        else:
            newest[r.user_id] = (newest[r.user_id][0], n + 1, newest[r.user_id][2])
    assert last == {u: (s, n) for u, (_, n, s) in newest.items()}


def test_accumulate_is_idempotent(spark, parts, tmp_path):
    out = str(tmp_path / "table")
    keyed = lambda: S.event_stream(spark, parts, 1).select(F.concat_ws("|", "user_id", "event_type").alias("key"), "user_id")
    for run in ("one", "two"):
        S.accumulate(keyed(), out, str(tmp_path / run)).awaitTermination()
        rows = spark.read.parquet(out)
        assert rows.count() == rows.select("key").distinct().count() == batch(spark, parts).select("user_id", "event_type").distinct().count()
