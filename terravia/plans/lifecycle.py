"""Batch twins of the streaming operators."""

from pyspark.sql import functions as F

from terravia import fixtures as fx
from terravia.catalog import register
from terravia.streaming import events as S


def _events(spark, d):
    return fx.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register(
    "sessions_30min",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, CAST(epoch_us(min(ts)) // 1000 AS BIGINT) AS start_ms, CAST(epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS BIGINT) AS end_ms, count(*) AS n FROM s GROUP BY user_id, k""",
)
def sessions_30min(spark, d):
    ms = lambda c: F.unix_millis(c)
    return S.sessions(_events(spark, d)).select("user_id", ms("start").alias("start_ms"), ms("end").alias("end_ms"), "n")


@register("tumbling_hours", "SELECT CAST(epoch_us(date_trunc('hour', ts)) // 1000 AS BIGINT) AS start_ms, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_hours(spark, d):
    return S.tumbling(_events(spark, d)).select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


@register("dedup_stream", "SELECT DISTINCT user_id, event_type, props FROM events")
def dedup_stream(spark, d):
    keys = ["user_id", "event_type", "props"]
    return S.first_seen(_events(spark, d), keys).select(*keys)
