"""Streaming plans over the events table, run as batches of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as E
from .common import Registry, shared_folder, table

R = Registry()

_DEBOUNCE = """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, arg_max(event_type, ts) AS event_type FROM s GROUP BY user_id, burst"""


@R.add(_DEBOUNCE)
def debounced_events(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events, two hours of quiet apart, with the last event of each."""
    return E.debounce(table(spark, d, "events"), ["user_id"], "ts", "2 hours", carry=("event_type",))


@R.add(_DEBOUNCE)
def debounced_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream: every burst that the watermark closes is written by the stream itself, and the run ends with the input.

    The last burst of each user stays open as a stream, so the input ends with one event far later that closes them."""
    base = shared_folder(spark)
    source, out, state = (f"{base}/{p}-{uuid.uuid4().hex}" for p in ("events", "bursts", "state"))
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    e.write.mode("overwrite").parquet(f"{source}/a")
    end = e.agg(F.max("ts").alias("m")).select(F.lit(-1).cast("bigint").alias("event_id"), (F.col("m") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit(None).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(source)
    bursts = E.debounce(stream, ["user_id"], "ts", "2 hours", "40 days", carry=("event_type",))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    E.apply_events(bursts, keep, state).awaitTermination()
    far = end.withColumn("ts", F.col("ts") + F.expr("INTERVAL 60 DAYS"))
    far.write.mode("overwrite").parquet(f"{source}/b")
    E.apply_events(bursts, keep, state).awaitTermination()
    return spark.read.schema(bursts.schema).parquet(out).where("user_id IS NOT NULL").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ts", "last_ts")], "events", "event_type")
