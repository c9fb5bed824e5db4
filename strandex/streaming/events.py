"""Streams of file events: debouncing, applying them in batches, and keyed job state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("project_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("old_path", T.StringType()), T.StructField("ts", T.TimestampType())])


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def debounce(events: DataFrame, keys: list[str], ts: str, quiet: str = "1 second", late: str | None = "10 seconds", carry: tuple[str, ...] = ("kind", "old_path")) -> DataFrame:
    """The last event of each burst of a key, released after a quiet time: (keys, first_ts, last_ts, events, carried columns).

    A burst is a session window; as a stream it is bounded by a watermark, and events later than that are left to the next reconciliation.
    The state holds one row a burst, not its events."""
    e = events.withWatermark(ts, late) if events.isStreaming and late else events
    last = F.max_by(F.struct(*carry), F.col(ts)).alias("_l") if carry else F.lit(None).alias("_l")
    got = e.groupBy(*keys, F.session_window(F.col(ts), quiet).alias("_w")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("events"), last, F.max((F.col("kind") == "rename").cast("int")).alias("_r") if "kind" in events.columns else F.lit(0).alias("_r"))
    out = got.select(*keys, "first_ts", "last_ts", "events", *[F.col(f"_l.{c}").alias(c) for c in carry], "_r")
    if "kind" in carry:
        # a rename that a later event of the burst hides cannot be followed: its folder is listed again
        out = out.withColumn("reconcile", (F.col("_r") == 1) & (F.col("kind") != "rename"))
    return out.drop("_r")


def apply_events(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Runs ``apply`` on each batch of debounced events. A batch that is repeated after a failure has the same number, by which ``apply`` can
    tell that it has been committed."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def newer_only(events: DataFrame, documents: DataFrame, key: str, epoch: str) -> DataFrame:
    """Events whose epoch is not older than the document's."""
    have = documents.select(key, F.col("observation_epoch").alias("_have"))
    return events.join(have, key, "left").where(F.col("_have").isNull() | (F.col(epoch) >= F.col("_have"))).drop("_have")


JOB = T.StructType([T.StructField("document_id", T.LongType()), T.StructField("state", T.StringType()), T.StructField("attempt", T.LongType()), T.StructField("epoch", T.LongType()), T.StructField("last_ts", T.TimestampType())])
_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("attempt", T.LongType()), T.StructField("epoch", T.LongType())])


def step(state: str | None, attempt: int, epoch: int, kind: str) -> tuple[str, int, int]:
    """A document's job after one event: observed files are queued with a higher epoch, a failure is tried again five times."""
    if kind in ("created", "changed", "renamed"):
        return ("queued" if state != "running" else "running"), 0, epoch + 1
    if kind == "deleted":
        return "deleted", 0, epoch + 1
    if kind == "lease" and state in ("queued", "retry_wait"):
        return "running", attempt + 1, epoch
    if kind == "failed" and state == "running":
        return ("retry_wait" if attempt <= 5 else "failed"), attempt, epoch
    if kind == "completed" and state == "running":
        return "completed", attempt, epoch
    return state or "unknown", attempt, epoch


def job_states(events: DataFrame) -> DataFrame:
    """(document_id, state, attempt, epoch, last_ts) after each batch, from a stream of (document_id, kind, ts, seq): keyed state of three values."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, attempt, epoch = held.get if held.exists else (None, 0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "seq"])
        for kind in rows["kind"]:
            state, attempt, epoch = step(state, int(attempt), int(epoch), kind)
        held.update((state, attempt, epoch))
        yield pd.DataFrame({"document_id": [key[0]], "state": [state], "attempt": [attempt], "epoch": [epoch], "last_ts": [rows["ts"].max()]})

    return events.groupBy("document_id").applyInPandasWithState(run, JOB, _STATE, "update", GroupStateTimeout.NoTimeout)
