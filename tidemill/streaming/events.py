"""Structured Streaming over event logs: counters, windows, rate limits, breaker and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over Parquet files of events; ts as a timestamp, for watermarks. A glob may name a file or a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def running_summary(events: DataFrame) -> DataFrame:
    """Counters by event type: rows, mean and sum of value, errors."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.sum("value").alias("sum_value"))


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("sum_value"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "sum_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"])


def rate_limited(events: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """(user_id, event_id, allowed): a fixed window per user that starts at the user's first request after the last ended."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, count = state.get if state.exists else (float("-inf"), 0)
        out = []
        for r in _ordered(batches).itertuples():
            t = r.ts.timestamp()
            if t - start >= seconds:
                start, count = t, 0
            count += 1
            out.append((key[0], r.event_id, count <= limit))
        state.update((start, count))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "start double, count long", "append", GroupStateTimeout.NoTimeout)


def circuit_breaker(events: DataFrame, failures: int = 3, cooldown: float = 30.0, failed: str = "error", retries: int = 0) -> DataFrame:
    """(user_id, event_id, status): ok, degraded (the call failed) or circuit_open (not tried during the cooldown).

    A failed call is tried again `retries` times, each try a failure. Only a success ends the
    count, so the first failure after a cooldown opens the circuit again.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run_length, until = state.get if state.exists else (0, float("-inf"))
        out = []
        for r in _ordered(batches).itertuples():
            t = r.ts.timestamp()
            if t < until:
                status = "circuit_open"
            elif r.event_type == failed:
                status, run_length = "degraded", run_length + 1 + retries
                if run_length >= failures:
                    until = t + cooldown
            else:
                status, run_length = "ok", 0
            out.append((key[0], r.event_id, status))
        state.update((run_length, until))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "status"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, status string", "run long, until double", "append", GroupStateTimeout.NoTimeout)


def ttl_counter(events: DataFrame, seconds: float, renew: bool) -> DataFrame:
    """(user_id, event_id, count): a counter that expires; renew: each call extends its life, else only the first sets it."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, end = state.get if state.exists else (0, float("-inf"))
        out = []
        for r in _ordered(batches).itertuples():
            t = r.ts.timestamp()
            if t >= end:
                count, end = 0, t + seconds
            elif renew:
                end = t + seconds
            count += 1
            out.append((key[0], r.event_id, count))
        state.update((count, end))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "count"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, count long", "count long, end double", "append", GroupStateTimeout.NoTimeout)


def linked_feedback(searches: DataFrame, feedback: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Stream-stream join of feedback (search_id, ts, kind) to searches (event_id, ts) within a time."""
    s = searches.withWatermark("ts", late).alias("s")
    f = feedback.withWatermark("ts", late).alias("f")
    near = F.expr(f"f.search_id = s.event_id and f.ts between s.ts and s.ts + interval {within}")
    return s.join(f, near).select("s.event_id", F.col("s.ts").alias("search_ts"), F.col("f.ts").alias("feedback_ts"), "f.kind")


def append_feedback(stream: DataFrame, path: str, checkpoint: str, kinds: tuple[str, ...] = ("click", "dismiss", "purchase")):
    """Appends feedback of known kinds to Parquet, each batch once; others go to a folder of rejects."""

    def put(df: DataFrame, epoch: int) -> None:
        for folder, rows in (("accepted", df.where(F.col("kind").isin(*kinds))), ("rejected", df.where(~F.col("kind").isin(*kinds) | F.col("kind").isNull()))):
            rows.write.mode("overwrite").parquet(f"{path}/{folder}/epoch={epoch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into Parquet in the shared folder and returns what was written.

    append: all batches' rows; other modes: of complete the last batch, of update all rows, where
    a later row of a key doesn't replace an earlier one.
    """
    spark = stream.sparkSession
    path = shared_folder(spark, name)

    def put(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/" + ("last" if mode == "complete" else f"epoch={epoch}"))

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{path}/rows/last" if mode == "complete" else f"{path}/rows/epoch=*")
