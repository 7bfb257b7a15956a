"""Live sessions: the batch rules on streams of frames.

A stream has the columns of schemas.LIVE_FRAME. Order within a session is that of
frame_index; what comes in with an index already passed is late, and dropped by
the stateful operator. Event time bounds the other operators' state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..schemas import LIVE_FRAME
from .connection import answered as analysed  # noqa: F401

LATE = "10 minutes"


def source(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    """Frames that land as files; ``files`` a trigger is the backpressure."""
    return spark.readStream.schema(LIVE_FRAME).option("maxFilesPerTrigger", files).parquet(path)


def first_per_bucket(frames: DataFrame, width: float = 0.5, idle: str = "30 minutes") -> DataFrame:
    """The frame with the least index of each bucket of video time. On a stream, that of
    the batch in which the bucket comes first; buckets come in order, and frames of one that
    has passed are late. Sessions idle in event time are forgotten."""
    marked = frames.withColumn("bucket", S.bucket(F.col("video_time"), width))
    if not frames.isStreaming:
        first = marked.groupBy("session_id", "bucket").agg(F.min_by(F.struct(*marked.columns), "frame_index").alias("first"))
        return first.select("first.*")
    names = marked.columns

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable").drop_duplicates("bucket")
        fresh = rows if last is None else rows[rows["bucket"] > last]
        if len(fresh):
            last = int(fresh["bucket"].max())
            state.update((last,))
        state.setTimeoutTimestamp(max(int(rows["event_time"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + _milliseconds(idle))
        yield fresh[names]

    own = marked.withWatermark("event_time", LATE)
    return own.groupBy("session_id").applyInPandasWithState(step, marked.schema, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def running_stats(frames: DataFrame) -> DataFrame:
    """Least, greatest and mean score so far, and by region, for update mode."""
    return frames.groupBy("session_id", F.coalesce("region", F.lit("stomach")).alias("region")).agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("frames")
    )


def closed_sessions(frames: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """A session's final numbers, once no frame came for ``gap``; for append mode."""
    own = frames.withWatermark("event_time", LATE) if frames.isStreaming else frames
    return (
        own.groupBy("session_id", F.session_window("event_time", gap).alias("window"))
        .agg(
            F.min("score").alias("overall_score"),
            F.max("score").alias("max_score"),
            F.avg("score").alias("avg_score"),
            F.count(F.lit(1)).alias("frames_analyzed"),
            F.max("video_time").alias("duration"),
        )
        .select("session_id", F.col("window.end").alias("closed_at"), "overall_score", "max_score", S.rounded(F.col("avg_score"), 2).alias("avg_score"), "frames_analyzed", "duration")
    )


SMOOTHED = "session_id string, frame_index bigint, n bigint, class int, confidence double, is_first boolean"
STATE = "n bigint, last bigint, s array<double>"


def smoothed(frames: DataFrame, alpha: float = 0.3, idle: str = "30 minutes") -> DataFrame:
    """Exponential averages of ``probs`` with state for each session: a count, the
    last index and the averages. Sessions that are idle in event time are forgotten."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, s = state.get if state.exists else (0, -1, None)
        rows = pd.concat(list(batches)).sort_values("frame_index", kind="stable")
        out = []
        for index, probs in zip(rows["frame_index"], rows["probs"], strict=True):
            if index <= last:
                continue
            probs = [float(p) for p in probs]
            s = probs if s is None else [alpha * p + (1 - alpha) * q for p, q in zip(probs, s, strict=True)]
            top = max(range(len(s)), key=s.__getitem__)
            out.append((key[0], index, n, top, s[top], n == 0))
            n, last = n + 1, int(index)
        state.update((n, last, list(s) if s is not None else None))
        newest = int(rows["event_time"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + _milliseconds(idle))
        yield pd.DataFrame(out, columns=["session_id", "frame_index", "n", "class", "confidence", "is_first"])

    own = frames.withWatermark("event_time", LATE)
    return own.groupBy("session_id").applyInPandasWithState(step, SMOOTHED, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]


def replayed(frames: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream in append mode over all that is there, into Parquet; the sink's log
    keeps each batch's files once, also when a batch is repeated after a failure."""
    query = frames.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def collected(frames: DataFrame, name: str, mode: str = "complete") -> None:
    """Run a stream over all that is there, into a table in memory: for small results."""
    query = frames.writeStream.outputMode(mode).format("memory").queryName(name)
    query.trigger(availableNow=True).start().awaitTermination()


def polled(frames: DataFrame, out: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Start a stream that looks for what is new at each interval; the caller stops it."""
    query = frames.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.trigger(processingTime=every).start()
