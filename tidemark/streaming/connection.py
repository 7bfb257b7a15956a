"""The live operator: one stateful processor for everything that a connection keeps.

A session's state are five variables: the count and index of its frames, the frame before,
two smoothed vectors, and what they said last. A timer in event time clears them. State lies
in RocksDB, so that it isn't bounded by memory, and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..operators import answers as A

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VECTOR = ArrayType(DoubleType())


def rocksdb(spark: SparkSession) -> None:
    """State variables and timers need this provider; running queries keep theirs."""
    spark.conf.set(PROVIDER, ROCKSDB)


class Connection(StatefulProcessor):
    """Gives each frame its number, the frame before it and the smoothed vectors; late
    frames, with an index that has passed, are left out."""

    def __init__(self, pixels: str, alpha: float, idle: int, names: list[str]):
        self.pixels, self.alpha, self.idle, self.names = pixels, alpha, idle, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, last bigint")
        self.frame = handle.getValueState("frame", "pixels array<double>")
        self.smooth = {c: handle.getValueState(c, "p array<double>") for c in ("region_probs", "score_probs")}
        self.cached = handle.getValueState("cached", "region int, score int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() or (0, -1)
        before = list(self.frame.get()[0]) if self.frame.exists() else None
        smooth = {c: np.array(s.get()[0], float) if s.exists() else None for c, s in self.smooth.items()}
        # a micro-batch of one session
        batch = pd.concat(list(rows)).sort_values(["frame_index", "event_time"], kind="stable").drop_duplicates("frame_index")
        batch = batch[batch["frame_index"] > last]
        if not len(batch):
            return
        out = {c: [] for c in ("previous", "n", "region_smoothed", "score_smoothed")}
        for _, row in batch.iterrows():
            for c, s in smooth.items():
                if row[c] is not None:
                    p = np.asarray(row[c], float)
                    smooth[c] = p if s is None else self.alpha * p + (1 - self.alpha) * s
                out[c.replace("probs", "smoothed")].append(None if smooth[c] is None else smooth[c].tolist())
            out["previous"].append(before)
            out["n"].append(n)
            before, n = [float(x) for x in row[self.pixels]], n + 1
        self.seen.update((n, int(batch["frame_index"].iloc[-1])))
        self.frame.update((before,))
        for c, s in smooth.items():
            if s is not None:
                self.smooth[c].update((s.tolist(),))
        if all(s is not None for s in smooth.values()):
            self.cached.update(tuple(int(np.argmax(s)) for s in smooth.values()))
        # one timer: idle after the newest frame
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = int(batch["event_time"].max().timestamp() * 1000)
        self.handle.registerTimer(max(newest, timerValues.getCurrentWatermarkInMs()) + self.idle)
        yield batch.assign(**out)[self.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.seen, self.frame, self.cached, *self.smooth.values()):
            state.clear()
        yield pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def with_session_state(frames: DataFrame, pixels: str = "pixels", alpha: float = A.ALPHA, idle: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """answers.with_session_state on a stream; ``idle`` in milliseconds."""
    rocksdb(frames.sparkSession)
    new = [StructField("n", LongType()), StructField("previous", VECTOR), StructField("region_smoothed", VECTOR), StructField("score_smoothed", VECTOR)]
    out = StructType([*frames.schema.fields, *new])
    return (
        frames.withWatermark("event_time", late)
        .groupBy("session_id")
        .transformWithStateInPandas(Connection(pixels, alpha, idle, out.names), out, "Append", "EventTime")
    )


def answered(frames: DataFrame, pixels: str = "pixels", model: str | None = None, alpha: float = A.ALPHA, **named: str) -> DataFrame:
    """What a live connection answers for each frame of a stream (session_id, frame_index,
    event_time, pixels): number, smoothed or ruled score, motion against the frame before, region."""
    return A.answers(with_session_state(A.with_probabilities(frames, model, pixels), pixels, alpha), pixels, **named)
