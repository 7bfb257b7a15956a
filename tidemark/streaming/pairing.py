"""Results of frames paired with the times at which the frames were taken.

Results come as JSON messages, capture times from the client; both tell a session and the frame's
number in it. What can't be read goes to a side output. The two streams meet in a full outer join
with watermarks: a half that stays alone comes out, marked, once the other can't come any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "session_id string, frame_index bigint, score int, direction string, region string"
LATE = "10 minutes"
#: How far apart in event time the halves of a frame may be.
APART = "1 minute"


def read_messages(messages: DataFrame, text: str = "message") -> tuple[DataFrame, DataFrame]:
    """(results, malformed) of messages (``text``, event_time). Malformed are texts that are no JSON
    object, or lack the session or a whole frame number; they are kept as they came."""
    own = messages.withColumn("_r", F.from_json(F.when(F.try_parse_json(text).isNotNull(), F.col(text)), RESULT))
    good = F.coalesce(F.col("_r.session_id").isNotNull() & (F.col("_r.frame_index") >= 0), F.lit(False))
    others = [c for c in messages.columns if c != text and c not in RESULT.replace(",", " ").split()]
    return own.where(good).select("_r.*", *others), own.where(~good).drop("_r")


def paired(results: DataFrame, captures: DataFrame, seconds_per_frame: float = 0.5, late: str = LATE, apart: str = APART) -> DataFrame:
    """Timeline rows of results (session_id, frame_index, event_time, ...) and captures (session_id,
    frame_index, event_time, capture_time). ``half`` tells what there was: both, result or capture. A
    result without a capture has its number's time. Of several captures of a frame each gives a row."""
    left = results.withWatermark("event_time", late) if results.isStreaming else results
    right = captures.select(F.col("session_id").alias("_s"), F.col("frame_index").alias("_i"), F.col("event_time").alias("_at"), "capture_time")
    right = right.withWatermark("_at", late) if captures.isStreaming else right
    near = (F.col("_at") >= F.col("event_time") - F.expr(f"INTERVAL {apart}")) & (F.col("_at") <= F.col("event_time") + F.expr(f"INTERVAL {apart}"))
    met = left.join(right, (F.col("session_id") == F.col("_s")) & (F.col("frame_index") == F.col("_i")) & near, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    others = [c for c in results.columns if c not in ("session_id", "frame_index", "event_time")]
    return met.select(
        F.coalesce("session_id", "_s").alias("session_id"),
        F.coalesce("frame_index", "_i").alias("frame_index"),
        F.coalesce("capture_time", F.coalesce("frame_index", "_i") * seconds_per_frame).alias("timestamp"),
        F.when(has("session_id") & has("_s"), "both").when(has("session_id"), "result").otherwise("capture").alias("half"),
        *others,
    )
