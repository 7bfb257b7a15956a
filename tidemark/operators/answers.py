"""What a live connection answers for each frame, and the same over stored frames.

Models are plug-ins, by name: a *model* gives the probabilities of regions and scores from
a frame's pixels, which are smoothed along the session; without one, a *classifier* scores
brightness and contrast, and a *region* rule decides the rest. *pairwise* tells motion from a
frame and the one before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import scalars as S
from . import series

ALPHA = 0.3


def with_probabilities(frames: DataFrame, model: str | None, pixels: str = "pixels") -> DataFrame:
    """Adds ``region_probs`` and ``score_probs``, null without a model."""
    none = F.lit(None).cast("struct<region_probs:array<double>,score_probs:array<double>>")
    made = plugins.plugin("model", model)(F.col(pixels)) if model else none
    return frames.withColumn("_made", made).withColumns({c: F.col(f"_made.{c}") for c in ("region_probs", "score_probs")}).drop("_made")


def with_session_state(frames: DataFrame, pixels: str = "pixels", alpha: float = ALPHA, by: str = "session_id") -> DataFrame:
    """Over stored frames, what the live operator keeps as state: the frame before, the
    frame's number, and both smoothed vectors. Frames without probabilities leave these as
    they are. Of frames with one index one counts: the first by event time."""
    one = Window.partitionBy(by, "frame_index").orderBy("event_time")
    order = Window.partitionBy(by).orderBy("frame_index")
    once = frames.withColumn("_rank", F.row_number().over(one)).where("_rank = 1").drop("_rank")
    numbered = once.withColumns({"n": (F.row_number().over(order) - 1).cast("bigint"), "previous": F.lag(pixels).over(order)})
    for c in ("region_probs", "score_probs"):
        numbered = series.smoothed(numbered, c, alpha, c.replace("probs", "smoothed"), by=by)
    return numbered


def likeliest(smoothed: Column) -> Column:
    return S.argmax(F.when(F.size(smoothed) > 0, smoothed))


def answers(states: DataFrame, pixels: str = "pixels", classifier: str = "heuristic", pairwise: str = "heuristic", region: str = "heuristic") -> DataFrame:
    """The answers to frames with their session's state. A live session has no duration, so a
    region without a model is that of an unknown one."""
    x = F.col(pixels)
    score = F.coalesce(likeliest(F.col("score_smoothed")), plugins.plugin("classifier", classifier)(S.mean(x), S.deviation(x)))
    regions = F.array(*map(F.lit, S.REGIONS))
    motion = F.when(F.col("previous").isNotNull(), plugins.plugin("pairwise", pairwise)(x, F.col("previous"), F.col("frame_index")))
    still = F.struct(F.lit("stationary").alias("direction"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("optical_flow_magnitude"))
    return states.select(
        "session_id",
        F.lit("frame_result").alias("type"),
        F.col("n").alias("frame_index"),
        F.col("event_time").alias("timestamp"),
        score.alias("_score"),
        S.rounded(F.array_max("score_smoothed"), 2).alias("_confidence"),
        F.coalesce(motion, still).alias("motion"),
        F.coalesce(F.get(regions, likeliest(F.col("region_smoothed"))), plugins.plugin("region", region)(F.lit(0.0), F.lit(0.0))).alias("region"),
    ).select(
        "session_id", "type", "frame_index", "timestamp",
        F.struct(F.col("_score").alias("score"), S.label(F.col("_score")).alias("label"), F.col("_confidence").alias("confidence")).alias("peace_score"),
        "motion", "region",
    )


def answered(frames: DataFrame, pixels: str = "pixels", model: str | None = None, alpha: float = ALPHA, **named: str) -> DataFrame:
    """The answers over stored frames (session_id, frame_index, event_time, pixels)."""
    return answers(with_session_state(with_probabilities(frames, model, pixels), pixels, alpha), pixels, **named)
