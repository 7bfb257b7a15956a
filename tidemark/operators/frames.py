"""Frames: sampling, scoring and the timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def sampled(frames: DataFrame, fps: Column, rate: float = 2.0, most: int = 500) -> DataFrame:
    """Every k-th frame of a video with k = max(1, int(fps / rate)), the first
    ``most`` of them, with their seconds from the start."""
    kept = frames.withColumn("_fps", fps).where(F.pmod("frame_index", S.sampling_interval(F.col("_fps"), rate)) == 0)
    order = Window.partitionBy("analysis_id").orderBy("frame_index")
    return (
        kept.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= most)
        .withColumn("timestamp", S.frame_seconds(F.col("frame_index"), F.col("_fps")))
        .drop("_rank", "_fps")
    )


def video_metadata(videos: DataFrame) -> DataFrame:
    """Duration of each video from its frame count and rate."""
    seconds = F.when(F.col("fps") > 0, F.col("total_frames") / F.col("fps")).otherwise(0.0)
    return videos.withColumn("duration_seconds", S.rounded(seconds, 2))


def scored(frames: DataFrame, brightness: str = "brightness", contrast: str = "contrast") -> DataFrame:
    """Heuristic score and label of each frame."""
    score = S.heuristic_score(F.col(brightness), F.col(contrast))
    return frames.withColumn("score", score).withColumn("label", S.label(F.col("score")))


def timeline(results: DataFrame) -> DataFrame:
    """The nested frame results as timeline rows; no motion counts as stationary."""
    return results.select(
        "analysis_id",
        "frame_index",
        "timestamp",
        F.coalesce("motion.direction", F.lit("stationary")).alias("motion"),
        "region",
        F.col("peace_score.score").alias("peace_score"),
        F.col("peace_score.confidence").alias("confidence"),
    )


def live_timeline(results: DataFrame, seconds_per_frame: float = 0.5) -> DataFrame:
    """Live results as timeline rows; without a capture time the ordinal tells it."""
    return results.withColumns({
        "timestamp": F.coalesce(F.col("capture_time"), F.col("frame_index") * seconds_per_frame),
        "motion": F.coalesce("motion", F.lit("stationary")),
        "region": F.coalesce("region", F.lit("stomach")),
    })


def pixel_statistics(frames: DataFrame, pixels: str = "pixels") -> DataFrame:
    """Mean, deviation, and against the frame before: mean absolute change and the
    mean shift of either half; the pixels themselves go no further."""
    order = Window.partitionBy("analysis_id").orderBy("frame_index")
    return statistics_against(frames.withColumn("_before", F.lag(pixels).over(order)), pixels, "_before")


def statistics_against(frames: DataFrame, pixels: str, previous: str) -> DataFrame:
    """The same with the frame before at hand, null for a first one."""
    x, before = F.col(pixels), F.col(previous)
    shift = lambda lower: S.mean(S.half(x, lower)) - S.mean(S.half(before, lower))
    return frames.withColumns({
        "brightness": S.mean(x),
        "contrast": S.deviation(x),
        "change": F.when(before.isNotNull(), S.mean_change(x, before)),
        "top_shift": F.when(before.isNotNull(), shift(False)),
        "lower_shift": F.when(before.isNotNull(), shift(True)),
    }).drop(previous, pixels)


def with_motion(stats: DataFrame) -> DataFrame:
    """Direction, confidence and magnitude; a video's first frame stands still."""
    change = F.col("change")
    coin = F.pmod("frame_index", F.lit(2)) == 0
    direction = S.heuristic_motion(change, F.col("top_shift"), F.col("lower_shift"), coin)
    first = change.isNull()
    return stats.withColumns({
        "direction": F.when(first, "stationary").otherwise(direction),
        "motion_confidence": F.when(first, 0.5).otherwise(S.rounded(S.heuristic_confidence(change), 2)),
        "magnitude": F.when(first, 0.0).otherwise(S.rounded(change, 1)),
    })
