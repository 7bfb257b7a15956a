"""Scores rolled up by region, video and session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def overall_and_regions(frames: DataFrame) -> DataFrame:
    """Least score and mean confidence (percent) of each video and of each region in
    it; ``region`` is null in a video's row. One shuffle, with partial sums."""
    return (
        frames.rollup("analysis_id", "region")
        .agg(
            F.grouping_id().alias("_level"),
            F.min("score").alias("score"),
            S.rounded(F.sum("conf_pct") / F.count("conf_pct"), 0).cast("bigint").alias("confidence"),
            F.count(F.lit(1)).alias("frames"),
            F.min("frame_index").alias("first_frame"),
        )
        .where("_level < 3")
        .withColumn("label", S.label(F.col("score")))
        .withColumn("level", F.when(F.col("_level") == 0, "region").otherwise("overall"))
        .drop("_level")
    )


def region_frames(frames: DataFrame, most: int = 10_000) -> DataFrame:
    """Each region's frames in order, nested in chunks of ``most``: no array grows with the video.
    ``chunk`` counts from 0."""
    item = F.struct("frame_index", "timestamp", "score", "confidence")
    place = F.row_number().over(Window.partitionBy("analysis_id", "region").orderBy("frame_index")) - 1
    chunked = frames.withColumn("chunk", F.floor(place / most).cast("int"))
    return chunked.groupBy("analysis_id", "region", "chunk").agg(F.array_sort(F.collect_list(item)).alias("frame_scores"))


def with_empty_videos(videos: DataFrame, overall: DataFrame) -> DataFrame:
    """Videos without frames score 0, "Poor", with no confidence."""
    joined = videos.join(overall, "analysis_id", "left")
    return joined.select(
        *videos.columns,
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("label", F.lit(S.LABELS[0])).alias("label"),
        F.coalesce("confidence", F.lit(0)).alias("confidence"),
    )


def score_stats(frames: DataFrame, by: str = "analysis_id") -> DataFrame:
    """Least, greatest and mean score; null where there are none."""
    return frames.groupBy(by).agg(
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        S.rounded(F.avg("score"), 2).alias("avg_score"),
    )


def live_regions(frames: DataFrame, by: str = "analysis_id") -> DataFrame:
    """Regions of a live session; frames without one count to the stomach."""
    return frames.groupBy(by, F.coalesce("region", F.lit("stomach")).alias("region")).agg(
        F.min("score").alias("score"), F.avg("conf_pct").alias("confidence")
    )


def in_anatomical_order(spark, regions: DataFrame) -> DataFrame:
    """All regions in order for each video, with "No data" where there is none."""
    dim = spark.createDataFrame(list(enumerate(S.REGIONS)), "ord int, region string")
    videos = regions.select("analysis_id").distinct()
    # three rows: as good as a constant
    grid = videos.crossJoin(F.broadcast(dim))
    return grid.join(regions, ["analysis_id", "region"], "left").withColumn(
        "label", F.coalesce(S.label(F.col("score")), F.lit("No data"))
    )


def batch_rollup(items: DataFrame, by: str) -> DataFrame:
    """Any active, all terminal, how many completed."""
    active = F.col("status").isin("pending", "uploading", "queued", "processing")
    return items.groupBy(by).agg(
        F.bool_or(active).alias("any_active"),
        F.bool_and(F.col("status").isin("completed", "failed")).alias("all_terminal"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count(F.lit(1)).alias("total"),
    )


def visited(segments: DataFrame, by: str, name: str, last: str, of: int = 8) -> DataFrame:
    """How many segments were visited of all, and whether the last was reached."""
    return segments.groupBy(by).agg(
        F.count(F.lit(1)).alias("visited"),
        (F.count(F.lit(1)) / of).alias("part"),
        F.bool_or(F.col(name) == last).alias("reached"),
    )
