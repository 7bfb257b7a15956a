"""What the service's endpoints answer, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import plugins
from .functions import scalars as S
from .operators import rollups, series, sessions, validation
from .streaming import live

list_sessions = sessions.list_sessions
list_users = sessions.search_users
live_pipeline = live.analysed
smoothed_classes = live.smoothed
finalize_live = validation.live_save


def score_frames(stats: DataFrame, classifier: str = "heuristic", motion: str = "heuristic", region: str = "heuristic") -> DataFrame:
    """Score, label, direction and region of frames with pixel statistics
    (frames.pixel_statistics), ``t_us`` and ``dur_us``, by the named plug-ins."""
    score = plugins.plugin("classifier", classifier)(F.col("brightness"), F.col("contrast"))
    coin = F.pmod("frame_index", F.lit(2)) == 0
    direction = plugins.plugin("motion", motion)(F.col("change"), F.col("top_shift"), F.col("lower_shift"), coin)
    return stats.withColumns({
        "score": score,
        "direction": F.when(F.col("change").isNull(), "stationary").otherwise(direction),
        "region": plugins.plugin("region", region)(F.col("t_us"), F.col("dur_us")),
    }).withColumn("label", S.label(F.col("score")))


def analyze_videos(scored: DataFrame, videos: DataFrame | None = None, at: str = "t_us") -> dict[str, DataFrame]:
    """The parts of an analysis, lazily: ``timeline``, ``segments``, ``regions`` and
    ``overall`` (for all of ``videos``, if given, also those without frames)."""
    both = rollups.overall_and_regions(scored)
    overall = both.where("level = 'overall'").select("analysis_id", "score", "label", "confidence")
    return {
        "timeline": scored.select("analysis_id", "frame_index", at, F.col("direction").alias("motion"), "region", F.col("score").alias("peace_score"), "conf_pct"),
        "segments": series.motion_segments(scored, at),
        "regions": both.where("level = 'region'").select("analysis_id", "region", "score", "label", "confidence", "frames"),
        "overall": rollups.with_empty_videos(videos, overall) if videos is not None else overall,
    }


def session_detail(rows: DataFrame, analysis_id: str) -> DataFrame:
    return rows.where(F.col("analysis_id") == analysis_id).limit(1)


def admit_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (name, media_type, head, size, user_id, upload_limit, created_at, id)
    with the first reason against each, or null. Only uploads that pass the other
    checks take a slot of the quota."""
    reason = (
        F.when(~validation.is_video_type(F.col("media_type"), F.col("name")), "type")
        .when(~validation.fits(F.col("size")), "size")
        .when(~validation.is_video_file(F.col("head")), "content")
    )
    checked = uploads.withColumn("reason", reason)
    admitted = sessions.admitted(checked.where("reason IS NULL"))
    late = admitted.withColumn("reason", F.when(~F.col("accepted"), "quota")).drop("ordinal", "accepted")
    return checked.where("reason IS NOT NULL").unionByName(late)
