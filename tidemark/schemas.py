"""Explicit schemas, in the form that readers take; nothing is inferred."""

from __future__ import annotations

FRAME = (
    "analysis_id string, frame_index bigint, timestamp double, "
    "peace_score struct<score:int,label:string,confidence:double>, "
    "motion struct<direction:string,confidence:double,optical_flow_magnitude:double>, region string"
)
PIXELS = (
    "analysis_id string, frame_index bigint, timestamp double, pixels array<double>"
)
TIMELINE = (
    "analysis_id string, frame_index bigint, timestamp double, motion string, region string, peace_score int, confidence double"
)
SEGMENT = (
    "analysis_id string, segment bigint, start_time double, end_time double, direction string, confidence double"
)
VIDEO = (
    "analysis_id string, duration_seconds double, fps double, resolution struct<width:int,height:int>, "
    "total_frames bigint, analyzed_frames bigint"
)
SESSION = (
    "id string, user_id string, analysis_id string, filename string, status string, overall_score int, "
    "min_score double, max_score double, avg_score double, frames_analyzed int, duration double, "
    "created_at timestamp, completed_at timestamp"
)
USER = (
    "id string, email string, name string, role string, upload_limit int, upload_count int, created_at timestamp"
)
JOB_EVENT = (
    "job_id string, seq bigint, at timestamp, kind string, progress double, error string, results string, metadata string"
)
#: Events of a log with several workers, and the version that each came in with.
LOG_EVENT = f"{JOB_EVENT}, token string"
LIVE_FRAME = (
    "session_id string, frame_index bigint, video_time double, event_time timestamp, score int, "
    "confidence double, direction string, direction_confidence double, region string, probs array<double>"
)
RESULTS_JSON = "peace_scores struct<overall:struct<score:int,label:string,confidence:double>>"
METADATA_JSON = "duration_seconds double, fps double"
JOB_EVENT_COLUMNS = [x.split()[0] for x in JOB_EVENT.split(", ")]
