"""Queries over what live connections answer: name -> (query, SQL)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.optical_flow import STATISTICS, statistics
from ..operators import answers
from ..streaming import pairing
from . import domain as D
from .frame_queries import _STATS, round_sql

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each label's frames as one live session, two frames a second."""
    at = F.timestamp_millis(F.col("frame_index") * 500)
    return D.pixel_frames(spark, d).select(F.col("analysis_id").cast("string").alias("session_id"), "frame_index", at.alias("event_time"), "pixels")


def _softmax_sql(bands: int, n: int) -> str:
    means = ", ".join(f"list_aggregate(pixels[{k * n + 1}:{(k + 1) * n}], 'avg') * 0.01" for k in range(bands))
    return f"""(SELECT list_transform(e, lambda x: x / list_sum(e)) FROM (SELECT list_transform(m, lambda x: exp(x - list_max(m))) AS e FROM (SELECT [{means}] AS m)))"""


@query(
    "live_results",
    f"""WITH RECURSIVE {D.PIXELS}, {_STATS}, p AS MATERIALIZED (
  SELECT analysis_id, frame_index, {_softmax_sql(3, 21)} AS region, {_softmax_sql(4, 16)} AS score FROM pixel_frames
), r AS (
  SELECT analysis_id, frame_index, region, score FROM p WHERE frame_index = 0
  UNION ALL
  SELECT p.analysis_id, p.frame_index, list_transform(list_zip(p.region, r.region), lambda z: 0.3::DOUBLE * z[1] + 0.7::DOUBLE * z[2]),
    list_transform(list_zip(p.score, r.score), lambda z: 0.3::DOUBLE * z[1] + 0.7::DOUBLE * z[2])
  FROM r JOIN p ON p.analysis_id = r.analysis_id AND p.frame_index = r.frame_index + 1
)
SELECT analysis_id::VARCHAR AS session_id, frame_index, (list_position(r.score, list_max(r.score)) - 1)::INT AS score, {round_sql("list_max(r.score)", 2)} AS confidence,
  {D.LABEL.format("list_position(r.score, list_max(r.score)) - 1")} AS label,
  ['esophagus', 'stomach', 'duodenum'][list_position(r.region, list_max(r.region))] AS region,
  CASE WHEN frame_index = 0 OR change < 30 THEN 'stationary' WHEN low_shift > top_shift + 2 THEN 'insertion'
    WHEN top_shift > low_shift + 2 THEN 'withdrawal' WHEN frame_index % 2 = 0 THEN 'insertion' ELSE 'withdrawal' END AS direction,
  CASE WHEN frame_index = 0 THEN 0.5 ELSE {round_sql("least(0.95, 0.5 + change / 100)", 2)} END AS motion_confidence
FROM r JOIN s USING (analysis_id, frame_index)""",
)
def live_results(spark: SparkSession, d: str) -> DataFrame:
    out = answers.answered(sessions(spark, d), model="bands")
    return out.select(
        "session_id", "frame_index", "peace_score.score", "peace_score.confidence", "peace_score.label", "region",
        "motion.direction", F.col("motion.confidence").alias("motion_confidence"),
    )


def _textures(key: np.ndarray, right: np.ndarray, down: np.ndarray, side: int = 40) -> np.ndarray:
    """(frames, side * side): square frames of three waves that depend on ``key``, moved right and down by parts of a pixel."""
    y, x = np.mgrid[:side, :side].reshape(2, 1, -1).astype(float)
    x, y, key = x - right[:, None], y - down[:, None], key[:, None]
    return 128 + sum(30 * np.sin(a * x + b * y + key) for a, b in ((0.35, 0.1), (-0.12, 0.4), (0.25, -0.3)))


@F.pandas_udf(STATISTICS)
def _texture_flow(key: pd.Series, right: pd.Series, down: pd.Series) -> pd.DataFrame:
    """The flow from a key's frame to the same one moved; frames are made some at a time where they are compared."""
    places = np.stack([key, right, down], 1).astype(float)
    out = np.full(places.shape, np.nan)
    for k in range(0, len(places), 256):
        n, dx, dy = np.nan_to_num(places[k : k + 256]).T
        out[k : k + 256] = statistics(_textures(n, 0 * dx, 0 * dy), _textures(n, dx, dy), 8)
    # a part of the shift that isn't known is none that was found
    out[:, 1:][np.isnan(places[:, 1:])] = np.nan
    return pd.DataFrame(out, columns=STATISTICS.names)


@query(
    "flow_shifts",
    """WITH m AS (SELECT s_suppkey, (s_suppkey % 9 - 4) / 2 AS dx, (s_nationkey % 9 - 4) / 2 AS dy FROM supplier), n AS (SELECT *, sqrt(dx * dx + dy * dy) AS m FROM m)
SELECT s_suppkey, dx::DOUBLE AS dx, dy::DOUBLE AS dy, CASE WHEN m < 1.5 OR abs(dy / (m + 1e-6)) < 0.4 THEN 'stationary' WHEN dy > 0 THEN 'insertion' ELSE 'withdrawal' END AS direction FROM n""",
)
def flow_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier's frame and the same moved by halves of a pixel: the flow finds how far."""
    key = F.col("s_suppkey")
    suppliers = D.dealt(D.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    half = lambda c: (F.floor(F.col(f"flow.{c}") * 2 + 0.5) / 2 + 0.0).cast("double")
    found = suppliers.select("s_suppkey", _texture_flow(key, (key % 9 - 4) / 2, (F.col("s_nationkey") % 9 - 4) / 2).alias("flow"))
    moved = found.select("s_suppkey", half("horizontal").alias("dx"), half("vertical").alias("dy"))
    return moved.withColumn("direction", S.flow_motion(F.hypot("dx", "dy"), F.col("dy"))["direction"])


@query(
    "paired_results",
    f"""WITH {D.FRAMES}, r AS (SELECT * FROM frames WHERE t_us % 7 <> 2), c AS (SELECT *, t_us / 1e6 AS capture_time FROM frames WHERE t_us % 5 <> 3)
SELECT analysis_id::VARCHAR AS session_id, frame_index::BIGINT AS frame_index, coalesce(capture_time, frame_index * 0.5)::DOUBLE AS timestamp, r.score,
  CASE WHEN c.score IS NULL THEN 'result' WHEN r.score IS NULL THEN 'capture' ELSE 'both' END AS half
FROM r FULL JOIN c USING (analysis_id, frame_index)""",
)
def paired_results(spark: SparkSession, d: str) -> DataFrame:
    """Frames as results and as captures, either half missing for some."""
    frames = D.frames(spark, d).withColumns({"session_id": F.col("analysis_id").cast("string"), "event_time": F.timestamp_micros("t_us")})
    results = frames.where("t_us % 7 <> 2").select("session_id", "frame_index", "event_time", "score")
    captures = frames.where("t_us % 5 <> 3").select("session_id", "frame_index", "event_time", (F.col("t_us") / 1e6).alias("capture_time"))
    return pairing.paired(results, captures).select("session_id", "frame_index", "timestamp", "half", "score")


@query(
    "malformed_messages",
    """WITH m AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN props[:4] WHEN 1 THEN '{"session_id": "' || user_id || '"}'
  WHEN 2 THEN '{"frame_index": ' || event_id || '}' ELSE '{"session_id": "' || user_id || '", "frame_index": ' || event_id || '}' END AS message, user_id FROM events)
SELECT event_id % 7 IN (0, 1, 2) AS malformed, count(*) AS n, min(event_id) AS first, max(message) AS last FROM m GROUP BY 1""",
)
def malformed_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of which some are cut off or lack a field: what is read, and what goes aside."""
    kind, user, number = F.col("event_id") % 7, F.col("user_id").cast("string"), F.col("event_id").cast("string")
    session, frame = F.concat(F.lit('"session_id": "'), user, F.lit('"')), F.concat(F.lit('"frame_index": '), number)
    text = (
        F.when(kind == 0, F.substring("props", 1, 4)).when(kind == 1, F.concat(F.lit("{"), session, F.lit("}")))
        .when(kind == 2, F.concat(F.lit("{"), frame, F.lit("}"))).otherwise(F.concat(F.lit("{"), session, F.lit(", "), frame, F.lit("}")))
    )
    messages = D.table(spark, d, "events").select("event_id", text.alias("message"), text.alias("kept"))
    good, bad = pairing.read_messages(messages)
    both = good.select("event_id", F.lit(False).alias("malformed"), "kept").unionByName(bad.select("event_id", F.lit(True).alias("malformed"), "kept"))
    return both.groupBy("malformed").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("kept").alias("last"))
