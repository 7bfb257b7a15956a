"""Queries over frames: name -> (query, SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import frames as O
from ..operators import rollups as R
from ..operators import series as W
from . import domain as D

QUERIES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


def round_sql(x: str, digits: int) -> str:
    return f"floor(({x}) * {10**digits} + 0.5) / {10**digits}"


@query(
    "overall_by_region",
    f"""WITH {D.FRAMES}
SELECT analysis_id, region, min(score) AS score, floor(sum(conf_pct) / count(*) + 0.5)::BIGINT AS confidence,
  count(*) AS frames, min(frame_index) AS first_frame, {D.LABEL.format("min(score)")} AS label,
  CASE WHEN grouping(region) = 0 THEN 'region' ELSE 'overall' END AS level
FROM frames GROUP BY GROUPING SETS ((analysis_id, region), (analysis_id))""",
)
def overall_by_region(spark: SparkSession, d: str) -> DataFrame:
    return R.overall_and_regions(D.frames(spark, d))


@query(
    "overall_with_empty_videos",
    f"""WITH {D.FRAMES}
SELECT c_custkey AS analysis_id, coalesce(score, 0) AS score, coalesce(label, 'Poor') AS label, coalesce(confidence, 0) AS confidence
FROM customer LEFT JOIN (
  SELECT analysis_id, min(score) AS score, {D.LABEL.format("min(score)")} AS label,
    floor(sum(conf_pct) / count(*) + 0.5)::BIGINT AS confidence FROM frames GROUP BY analysis_id) ON c_custkey = analysis_id""",
)
def overall_with_empty_videos(spark: SparkSession, d: str) -> DataFrame:
    videos = D.table(spark, d, "customer").select(F.col("c_custkey").alias("analysis_id"))
    overall = R.overall_and_regions(D.frames(spark, d)).where("level = 'overall'")
    return R.with_empty_videos(videos, overall.select("analysis_id", "score", "label", "confidence"))


@query(
    "timeline",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, {round_sql("t_us / 1e6", 2)} AS timestamp, direction AS motion, region, score AS peace_score,
  conf_pct / 100 AS confidence FROM frames""",
)
def timeline(spark: SparkSession, d: str) -> DataFrame:
    nested = D.frames(spark, d).select(
        "analysis_id",
        "frame_index",
        S.rounded(F.col("t_us") / 1e6, 2).alias("timestamp"),
        F.struct("score", S.label(F.col("score")).alias("label"), (F.col("conf_pct") / 100).alias("confidence")).alias("peace_score"),
        # stationary frames come without motion
        F.when(F.col("direction") != "stationary", F.struct("direction")).alias("motion"),
        "region",
    )
    return O.timeline(nested)


@query(
    "region_frames",
    f"""WITH {D.FRAMES}
SELECT analysis_id, region, chunk, count(*) AS n, min(frame_index) AS first_frame, max(frame_index) AS last_frame, sum(score)::BIGINT AS total
FROM (SELECT *, ((row_number() OVER (PARTITION BY analysis_id, region ORDER BY frame_index) - 1) // 25)::INT AS chunk FROM frames) GROUP BY ALL""",
)
def region_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d).withColumns({"timestamp": F.col("t_us"), "confidence": F.col("conf_pct")})
    items = F.col("frame_scores")
    return R.region_frames(rows, 25).select(
        "analysis_id",
        "region",
        "chunk",
        F.size(items).cast("bigint").alias("n"),
        F.get(items, F.lit(0))["frame_index"].alias("first_frame"),
        F.get(items, F.size(items) - 1)["frame_index"].alias("last_frame"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["score"]).alias("total"),
    )


@query(
    "score_stats",
    f"""WITH {D.FRAMES}
SELECT analysis_id, min(score) AS min_score, max(score) AS max_score, {round_sql("avg(score)", 2)} AS avg_score
FROM frames GROUP BY analysis_id""",
)
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.score_stats(D.frames(spark, d))


@query(
    "live_region_agg",
    f"""WITH {D.FRAMES}
SELECT analysis_id, coalesce(nullif(region, 'duodenum'), 'stomach') AS region, min(score) AS score, {round_sql("avg(conf_pct)", 6)} AS confidence
FROM frames GROUP BY ALL""",
)
def live_region_agg(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d).withColumn("region", F.nullif("region", F.lit("duodenum")))
    return R.live_regions(rows).withColumn("confidence", S.rounded(F.col("confidence"), 6))


@query(
    "region_dim_left",
    f"""WITH {D.FRAMES}, r AS (SELECT analysis_id, region, min(score) AS score FROM frames WHERE analysis_id % 3 <> CASE region WHEN 'esophagus' THEN 0 WHEN 'stomach' THEN 1 ELSE 2 END GROUP BY ALL)
SELECT v.analysis_id, d.ord, d.region, r.score, coalesce({D.LABEL.format("r.score")}, 'No data') AS label
FROM (SELECT DISTINCT analysis_id FROM r) v CROSS JOIN (VALUES (0, 'esophagus'), (1, 'stomach'), (2, 'duodenum')) d(ord, region)
LEFT JOIN r ON r.analysis_id = v.analysis_id AND r.region = d.region""",
)
def region_dim_left(spark: SparkSession, d: str) -> DataFrame:
    # a third of the videos has no frames of a region
    rows = D.frames(spark, d).where("analysis_id % 3 <> CASE region WHEN 'esophagus' THEN 0 WHEN 'stomach' THEN 1 ELSE 2 END")
    regions = rows.groupBy("analysis_id", "region").agg(F.min("score").alias("score"))
    return R.in_anatomical_order(spark, regions)


@query(
    "motion_segments",
    f"""WITH {D.FRAMES}, m AS (
  SELECT *, coalesce(lag(direction) OVER w <> direction, true) AS starts,
    sum(conf_pct) OVER (PARTITION BY analysis_id ORDER BY frame_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent,
    max(t_us) OVER (PARTITION BY analysis_id) AS last_us
  FROM frames WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index)
)
SELECT analysis_id, row_number() OVER w - 1 AS segment, t_us AS start_time, coalesce(lead(t_us) OVER w, last_us) AS end_time,
  direction, coalesce(floor(lead(recent) OVER w / least(5, lead(frame_index) OVER w) + 0.5), 85)::BIGINT AS confidence
FROM m WHERE starts WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index)""",
)
def motion_segments(spark: SparkSession, d: str) -> DataFrame:
    return W.motion_segments(D.frames(spark, d), at="t_us")


@query(
    "consensus_motion",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, CASE WHEN count(*) OVER w = 3 AND min(direction) OVER w = max(direction) OVER w
  AND min(conf_pct) OVER w >= 60 AND direction <> 'stationary' THEN direction ELSE 'stationary' END AS consensus
FROM frames WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def consensus_motion(spark: SparkSession, d: str) -> DataFrame:
    return W.consensus(D.frames(spark, d)).select("analysis_id", "frame_index", "consensus")


@query(
    "nearest_entry",
    f"""WITH {D.FRAMES}, c AS (
  SELECT DISTINCT analysis_id, k AS cursor, k * (dur_us // 16) + 12345 AS t FROM frames CROSS JOIN range(0, 18) r(k)
)
SELECT c.analysis_id, c.cursor, c.t AS t_us, arg_min(f.frame_index, row(abs(f.t_us - c.t), f.frame_index)) AS frame_index,
  arg_min(f.t_us, row(abs(f.t_us - c.t), f.frame_index)) AS entry_at
FROM c JOIN frames f USING (analysis_id) GROUP BY ALL""",
)
def nearest_entry(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d)
    steps = F.explode(F.sequence(F.lit(0), F.lit(17))).alias("cursor")
    cursors = (
        rows.groupBy("analysis_id")
        .agg(F.max("dur_us").alias("dur_us"))
        .select("analysis_id", "dur_us", steps)
        .select("analysis_id", F.col("cursor").cast("bigint"), F.expr("cursor * (dur_us DIV 16) + 12345").alias("t_us"))
    )
    return W.nearest(rows, cursors)


@query(
    "frame_sampling",
    f"""WITH {D.FRAMES}, s AS (
  SELECT *, (5 + analysis_id % 26)::DOUBLE AS fps FROM frames
), k AS (
  SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY frame_index) AS r FROM s
  WHERE frame_index % greatest(1, floor(fps / 2.0))::BIGINT = 0
)
SELECT analysis_id, frame_index, {round_sql("frame_index / fps", 2)} AS timestamp FROM k WHERE r <= 500""",
)
def frame_sampling(spark: SparkSession, d: str) -> DataFrame:
    fps = (5 + F.pmod("analysis_id", F.lit(26))).cast("double")
    return O.sampled(D.frames(spark, d), fps).select("analysis_id", "frame_index", "timestamp")


@query(
    "frame_metadata",
    f"""SELECT o_orderkey AS id, {round_sql("CASE WHEN fps > 0 THEN n / fps ELSE 0 END", 2)} AS duration_seconds,
  greatest(1, floor(fps / 2.0))::BIGINT AS step
FROM (SELECT o_orderkey, (o_orderkey % 31)::DOUBLE AS fps, o_custkey AS n FROM orders)""",
)
def frame_metadata(spark: SparkSession, d: str) -> DataFrame:
    videos = D.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.pmod("o_orderkey", F.lit(31)).cast("double").alias("fps"), F.col("o_custkey").alias("total_frames")
    )
    return O.video_metadata(videos).select("id", "duration_seconds", S.sampling_interval(F.col("fps")).alias("step"))


@query(
    "time_buckets",
    f"""WITH {D.FRAMES}
SELECT analysis_id, t_us // 3600000000 AS bucket, min(frame_index) AS frame_index, arg_min(score, frame_index) AS score
FROM frames GROUP BY ALL""",
)
def time_buckets(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d).select("analysis_id", "frame_index", "t_us", "score")
    return W.first_per_bucket(rows, F.expr("t_us DIV 3600000000")).drop("t_us")


@query(
    "latest_result",
    f"""WITH {D.FRAMES}
SELECT analysis_id, max(frame_index) AS frame_index, arg_max(score, frame_index) AS score, arg_max(direction, frame_index) AS direction
FROM frames GROUP BY analysis_id""",
)
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    return W.last_entry(D.frames(spark, d), "frame_index", "score", "direction")


@query("last_timestamp", f"WITH {D.FRAMES} SELECT analysis_id, arg_max(t_us, frame_index) AS t_us FROM frames GROUP BY analysis_id")
def last_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return W.last_entry(D.frames(spark, d), "t_us")


@query(
    "step_frame",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, least(frame_index + 1, max(frame_index) OVER p) AS next_frame, greatest(frame_index - 1, 0) AS previous_frame
FROM frames WINDOW p AS (PARTITION BY analysis_id)""",
)
def step_frame(spark: SparkSession, d: str) -> DataFrame:
    ahead = W.stepped(D.frames(spark, d), 1).withColumnRenamed("target", "next_frame")
    return W.stepped(ahead, -1).select("analysis_id", "frame_index", "next_frame", F.col("target").alias("previous_frame"))


@query(
    "step_after",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, last_value(CASE WHEN score > 0 THEN score END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS held,
  coalesce(lead(t_us) OVER w, t_us) AS until, score >= 2 AS over_threshold
FROM frames WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index)""",
)
def step_after(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d).withColumn("known", F.when(F.col("score") > 0, F.col("score")))
    return W.held(rows, "known", "t_us").select("analysis_id", "frame_index", "held", "until", (F.col("score") >= 2).alias("over_threshold"))


_HALVES = """list_aggregate(pixels[1:32], 'avg') AS top, list_aggregate(pixels[33:64], 'avg') AS low"""
_STATS = f"""stats AS (
  SELECT *, list_aggregate(pixels, 'avg') AS mean, list_aggregate(pixels, 'stddev_pop') AS dev, {_HALVES},
    lag(pixels) OVER (PARTITION BY analysis_id ORDER BY frame_index) AS prev FROM pixel_frames
), s AS (
  SELECT analysis_id, frame_index, mean, dev,
    list_aggregate(list_transform(list_zip(pixels, prev), lambda z: abs(z[1] - z[2])), 'avg') AS change,
    top - lag(top) OVER w AS top_shift, low - lag(low) OVER w AS low_shift
  FROM stats WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index)
)"""


@query(
    "pixel_stats",
    f"""WITH {D.PIXELS}, {_STATS}
SELECT analysis_id, frame_index, {round_sql("mean", 4)} AS brightness, {round_sql("dev", 4)} AS contrast,
  CASE WHEN frame_index > 0 THEN {round_sql("change", 4)} END AS change,
  {round_sql("top_shift", 4)} AS top_shift, {round_sql("low_shift", 4)} AS lower_shift FROM s""",
)
def pixel_stats(spark: SparkSession, d: str) -> DataFrame:
    out = O.pixel_statistics(D.pixel_frames(spark, d))
    columns = ["brightness", "contrast", "change", "top_shift", "lower_shift"]
    return out.select("analysis_id", "frame_index", *(S.rounded(F.col(c), 4).alias(c) for c in columns))


@query(
    "frame_motion",
    f"""WITH {D.PIXELS}, {_STATS}
SELECT analysis_id, frame_index,
  CASE WHEN frame_index = 0 OR change * 3 < 30 THEN 'stationary' WHEN low_shift * 3 > top_shift * 3 + 2 THEN 'insertion'
    WHEN top_shift * 3 > low_shift * 3 + 2 THEN 'withdrawal' WHEN frame_index % 2 = 0 THEN 'insertion' ELSE 'withdrawal' END AS direction,
  CASE WHEN frame_index = 0 THEN 0.5 ELSE {round_sql("least(0.95, 0.5 + change * 3 / 100)", 2)} END AS confidence,
  CASE WHEN frame_index = 0 THEN 0.0 ELSE {round_sql("change * 3", 1)} END AS magnitude
FROM s""",
)
def frame_motion(spark: SparkSession, d: str) -> DataFrame:
    stats = O.pixel_statistics(D.pixel_frames(spark, d))
    stats = stats.withColumns({c: F.col(c) * 3 for c in ("change", "top_shift", "lower_shift")})
    return O.with_motion(stats).select(
        "analysis_id", "frame_index", "direction", F.col("motion_confidence").alias("confidence"), "magnitude"
    )


@query(
    "heuristic_scores",
    """SELECT event_id, CASE WHEN b < 50 OR c < 20 THEN 0 WHEN b < 100 OR c < 40 THEN 1 WHEN b < 170 THEN 2 ELSE 3 END AS score,
  CASE WHEN b < 50 OR c < 20 THEN 'Poor' WHEN b < 100 OR c < 40 THEN 'Inadequate' WHEN b < 170 THEN 'Adequate' ELSE 'Excellent' END AS label
FROM (SELECT event_id, value * 4 AS b, json_extract_string(props, '$.k')::INT AS c FROM events)""",
)
def heuristic_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "events").select(
        "event_id", (F.col("value") * 4).alias("brightness"), F.get_json_object("props", "$.k").cast("int").alias("contrast")
    )
    return O.scored(rows).select("event_id", "score", "label")


_FLOW = "flow AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE * 10) AS dx, list_transform(embedding[33:64], lambda x: x::DOUBLE * 10 + (vec_id % 5 - 2)) AS dy FROM embeddings), g AS (SELECT vec_id, list_aggregate(list_transform(list_zip(dx, dy), lambda z: sqrt(z[1] * z[1] + z[2] * z[2])), 'avg') AS m, list_aggregate(dy, 'avg') AS v FROM flow)"


@query(
    "flow_motion",
    f"""WITH {_FLOW}
SELECT vec_id, CASE WHEN m < 1.5 OR abs(v / (m + 1e-6)) < 0.4 THEN 'stationary' WHEN v > 0 THEN 'insertion' ELSE 'withdrawal' END AS direction,
  {round_sql("CASE WHEN m < 1.5 THEN least(0.95, 0.7 + (1.5 - m) / 1.5 * 0.25) WHEN abs(v / (m + 1e-6)) < 0.4 THEN 0.5 ELSE least(0.95, 0.5 + abs(v / (m + 1e-6))) END", 4)} AS confidence
FROM g""",
)
def flow_motion(spark: SparkSession, d: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double") * 10)
    shift = (F.pmod("vec_id", F.lit(5)) - 2).cast("double")
    field = S.flow(S.half(e, False), F.transform(S.half(e, True), lambda y: y + shift))
    rows = D.table(spark, d, "embeddings").select("vec_id", field.alias("f"))
    motion = S.flow_motion(F.col("f.magnitude"), F.col("f.vertical"))
    return rows.select("vec_id", motion.alias("m")).select("vec_id", "m.direction", S.rounded(F.col("m.confidence"), 4).alias("confidence"))


@query(
    "softmax_argmax",
    """WITH l AS (SELECT vec_id, list_transform(embedding[4:7], lambda x: x::DOUBLE * 5) AS x FROM embeddings),
p AS (SELECT vec_id, x, list_transform(x, lambda v: exp(v - list_max(x))) AS e FROM l)
SELECT vec_id, list_position(x, list_max(x)) - 1 AS class, floor(list_max(e) / list_sum(e) * 1e6 + 0.5)::BIGINT AS top_ppm FROM p""",
)
def softmax_argmax(spark: SparkSession, d: str) -> DataFrame:
    logits = F.transform(F.slice("embedding", 4, 4), lambda x: x.cast("double") * 5)
    p = S.softmax(logits)
    return D.table(spark, d, "embeddings").select("vec_id", p.alias("p")).select(
        "vec_id", S.argmax(F.col("p")).alias("class"), F.floor(F.array_max("p") * 1e6 + 0.5).alias("top_ppm")
    )


@query(
    "ema_probs",
    f"""WITH RECURSIVE {D.PIXELS}, f AS (SELECT analysis_id, frame_index, list_transform(pixels[1:3], lambda x: x / 100) AS p FROM pixel_frames),
r AS (
  SELECT analysis_id, frame_index, p AS s FROM f WHERE frame_index = 0
  UNION ALL
  SELECT f.analysis_id, f.frame_index, list_transform(list_zip(f.p, r.s), lambda z: 0.3::DOUBLE * z[1] + 0.7::DOUBLE * z[2])
  FROM r JOIN f ON f.analysis_id = r.analysis_id AND f.frame_index = r.frame_index + 1
)
SELECT analysis_id, frame_index, floor(s[1] * 1e6 + 0.5)::BIGINT AS s1, floor(s[2] * 1e6 + 0.5)::BIGINT AS s2,
  floor(s[3] * 1e6 + 0.5)::BIGINT AS s3, list_position(s, list_max(s)) - 1 AS class FROM r""",
)
def ema_probs(spark: SparkSession, d: str) -> DataFrame:
    rows = D.pixel_frames(spark, d).select("analysis_id", "frame_index", F.transform(F.slice("pixels", 1, 3), lambda x: x / 100).alias("p"))
    s = lambda k: F.floor(F.get("smoothed", F.lit(k)) * 1e6 + 0.5).alias(f"s{k + 1}")
    return W.smoothed(rows, "p").select("analysis_id", "frame_index", s(0), s(1), s(2), S.argmax(F.col("smoothed")).alias("class"))


@query(
    "normalised_pixels",
    """SELECT vec_id, floor(list_aggregate(list_transform(embedding, lambda x: (abs(x::DOUBLE) * 255 / 255.0 - 0.485) / 0.229), 'avg') * 1e6 + 0.5)::BIGINT AS mean_ppm FROM embeddings""",
)
def normalised_pixels(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 255)
    return D.table(spark, d, "embeddings").select("vec_id", F.floor(S.mean(S.normalised(pixels, 0)) * 1e6 + 0.5).alias("mean_ppm"))


@query(
    "dialog_runs",
    """WITH m AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
n AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS run FROM m)
SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM n GROUP BY ALL""",
)
def dialog_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = D.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return W.runs(rows, "conv_id", "turn", "role")


@query(
    "visited_flags",
    """SELECT user_id, count(*) AS visited, count(*) / 8 AS part, bool_or(event_type = 'purchase') AS reached FROM events GROUP BY user_id""",
)
def visited_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.visited(D.table(spark, d, "events"), "user_id", "event_type", "purchase")


@query(
    "live_timeline",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, CASE WHEN frame_index % 3 = 0 THEN t_us / 1e6 ELSE frame_index * 0.5 END::DOUBLE AS timestamp,
  direction AS motion, coalesce(nullif(region, 'esophagus'), 'stomach') AS region FROM frames""",
)
def live_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = D.frames(spark, d).select(
        "analysis_id",
        "frame_index",
        F.when(F.col("frame_index") % 3 == 0, F.col("t_us") / 1e6).alias("capture_time"),
        F.nullif("direction", F.lit("stationary")).alias("motion"),
        F.nullif("region", F.lit("esophagus")).alias("region"),
    )
    return O.live_timeline(rows).select("analysis_id", "frame_index", "timestamp", "motion", "region")


@query(
    "previous_pairs",
    f"""WITH {D.FRAMES}
SELECT analysis_id, frame_index, coalesce(abs(brightness - lag(brightness) OVER w), 0) AS change,
  lag(frame_index) OVER w IS NULL AS is_first
FROM frames WINDOW w AS (PARTITION BY analysis_id ORDER BY frame_index)""",
)
def previous_pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("analysis_id").orderBy("frame_index")
    before = F.lag("brightness").over(w)
    return D.frames(spark, d).select(
        "analysis_id", "frame_index", F.coalesce(F.abs(F.col("brightness") - before), F.lit(0.0)).alias("change"),
        F.lag("frame_index").over(w).isNull().alias("is_first"),
    )
