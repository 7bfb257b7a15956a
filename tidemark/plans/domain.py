"""The engine's tables, defined over the driver's, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, most: int = 1024, least: int = 32) -> DataFrame:
    """Rows that take long each, of a table whose files may be few and small: dealt to tasks of at
    most so many rows, and to all cores where each gets at least so many."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // most), min(rows.sparkSession.sparkContext.defaultParallelism, n // least)))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the frames of one video."""
    w = Window.partitionBy("analysis_id")
    order = w.orderBy("us", "event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("analysis_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_id",
        F.col("value").alias("brightness"),
        F.get_json_object("props", "$.k").cast("int").alias("contrast"),
        F.when(F.col("event_type").isin("click", "purchase"), "insertion")
        .when(F.col("event_type").isin("view", "signup"), "withdrawal")
        .otherwise("stationary")
        .alias("direction"),
    )
    first, last = F.min("us").over(w), F.max("us").over(w)
    return events.select(
        "analysis_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("frame_index"),
        (F.col("us") - first).alias("t_us"),
        (last - first).alias("dur_us"),
        "brightness",
        "contrast",
        S.heuristic_score(F.col("brightness"), F.col("contrast"), ((5, 10), (15, 25)), 60).alias("score"),
        "direction",
        F.expr("CAST(50 + contrast DIV 2 AS BIGINT)").alias("conf_pct"),
    ).withColumn("region", S.region_by_progress(F.col("t_us"), F.col("dur_us")))


FRAMES = """
e AS (
  SELECT user_id AS analysis_id, epoch_us(ts) AS us, event_id, value AS brightness,
    json_extract_string(props, '$.k')::INT AS contrast,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'insertion'
         WHEN event_type IN ('view', 'signup') THEN 'withdrawal' ELSE 'stationary' END AS direction
  FROM events
), e2 AS (
  SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY us, event_id) - 1 AS frame_index,
    us - min(us) OVER (PARTITION BY analysis_id) AS t_us,
    max(us) OVER (PARTITION BY analysis_id) - min(us) OVER (PARTITION BY analysis_id) AS dur_us
  FROM e
), frames AS (
  SELECT analysis_id, frame_index, t_us, dur_us, brightness, contrast,
    CASE WHEN brightness < 5 OR contrast < 10 THEN 0 WHEN brightness < 15 OR contrast < 25 THEN 1
         WHEN brightness < 60 THEN 2 ELSE 3 END AS score,
    direction, (50 + contrast // 2)::BIGINT AS conf_pct,
    CASE WHEN dur_us <= 0 THEN 'stomach' WHEN t_us / dur_us < 0.2 THEN 'esophagus'
         WHEN t_us / dur_us < 0.7 THEN 'stomach' ELSE 'duodenum' END AS region
  FROM e2
)"""

LABEL = "CASE {0} WHEN 0 THEN 'Poor' WHEN 1 THEN 'Inadequate' WHEN 2 THEN 'Adequate' WHEN 3 THEN 'Excellent' END"


def pixel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as frames of 8 x 8 pixels, scaled by 100."""
    w = Window.partitionBy("analysis_id").orderBy("vec_id")
    pixels = F.transform("embedding", lambda x: x.cast("double") * 100)
    return (
        table(spark, sf_dir, "embeddings")
        .select(F.col("label").alias("analysis_id"), "vec_id", pixels.alias("pixels"))
        .withColumn("frame_index", (F.row_number().over(w) - 1).cast("bigint"))
    )


PIXELS = """
pixel_frames AS (
  SELECT label AS analysis_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS pixels,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_index
  FROM embeddings
)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lower(F.translate("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 50 == 0, "ADMIN").otherwise("USER").alias("role"),
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", -1)
        .when(F.col("c_mktsegment") == "BUILDING", 0)
        .when(F.col("c_mktsegment") == "FURNITURE", 5)
        .when(F.col("c_mktsegment") == "HOUSEHOLD", 10)
        .otherwise(20)
        .alias("upload_limit"),
        F.col("c_nationkey").alias("created_at"),
    )


USERS = """
users AS (
  SELECT c_custkey AS id, lower(translate(c_name, '#', '.')) || '@example.com' AS email, c_name AS name,
    CASE WHEN c_custkey % 50 = 0 THEN 'ADMIN' ELSE 'USER' END AS role,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN -1 WHEN 'BUILDING' THEN 0 WHEN 'FURNITURE' THEN 5
      WHEN 'HOUSEHOLD' THEN 10 ELSE 20 END AS upload_limit,
    c_nationkey AS created_at
  FROM customer
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.when(key % 7 == 0, "live_").otherwise("a_"), key.cast("string")).alias("analysis_id"),
        F.concat(F.lower("o_orderpriority"), F.lit("_"), key.cast("string"), F.lit(".mp4")).alias("filename"),
        F.when(F.col("o_orderstatus") == "P", "processing")
        .when(F.col("o_orderstatus") == "F", "failed")
        .otherwise("completed")
        .alias("status"),
        F.nullif((key % 5).cast("int"), F.lit(4)).alias("overall_score"),
        F.lit(None).cast("bigint").alias("frames_analyzed"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


SESSIONS = """
sessions AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
    CASE WHEN o_orderkey % 7 = 0 THEN 'live_' ELSE 'a_' END || o_orderkey AS analysis_id,
    lower(o_orderpriority) || '_' || o_orderkey || '.mp4' AS filename,
    CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
    nullif((o_orderkey % 5)::INT, 4) AS overall_score, NULL::BIGINT AS frames_analyzed, o_orderdate AS created_at
  FROM orders
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as what the worker knows of its job."""
    key = F.col("l_orderkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.max("l_linestatus").alias("_last"),
            F.min("l_linestatus").alias("_first"),
            F.count(F.lit(1)).alias("frames"),
            (F.min("l_linenumber") % 4).cast("int").alias("score"),
        )
        .select(
            F.concat(F.when(key % 7 == 0, "live_").otherwise("a_"), key.cast("string")).alias("job_id"),
            F.when(F.col("_last") == "F", "completed")
            .when(F.col("_first") == "O", "failed")
            .otherwise("processing")
            .alias("status"),
            "frames",
            "score",
        )
    )


JOBS = """
jobs AS (
  SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'live_' ELSE 'a_' END || l_orderkey AS job_id,
    CASE WHEN max(l_linestatus) = 'F' THEN 'completed' WHEN min(l_linestatus) = 'O' THEN 'failed' ELSE 'processing' END AS status,
    count(*) AS frames, (min(l_linenumber) % 4)::INT AS score
  FROM lineitem GROUP BY l_orderkey
)"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"),
        F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("seq"),
        F.when(kind == "signup", "created")
        .when(kind == "click", "claimed")
        .when(kind == "view", "progress")
        .when(kind == "purchase", "completed")
        .otherwise("failed")
        .alias("kind"),
        F.when(kind == "view", F.get_json_object("props", "$.k").cast("int") / 100).alias("progress"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error"),
    )


JOB_EVENTS = """
job_events AS (
  SELECT user_id AS job_id, epoch_us(ts) AS us, event_id,
    CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'progress'
      WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS kind,
    CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k')::INT / 100 END AS progress,
    'e' || event_id AS error
  FROM events
), job_state AS (
  SELECT job_id, count(*) FILTER (kind = 'failed') AS retry_count,
    arg_max(kind, row(us, event_id)) FILTER (kind <> 'progress') AS last,
    arg_max(progress, row(us, event_id)) FILTER (progress IS NOT NULL) AS part,
    arg_max(error, row(us, event_id)) FILTER (kind = 'failed') AS error
  FROM job_events GROUP BY job_id
), job_now AS (
  SELECT job_id, retry_count, error, status, CASE WHEN status = 'completed' THEN 1.0 ELSE coalesce(part, 0.0) END::DOUBLE AS progress
  FROM (SELECT *, CASE WHEN last = 'claimed' THEN 'processing' WHEN last = 'completed' THEN 'completed'
      WHEN last = 'failed' AND retry_count >= 3 THEN 'failed' ELSE 'queued' END AS status FROM job_state)
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels; a source is a video."""
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("video")).join(labels, "doc_id")


SAMPLES = "samples AS (SELECT doc_id, source AS video, quality, toxic FROM documents JOIN labels USING (doc_id))"
SPLIT = """
ranks AS (
  SELECT video, row_number() OVER (ORDER BY (ord * 2654435761 + 42) % 4294967296, video) - 1 AS r, count(*) OVER () AS n
  FROM (SELECT video, row_number() OVER (ORDER BY video) - 1 AS ord FROM (SELECT DISTINCT video FROM samples))
)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines in order as the epochs of a training run."""
    w = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("run"),
        F.row_number().over(w).cast("bigint").alias("epoch"),
        F.col("l_extendedprice").alias("val_loss"),
    )


EPOCHS = """
epochs AS (
  SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS epoch,
    l_extendedprice AS val_loss FROM lineitem
)"""
