"""Readers and writers of files, logs and databases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schemas import JOB_EVENT, JOB_EVENT_COLUMNS, METADATA_JSON, RESULTS_JSON

# Suffixes of image files.
IMAGES = ["jpg", "jpeg", "png", "bmp"]


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (path, height, width, pixels in blue-green-red order); broken
    files come with null pixels."""
    read = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    i = F.col("image")
    return read.select(
        i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), F.when(i["height"] > 0, i["data"]).alias("pixels")
    )


def loaded_frames(read: DataFrame, size: int = 224) -> DataFrame:
    """``images`` as (path, pixels): size x size in red-green-blue order, by bilinear
    interpolation between pixel centres; a file that can't be read is an error."""

    @F.pandas_udf("array<int>")
    def resized(heights: pd.Series, widths: pd.Series, data: pd.Series) -> pd.Series:
        out = []
        for h, w, raw in zip(heights, widths, data, strict=True):
            x = np.frombuffer(raw, np.uint8).reshape(h, w, -1)
            x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, 2::-1]
            for axis, n in ((0, h), (1, w)):
                at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
                low = np.floor(at).astype(int)
                part = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
                x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, n - 1), axis) * part
            out.append(np.floor(x + 0.5).astype(np.int32).ravel())
        return pd.Series(out)

    known = F.when(F.col("pixels").isNotNull(), F.col("pixels")).otherwise(F.raise_error(F.concat(F.lit("not an image: "), F.col("path"))).cast("binary"))
    return read.select("path", resized("height", "width", known).alias("pixels"))


def labelled_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, region, score, video, frame) of the image files in folders named
    region_score; other folders and files are left out. Contents aren't read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    folder = S.class_dir(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    suffix = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    return read.where(suffix.isin(IMAGES)).select("path", name.alias("name"), folder.alias("class")).where("class IS NOT NULL").select(
        "path", "name", "class.region", "class.score", S.video_id(F.col("name")).alias("video"), S.frame_number(F.col("name")).alias("frame")
    )


def byte_range(files: DataFrame, start: int, length: int) -> DataFrame:
    return files.select("path", F.substring("content", start + 1, length).alias("part"))


def store_uploads(uploads: DataFrame, path: str) -> None:
    """Admitted uploads (user_id, id, name, content) into a folder for each user, as rows
    of Parquet with their content. Rows are appended: a repeated write has them twice, unlike
    uploads.store_files, which makes a file of each, once."""
    uploads.select("user_id", "id", "name", "content", F.octet_length("content").alias("size")).write.mode("append").partitionBy("user_id").parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Job events are only ever added."""
    events.select(*JOB_EVENT_COLUMNS).write.mode("append").parquet(path)


def job_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_EVENT).parquet(path)


def parsed(jobs: DataFrame) -> DataFrame:
    """The JSON texts of a job as nested columns; broken ones are null."""
    return jobs.withColumns({"results": F.from_json("results", RESULTS_JSON), "metadata": F.from_json("metadata", METADATA_JSON)})


def as_json(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.to_json(column))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A table by JDBC, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()
