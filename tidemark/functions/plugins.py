"""Models as plug-ins: scalar, pairwise and contextual ones, by name.

A plug-in is a function of columns that gives a column. The defaults are built-in
expressions; a model of one's own is wrapped by ``batch_model`` into a pandas UDF
that loads it once for each worker and sees Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import scalars as S
from .optical_flow import flow_pairwise

_plugins: dict[tuple[str, str], Callable[..., Column]] = {}


def register(kind: str, name: str, plugin: Callable[..., Column]) -> None:
    """kind: classifier (brightness, contrast), motion (change, shifts, coin), region (time, duration),
    model (pixels: probabilities of regions and scores) or pairwise (pixels, the frame before, frame number)."""
    _plugins[kind, name] = plugin


def plugin(kind: str, name: str = "heuristic") -> Callable[..., Column]:
    if (kind, name) not in _plugins:
        raise KeyError(f"no {kind} is named {name}")
    return _plugins[kind, name]


def batch_model(load: Callable[[], Callable[[pd.Series], pd.DataFrame]], returns: str) -> Callable[[Column], Column]:
    """load(): gives the model, a function from a batch of inputs to a frame with
    the fields of ``returns``."""

    @F.pandas_udf(returns)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return predict


def save_model(spark: SparkSession, model, path: str) -> str:
    """Write a model's parameters (anything that JSON holds) as one file; its path. A file that is
    there is replaced."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}.json")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(json.dumps(model, sort_keys=True).encode())
    stream.close()
    return f"{path}.json"


def file_model(spark: SparkSession, path: str, build: Callable, returns: str) -> Callable[[Column], Column]:
    """A plug-in of a saved model: Spark sends the file to the executors, where each worker reads it once.
    build(parameters): gives a function from a batch of inputs to a batch of outputs."""
    spark.sparkContext.addFile(path)
    name = path.rpartition("/")[2]

    @F.pandas_udf(returns)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(SparkFiles.get(name)) as f:
            model = build(json.load(f))
        for batch in batches:
            yield model(batch)

    return predict


def _pairwise(pixels: Column, previous: Column, number: Column) -> Column:
    change = S.mean_change(pixels, previous)
    shift = lambda lower: S.mean(S.half(pixels, lower)) - S.mean(S.half(previous, lower))
    return F.struct(
        S.heuristic_motion(change, shift(False), shift(True), F.pmod(number, F.lit(2)) == 0).alias("direction"),
        S.rounded(S.heuristic_confidence(change), 2).alias("confidence"),
        S.rounded(change, 1).alias("optical_flow_magnitude"),
    )


def _bands(pixels: Column) -> Column:
    """A stand-in for a trained model: how bright the bands of a frame are."""
    return F.struct(
        S.softmax(S.band_means(pixels, 3, 0.01)).alias("region_probs"), S.softmax(S.band_means(pixels, 4, 0.01)).alias("score_probs")
    )


register("model", "bands", _bands)
register("pairwise", "heuristic", _pairwise)
register("pairwise", "flow", flow_pairwise)
register("classifier", "heuristic", lambda brightness, contrast: S.heuristic_score(brightness, contrast))
register("motion", "heuristic", S.heuristic_motion)
register("motion", "flow", S.flow_motion)
register("region", "heuristic", S.region_by_progress)
