"""Set operations on keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def appended(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def difference(a: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is in none of the others."""
    for b in others:
        a = a.join(b.select(key), key, "left_anti")
    return a


def distinct_keys(a: DataFrame, *keys: str) -> DataFrame:
    return a.select(*keys).dropDuplicates()


def toggled(chosen: DataFrame, flipped: DataFrame, key: str) -> DataFrame:
    """The symmetric difference, in one shuffle."""
    both = chosen.select(key).distinct().unionByName(flipped.select(key).distinct())
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(key)


def removed(a: DataFrame, key: str, value) -> DataFrame:
    return a.where(~F.col(key).eqNullSafe(F.lit(value)))


def members(a: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return a.join(ids.select(key).distinct(), key, "left_semi")


def at_positions(a: DataFrame, positions: DataFrame, ordinal: str) -> DataFrame:
    """Rows whose ordinal is listed."""
    return members(a, positions, ordinal)


def zipped(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """Two sequences side by side, by position; the shorter one ends it."""
    return a.join(b, ordinal)
