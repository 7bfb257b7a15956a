"""Ordered logic within a video: segments, smoothing, nearest entries.

All windows of one frame table share its key, so Spark sorts and shuffles once.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

BY, ORDER = "analysis_id", "frame_index"


def _order(by: str = BY, order: str = ORDER):
    return Window.partitionBy(by).orderBy(order)


def motion_segments(frames: DataFrame, at: str = "timestamp") -> DataFrame:
    """Runs of one direction. A run ends where the next one begins; its confidence
    is the mean over the five frames before that point, whatever their run, with
    missing motion as zero; the last run has the constant 85 percent.

    Columns: analysis_id, segment, start, end, direction, confidence (percent)."""
    w = _order()
    ordinal = F.row_number().over(w) - 1
    direction = F.coalesce("direction", F.lit("stationary"))
    recent = F.sum(F.coalesce("conf_pct", F.lit(0))).over(w.rowsBetween(-5, -1))
    marked = frames.withColumn("_direction", direction).withColumns({
        "_i": ordinal,
        "_recent": recent,
        "_last_at": F.max(at).over(Window.partitionBy(BY)),
        "_starts": F.coalesce(F.lag("_direction").over(w) != F.col("_direction"), F.lit(True)),
    })
    starts = marked.where("_starts")
    nxt = lambda c: F.lead(c).over(w)
    confidence = S.rounded(nxt("_recent") / F.least(F.lit(5), nxt("_i")), 0)
    return starts.select(
        BY,
        (F.row_number().over(w) - 1).cast("bigint").alias("segment"),
        F.col(at).alias("start_time"),
        F.coalesce(nxt(at), F.col("_last_at")).alias("end_time"),
        F.col("_direction").alias("direction"),
        F.coalesce(confidence, F.lit(85)).cast("bigint").alias("confidence"),
    )


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Gaps and islands: (by, run, value, first, last, n)."""
    w = _order(by, order)
    change = F.coalesce(F.lag(value).over(w).eqNullSafe(F.col(value)), F.lit(False))
    first = F.row_number().over(w) == 1
    marked = rows.withColumn("_new", F.when(first | ~change, 1).otherwise(0))
    numbered = marked.withColumn("run", F.sum("_new").over(w) - 1)
    return numbered.groupBy(by, "run", value).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")
    )


def consensus(frames: DataFrame, size: int = 3, least: int = 60) -> DataFrame:
    """A direction holds where the last ``size`` frames all have it, moving and with
    ``least`` percent confidence; elsewhere the scope counts as stationary."""
    w = _order().rowsBetween(1 - size, 0)
    agree = (
        (F.count(F.lit(1)).over(w) == size)
        & (F.min("direction").over(w) == F.max("direction").over(w))
        & (F.min("conf_pct").over(w) >= least)
        & (F.col("direction") != "stationary")
    )
    return frames.withColumn("consensus", F.when(agree, F.col("direction")).otherwise("stationary"))


def smoothed(frames: DataFrame, values: str, alpha: float = 0.3, to: str = "smoothed", by: str = BY) -> DataFrame:
    """Exponential averages of array values: s = alpha x + (1 - alpha) s, from the
    first x. What lies further back than ``reach`` frames weighs less than a
    double's last bit, so a bounded window gives the same numbers, and no video
    is gathered whole."""
    reach = ceil(log(1e-18) / log(1 - alpha))
    w = _order(by).rowsBetween(-reach, 0)
    step = lambda s, x: F.zip_with(s, x, lambda a, b: alpha * b + (1 - alpha) * a)
    seen = F.collect_list(values).over(w)
    return frames.withColumn("_seen", seen).withColumn(
        to, F.aggregate(F.slice("_seen", F.lit(2), F.size("_seen")), F.get("_seen", F.lit(0)), step)
    ).drop("_seen")


def nearest(entries: DataFrame, cursors: DataFrame, at: str = "t_us") -> DataFrame:
    """For each cursor (analysis_id, cursor, ``at``) the entry that is nearest in
    time; of two equally near ones the earlier. Both sides are laid in one order, so
    a video is sorted once and no pairs are formed."""
    one = entries.groupBy(BY, at).agg(F.min(ORDER).alias("_entry"))
    both = one.select(BY, at, "_entry", F.lit(None).cast("bigint").alias("cursor")).unionByName(
        cursors.select(BY, at, F.lit(None).cast("bigint").alias("_entry"), F.col("cursor").cast("bigint"))
    )
    found = F.when(F.col("_entry").isNotNull(), F.struct(F.col(at).alias("at"), F.col("_entry").alias("i")))
    # range frames: entries at the cursor's own time count, wherever they stand; both
    # grow from their start, as frames that shrink are worked out anew for each row
    latest = F.last(found, ignorenulls=True)
    w = Window.partitionBy(BY)
    before = latest.over(w.orderBy(F.col(at).asc()).rangeBetween(Window.unboundedPreceding, 0))
    after = latest.over(w.orderBy(F.col(at).desc()).rangeBetween(Window.unboundedPreceding, 0))
    t = F.col(at)
    laid = both.withColumns({"_before": before, "_after": after}).where("cursor IS NOT NULL")
    nearer = F.when(
        F.col("_after").isNull() | (t - F.col("_before.at") <= F.col("_after.at") - t), F.col("_before")
    ).otherwise(F.col("_after"))
    return laid.withColumn("_pick", F.coalesce(nearer, F.col("_after"))).select(
        BY, "cursor", at, F.col("_pick.i").alias(ORDER), F.col("_pick.at").alias("entry_at")
    )


def last_entry(rows: DataFrame, *columns: str, by: str = BY, order: str = ORDER) -> DataFrame:
    """Each series' latest row."""
    return rows.groupBy(by).agg(*(F.max_by(c, order).alias(c) for c in columns))


def stepped(rows: DataFrame, step: int) -> DataFrame:
    """Each frame's neighbour ``step`` frames on, held at the ends."""
    w = _order()
    ends = Window.partitionBy(BY)
    to = (F.lead if step > 0 else F.lag)(ORDER, abs(step)).over(w)
    end = (F.max if step > 0 else F.min)(ORDER).over(ends)
    return rows.withColumn("target", F.coalesce(to, end))


def held(rows: DataFrame, value: str, at: str, by: str = BY, order: str = ORDER) -> DataFrame:
    """Step-after series: the last known value, and how long it holds."""
    w = _order(by, order)
    return rows.withColumns({
        "held": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "until": F.coalesce(F.lead(at).over(w), F.col(at)),
    })


def first_per_bucket(rows: DataFrame, bucket: Column, order: str = ORDER, by: str = BY) -> DataFrame:
    """The first row of each bucket of video time."""
    others = [c for c in rows.columns if c not in (by, order)]
    return rows.withColumn("bucket", bucket).groupBy(by, "bucket").agg(
        F.min(order).alias(order), *(F.min_by(c, order).alias(c) for c in others)
    )
