"""Splits without leakage, and metrics of training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import numbered


def shuffle_key(number: Column, seed: int) -> Column:
    """A multiplicative hash: any engine works out the same order."""
    return F.pmod(number.cast("bigint") * 2654435761 + seed, F.lit(4294967296))


def _ranked_groups(samples: DataFrame, group: str, seed: int) -> tuple[DataFrame, int]:
    """(group, rank) in shuffled order, and the number of groups."""
    groups, _ = numbered(samples.select(group).distinct(), group, to="_ordinal")
    return numbered(groups.select(group, shuffle_key(F.col("_ordinal"), seed).alias("_key")), "_key", group)


def group_split(samples: DataFrame, group: str, test: float = 0.2, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``split``: whole groups go to test, then to val, the rest to train."""
    ranked, n = _ranked_groups(samples, group, seed)
    n_test, n_val = (max(1, int(n * share)) for share in (test, val))
    split = (
        F.when(F.col("_rank") < n_test, "test").when(F.col("_rank") < n_test + n_val, "val").otherwise("train")
    )
    return samples.join(ranked.select(group, split.alias("split")), group)


def kfold(samples: DataFrame, group: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``fold``: a group's position modulo k."""
    ranked, _ = _ranked_groups(samples, group, seed)
    return samples.join(ranked.select(group, (F.col("_rank") % k).cast("int").alias("fold")), group)


def subsampled(samples: DataFrame, group: str, key: str, k: int, epoch: int) -> DataFrame:
    """At most k rows of each group, drawn anew each epoch; smaller groups are whole."""
    w = Window.partitionBy(group).orderBy(shuffle_key(F.col(key), epoch), key)
    return samples.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def class_weights(samples: DataFrame, label: str, classes: int) -> DataFrame:
    """N / (K n_c) for each class; null for a class without samples."""
    spark = samples.sparkSession
    dim = spark.range(classes).select(F.col("id").cast("int").alias(label))
    # a row for each class, whatever labels there are
    counts = samples.where(F.col(label).between(0, classes - 1)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    joined = dim.join(F.broadcast(counts), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.withColumn("weight", F.try_divide(F.sum("n").over(total).cast("double"), F.col("n") * classes))


def epoch_metrics(batches: DataFrame, by: list[str]) -> DataFrame:
    """Sample-weighted loss and accuracy.

    Losses of up to four decimals and sizes of up to two are added up as whole numbers, so
    that no order of the rows changes a last bit; where a group has others, as doubles."""
    loss, size = F.col("loss").cast("double"), F.col("size").cast("double")
    losses, sizes = F.rint(loss * 1e4).try_cast("int"), F.rint(size * 1e2).try_cast("int")  # null if too large
    whole = F.bool_and((losses / F.lit(1e4)).eqNullSafe(loss) & (sizes / F.lit(1e2)).eqNullSafe(size))
    total, weight = F.try_sum(losses.cast("bigint") * sizes), F.when(whole, F.try_sum(sizes)).cast("double")
    return batches.groupBy(*by).agg(
        F.coalesce(total / (weight * 1e4), F.sum(loss * size) / F.sum(size)).alias("loss"),
        (F.sum("correct") / F.coalesce(weight / 1e2, F.sum(size))).alias("accuracy"),
    )


def accuracy(predictions: DataFrame, target: str, predicted: str, by: list[str]) -> DataFrame:
    hit = (F.col(target) == F.col(predicted)).cast("int")
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("correct"), F.avg(hit).alias("accuracy"))


def macro(per_fold: DataFrame, metric: str) -> DataFrame:
    """The mean over folds, each counting alike."""
    return per_fold.agg(F.count(F.lit(1)).alias("folds"), F.avg(metric).alias(metric))


def test_time_augmented(views: DataFrame, sample: str, view: str, logits: str) -> DataFrame:
    """Class of the mean logits over the views, and of the first view alone."""
    means = views.select(sample, F.posexplode(logits).alias("class", "x")).groupBy(sample, "class").agg(F.avg("x").alias("x"))
    best = means.groupBy(sample).agg(F.max_by("class", F.struct("x", -F.col("class"))).alias("region"))
    first = views.groupBy(sample).agg(S.argmax(F.min_by(logits, view)).alias("score"))
    return best.join(first, sample)


def early_stopping(epochs: DataFrame, run: str, epoch: str, loss: str, patience: int) -> DataFrame:
    """For each run the best epoch, the epoch after which it stops, and the best loss:
    an epoch improves if its loss is below all before; after ``patience`` epochs that
    don't, the run is over."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn("_better", F.coalesce(F.col(loss) < before, F.lit(True))).withColumn(
        "_rank", F.row_number().over(w)
    )
    last_better = F.max(F.when(F.col("_better"), F.col("_rank"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    waited = marked.withColumn("_waited", F.col("_rank") - last_better)
    stops = F.min(F.when(F.col("_waited") >= patience, F.col("_rank"))).over(Window.partitionBy(run))
    kept = waited.withColumn("_stop", stops).where(F.col("_stop").isNull() | (F.col("_rank") <= F.col("_stop")))
    return kept.groupBy(run).agg(
        F.max_by(epoch, F.when(F.col("_better"), F.col("_rank"))).alias("best_epoch"),
        F.max_by(epoch, "_rank").alias("last_epoch"),
        F.min(loss).alias("best_loss"),
        F.max(F.col("_stop").isNotNull()).alias("stopped"),
    )
