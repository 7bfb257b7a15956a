"""A run's loss doesn't follow the order of its batches, and halves are rounded up."""

import math
from fractions import Fraction

import pandas as pd
import pytest

from tidemark.operators import training
from tidemark.plans import catalog

# runs whose mean loss is an odd number of half millionths: sums of doubles, in this order or backwards, lie below it
RUNS = [
    [(0.09, 33.0), (0.06, 19.0), (0.07, 30.0), (0.03, 14.0)],
    [(0.07, 11.0), (0.07, 41.0), (0.01, 5.0), (0.07, 7.0)],
    [(0.08, 37.0), (0.03, 30.0), (0.05, 49.0), (0.06, 35.0), (0.08, 9.0)],
    [(0.08, 7.0), (0.04, 33.0), (0.0, 16.0), (0.03, 43.0), (0.06, 17.0), (0.0, 44.0)],
]


def exact_ppm(rows) -> int:
    mean = sum(Fraction(str(a)) * Fraction(b) for a, b in rows) / sum(Fraction(b) for _, b in rows)
    return math.floor(mean * 1_000_000 + Fraction(1, 2))


@pytest.mark.parametrize("step", [1, -1])
def test_halves_are_rounded_up_in_any_order(spark, tmp_path, step):
    lines = [(k, a, b, 1) for k, rows in enumerate(RUNS) for a, b in rows[::step]]
    pd.DataFrame(lines, columns=["l_suppkey", "l_discount", "l_quantity", "l_linenumber"]).to_parquet(tmp_path / "lineitem.parquet")
    got = {r.run: r.loss_ppm for r in catalog.QUERIES["epoch_metrics"](spark, str(tmp_path)).collect()}
    assert got == {k: exact_ppm(rows) for k, rows in enumerate(RUNS)}


def test_other_losses_are_added_as_doubles(spark):
    """Losses and sizes of more decimals, too large ones, unknown and diverged ones keep their values."""
    runs = {
        "fine": [(1 / 3, 3.0), (2 / 3, 1.5)], "large": [(2.5e12, 4.0), (0.5, 4.0)], "parts": [(0.5, 0.125), (0.25, 0.375)],
        "unknown": [(0.5, 2.0), (None, 2.0)], "diverged": [(float("nan"), 2.0), (0.5, 2.0)], "none": [(None, 2.0)], "below": [(-0.5, 3.0)],
    }
    rows = [(k, a, b, 1) for k, pairs in runs.items() for a, b in pairs]
    df = spark.createDataFrame(rows, "run string, loss double, size double, correct int")
    got = {r.run: r for r in training.epoch_metrics(df, ["run"]).collect()}
    want = {"fine": 2 / 4.5, "large": (1e13 + 2) / 8, "parts": 0.15625 / 0.5, "unknown": 0.25, "below": -0.5}
    assert {k: got[k].loss for k in want} == pytest.approx(want, rel=1e-14)
    assert math.isnan(got["diverged"].loss) and got["none"].loss is None
    assert {k: r.accuracy for k, r in got.items()} == pytest.approx({k: len(p) / sum(b for _, b in p) for k, p in runs.items()})


def test_whole_sizes_are_known_as_longs(spark):
    df = spark.createDataFrame([("a", 0.5, 32, 8), ("a", 0.25, 32, 32)], "run string, loss double, size bigint, correct bigint")
    assert tuple(training.epoch_metrics(df, ["run"]).first()) == ("a", 0.375, 0.625)
