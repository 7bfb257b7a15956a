"""Dense flow gives back known shifts, and tells motion as a plug-in."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import optical_flow as flow
from tidemark.functions import plugins


def texture(side, dx=0.0, dy=0.0, seed=7):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side].astype(float)
    image = np.full((side, side), 128.0)
    for _ in range(8):
        length, turn, phase, height = r.uniform(10, 40), r.uniform(0, 2 * np.pi), r.uniform(0, 2 * np.pi), r.uniform(10, 20)
        image += height * np.sin(2 * np.pi / length * (np.cos(turn) * (x - dx) + np.sin(turn) * (y - dy)) + phase)
    return image


@pytest.mark.parametrize("shift", [(0, 0), (0.5, -0.25), (2.3, -1.6), (4.5, 3.0), (8, -6), (-11, 5)])
@pytest.mark.parametrize("side", [64, 112])
def test_known_shifts_come_back_within_a_tenth_of_a_pixel(side, shift):
    found = flow.dense(texture(side), texture(side, *shift))
    inner = found[:, 10:-10, 10:-10]
    assert np.abs(inner.mean((1, 2)) - shift).max() < 0.1
    assert np.median(np.abs(inner - np.reshape(shift, (2, 1, 1)))) < 0.1


def test_brightness_alone_is_no_motion_and_flat_frames_stand_still():
    assert np.abs(flow.dense(texture(64), texture(64) + 20)).max() < 0.2
    assert np.abs(flow.dense(np.full((40, 40), 9.0), np.full((40, 40), 200.0))).max() < 1e-9
    with pytest.raises(ValueError, match="shapes"):
        flow.dense(texture(64), texture(40))


def test_parts_that_move_apart():
    before, after = texture(96), texture(96, 2, 0)
    after[:, :48] = texture(96, -2, 0)[:, :48]
    found = flow.dense(before, after)
    assert abs(found[0, 20:-20, 10:30].mean() + 2) < 0.2 and abs(found[0, 20:-20, -30:-10].mean() - 2) < 0.2


def test_polynomials_are_recovered():
    y, x = np.mgrid[:30, :30].astype(float)
    image = 3 + 2 * x - y + 0.5 * x * x + 0.25 * y * y - 0.3 * x * y
    bx, by, axx, ayy, axy = flow.expansion(image)[:, 15, 14]
    assert np.allclose([axx, ayy, axy], [0.5, 0.25, -0.15])
    assert np.allclose([bx, by], [2 + 14 - 0.3 * 15, -1 + 0.5 * 15 - 0.3 * 14])


def test_frames_of_colours_are_greyed():
    grey = texture(8)
    colour = np.repeat(grey.ravel(), 3)
    assert np.allclose(flow.grey(colour), grey) and np.allclose(flow.grey(grey.ravel()), grey)
    with pytest.raises(ValueError, match="no square frame"):
        flow.grey(np.zeros(7))


def test_plugin_tells_directions(spark):
    shifts = {"down": (0, 4), "up": (0.5, -3), "aside": (4, 0.2), "still": (0.2, 0.1), "first": None}
    rows = [(k, texture(48).ravel().tolist() if s else None, texture(48, *(s or (0, 0))).ravel().tolist()) for k, s in shifts.items()]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "previous", "pixels"]), "k string, previous array<double>, pixels array<double>")
    found = plugins.plugin("pairwise", "flow")(F.col("pixels"), F.col("previous"), F.lit(1))
    got = {r.k: r.m for r in df.select("k", F.when(F.col("previous").isNotNull(), found).alias("m")).collect()}
    assert {k: m.direction for k, m in got.items() if m} == {"down": "insertion", "up": "withdrawal", "aside": "stationary", "still": "stationary"}
    assert got["first"] is None and abs(got["down"].optical_flow_magnitude - 4) < 0.2 and got["aside"].confidence == 0.5
    assert 0.9 <= got["still"].confidence <= 0.95 and got["down"].confidence == 0.95
