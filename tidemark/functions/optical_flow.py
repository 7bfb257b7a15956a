"""Dense optical flow by polynomial expansion (Farnebäck 2003), on image pyramids.

Around each pixel the image is approximated by x'Ax + b'x + c, with Gaussian weights. Where the
next image is the same one moved by d, A stays and b changes by -2Ad; so d solves a least-squares
problem over a window. Coarse levels of a pyramid find large displacements, which finer ones refine.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import scalars as S

# The flow's parameters, and the weights of red, green and blue in grey.
LEVELS, SCALE, WINDOW, ITERATIONS, REACH, SIGMA = 3, 0.5, 15, 3, 5, 1.2
GREY = (0.299, 0.587, 0.114)
#: Levels with a shorter side than this are left out.
LEAST_SIDE = 16
STATISTICS = StructType([StructField(c, DoubleType()) for c in ("magnitude", "horizontal", "vertical")])
#: Filters go over so many columns or rows at once, as one product of matrices.
BLOCK = 64
#: Pairs of frames go through together, of so many pixels in all, which fit a core's cache.
PIXELS = 1 << 15


@lru_cache(64)
def _bands(taps: tuple[float, ...], n: int, edge: bool) -> list[tuple[slice, np.ndarray]]:
    """A correlation over n places, the edge continued or nothing beyond it: for BLOCK places at a time,
    those that they are made of, and the matrix."""
    reach, out = len(taps) // 2, []
    for k in range(0, n, BLOCK):
        here, near = np.arange(k, min(n, k + BLOCK)), slice(max(0, k - reach), min(n, k + BLOCK + reach))
        matrix = np.zeros((near.stop - near.start, len(here)))
        for j, t in enumerate(taps):
            source = here + j - reach
            inside = edge | (source >= 0) & (source < n)
            np.add.at(matrix, (np.clip(source, 0, n - 1)[inside] - near.start, here[inside] - k), t)
        out.append((near, matrix))
    return out


def _along(fields: np.ndarray, taps: np.ndarray | tuple[float, ...], axis: int, edge: bool = True) -> np.ndarray:
    """Correlation along the last axis or the one before, the edge pixels continued (or not)."""
    bands = _bands(tuple(map(float, taps)), fields.shape[axis], edge)
    out = [fields[..., near] @ matrix if axis == -1 else matrix.T @ fields[..., near, :] for near, matrix in bands]
    return out[0] if len(out) == 1 else np.concatenate(out, axis)


@lru_cache
def _basis(reach: int, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """The weighted taps for 1, x and x^2, and what turns the six correlations into coefficients."""
    x = np.arange(-reach, reach + 1, dtype=float)
    w = np.exp(-(x**2) / (2 * sigma**2))
    w /= w.sum()
    taps = np.stack([w, w * x, w * x * x])
    weight = np.outer(w, w)
    gy, gx = np.meshgrid(x, x, indexing="ij")
    functions = np.stack([np.ones_like(gx), gx, gy, gx * gx, gy * gy, gx * gy]).reshape(6, -1)
    return taps, np.linalg.inv((functions * weight.ravel()) @ functions.T)


def expansion(image: np.ndarray, reach: int = REACH, sigma: float = SIGMA) -> np.ndarray:
    """(5, ..., height, width): b's two parts, and A's xx, yy and xy."""
    taps, inverse = _basis(reach, sigma)
    rows = [_along(image, t, -1) for t in taps]  # along x
    moments = np.stack([
        _along(rows[0], taps[0], -2), _along(rows[1], taps[0], -2), _along(rows[0], taps[1], -2),
        _along(rows[2], taps[0], -2), _along(rows[0], taps[2], -2), _along(rows[1], taps[1], -2),
    ])
    inverse = inverse[1:] * np.array([1, 1, 1, 1, 0.5])[:, None]
    return (inverse @ moments.reshape(6, -1)).reshape(5, *image.shape)


def _between(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For places on an axis of n pixels: the pixels around them, and how far from the first; those outside are at the edge."""
    x = np.minimum(np.maximum(x, 0), n - 1)
    first = np.minimum(x.astype(int), max(n - 2, 0))
    return first, np.minimum(first + 1, n - 1), x - first


def _mixed(a: np.ndarray, b: np.ndarray, share: np.ndarray) -> np.ndarray:
    """a + share * (b - a), in the place of b."""
    b -= a
    b *= share
    b += a
    return b


def _sampled(fields: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fields (c, ..., height, width) at places between pixels, other ones in each image (..., height, width), bilinear;
    places outside take the edge's value."""
    height, width = fields.shape[-2:]
    (x0, x1, u), (y0, y1, v) = _between(x, width), _between(y, height)
    images = fields.shape[1:-2]
    start = (np.arange(int(np.prod(images))) * (height * width)).reshape(*images, 1, 1)
    flat, upper, lower = fields.reshape(len(fields), -1), start + y0 * width, start + y1 * width
    at = lambda k: np.take(flat, k, axis=1)
    return _mixed(_mixed(at(upper + x0), at(upper + x1), u), _mixed(at(lower + x0), at(lower + x1), u), v)


def resized(fields: np.ndarray, height: int, width: int) -> np.ndarray:
    """Fields (..., height, width) with other numbers of pixels, bilinear."""
    y0, y1, v = _between((np.arange(height) + 0.5) * fields.shape[-2] / height - 0.5, fields.shape[-2])
    x0, x1, u = _between((np.arange(width) + 0.5) * fields.shape[-1] / width - 0.5, fields.shape[-1])
    columns, v = (1 - u) * fields[..., x0] + u * fields[..., x1], v[:, None]
    return (1 - v) * columns[..., y0, :] + v * columns[..., y1, :]


def _summed(fields: np.ndarray, window: int) -> np.ndarray:
    """Sums over a square window; fewer pixels at the edges."""
    ones = (1.0,) * (window // 2 * 2 + 1)
    return _along(_along(fields, ones, -1, edge=False), ones, -2, edge=False)


def _refined(first: np.ndarray, second: np.ndarray, flow: np.ndarray, window: int) -> np.ndarray:
    height, width = first.shape[-2:]
    y, x = np.mgrid[:height, :width].astype(float)
    to_x, to_y = x + flow[0], y + flow[1]
    inside = ((to_x >= 0) & (to_x <= width - 1) & (to_y >= 0) & (to_y <= height - 1)).astype(float)
    moved = _sampled(second, to_x, to_y)
    axx, ayy, axy = (first[2:] + moved[2:]) / 2
    bx = (first[0] - moved[0]) / 2 + axx * flow[0] + axy * flow[1]
    by = (first[1] - moved[1]) / 2 + axy * flow[0] + ayy * flow[1]
    g11, g12, g22, h1, h2 = _summed(
        inside * np.stack([axx * axx + axy * axy, axy * (axx + ayy), ayy * ayy + axy * axy, axx * bx + axy * by, axy * bx + ayy * by]), window
    )
    # flat places have no motion of their own: a little weight keeps them at what is known
    weight = 1e-3 + 1e-6 * (g11 + g22)
    g11, g22, h1, h2 = g11 + weight, g22 + weight, h1 + weight * flow[0], h2 + weight * flow[1]
    det = g11 * g22 - g12 * g12
    return np.stack([(g22 * h1 - g12 * h2) / det, (g11 * h2 - g12 * h1) / det])


def dense(before: np.ndarray, after: np.ndarray, levels: int = LEVELS, window: int = WINDOW, iterations: int = ITERATIONS) -> np.ndarray:
    """(2, ..., height, width): how far each pixel moves right and down, from one grey image to the next;
    images (height, width), or several pairs of one size at once (pairs, height, width)."""
    if before.shape != after.shape or before.ndim < 2:
        raise ValueError(f"images of shapes {before.shape} and {after.shape}")
    pyramid = [np.stack([before, after]).astype(float)]
    if not np.isfinite(pyramid[0]).all():
        raise ValueError("pixels that are no numbers")
    while len(pyramid) < levels and min(pyramid[-1].shape[-2:]) * SCALE >= LEAST_SIDE:
        last = pyramid[-1]
        taps = np.array([1.0, 4.0, 6.0, 4.0, 1.0]) / 16
        smooth = _along(_along(last, taps, -1), taps, -2)
        pyramid.append(resized(smooth, max(1, round(last.shape[-2] * SCALE)), max(1, round(last.shape[-1] * SCALE))))
    flow = np.zeros((2, *pyramid[-1].shape[1:]))
    for images in reversed(pyramid):
        height, width = images.shape[-2:]
        ratio = np.array([width / flow.shape[-1], height / flow.shape[-2]]).reshape(2, *[1] * (flow.ndim - 1))
        flow = resized(flow, height, width) * ratio
        first, second = expansion(images[0]), expansion(images[1])
        for _ in range(iterations):
            flow = _refined(first, second, flow, window)
    return flow


def grey(pixels: np.ndarray) -> np.ndarray:
    """Square frames (..., values) of grey values, or of red, green and blue ones in turn, as images."""
    x = np.asarray(pixels, float)
    *frames, n = x.shape
    for channels in (1, 3):
        side = isqrt(n // channels)
        if side and side * side * channels == n:
            return x.reshape(*frames, side, side) if channels == 1 else x.reshape(*frames, side, side, 3) @ GREY
    raise ValueError(f"{n} values are no square frame")


def statistics(before: np.ndarray, after: np.ndarray, margin: int) -> np.ndarray:
    """(pairs, 3): means of magnitude, horizontal and vertical part over the flow of pairs of frames (pairs, values),
    ``margin`` pixels of their edge left out."""
    a, b = grey(before), grey(after)
    if a.shape != b.shape:
        raise ValueError(f"images of shapes {a.shape[1:]} and {b.shape[1:]}")
    step, least = max(1, PIXELS // max(1, a[0].size)), min(a.shape[1:])
    m = min(margin, (least - 1) // 2)
    out = []
    for k in range(0, len(a), step):
        dx, dy = dense(a[k : k + step], b[k : k + step])[..., m : a.shape[1] - m, m : a.shape[2] - m]
        out.append(np.stack([x.mean((-2, -1)) for x in (np.hypot(dx, dy), dx, dy)], 1))
    return np.concatenate(out)


@F.pandas_udf(STATISTICS)
def flow_statistics(before: pd.Series, after: pd.Series, margin: pd.Series) -> pd.DataFrame:
    """Means over a frame's flow, ``margin`` pixels of its edge left out; null without a frame before."""
    alike = defaultdict(list)
    for k, (a, b, m) in enumerate(zip(before, after, margin, strict=True)):
        if a is not None and b is not None:
            alike[len(a), len(b), int(m)].append(k)
    out = np.full((len(before), 3), None, object)
    for (a, b, m), rows in alike.items():
        step = max(1, PIXELS // max(1, a))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            out[some] = statistics(*(np.stack([np.asarray(frames.iloc[r], float) for r in some]) for frames in (before, after)), m)
    return pd.DataFrame(out, columns=["magnitude", "horizontal", "vertical"], dtype=float)


def flow_pairwise(pixels: Column, previous: Column, number: Column) -> Column:
    """A pairwise plug-in: direction, confidence and magnitude by dense flow."""
    found = flow_statistics(previous, pixels, F.lit(0))
    motion = S.flow_motion(found["magnitude"], found["vertical"])
    return F.struct(
        motion["direction"].alias("direction"), S.rounded(motion["confidence"], 2).alias("confidence"),
        S.rounded(found["magnitude"], 2).alias("optical_flow_magnitude"),
    )
