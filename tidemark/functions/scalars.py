"""Scalar rules as column expressions; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, descriptions, regions in anatomical order, and media types.
LABELS = {0: "Poor", 1: "Inadequate", 2: "Adequate", 3: "Excellent"}
DESCRIPTIONS = {
    0: "Substantial fluid/content completely obscuring evaluation",
    1: "Substantial opaque fluid/content, some parts not evaluable",
    2: "Small amount of hazy fluid/foam, most mucosa visible",
    3: "Clean mucosa or minor transparent fluid, no impediment",
}
REGIONS = ["esophagus", "stomach", "duodenum"]
MEDIA_TYPES = {".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo", ".mkv": "video/x-matroska"}
MAX_UPLOAD_BYTES = 500 * 1024 * 1024
IMAGENET = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def rounded(x: Column, digits: int) -> Column:
    """Half up on the binary value, like floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def label(score: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in LABELS.values())), score.cast("int"))


def described(score: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in DESCRIPTIONS.values())), score.cast("int"))


# --- names and paths


def class_dir(name: Column) -> Column:
    """``region_score`` at the last underscore; null for what doesn't parse."""
    region = F.regexp_extract(name, r"^(.*)_([^_]*)$", 1)
    score = F.regexp_extract(name, r"^(.*)_([^_]*)$", 2).try_cast("int")
    return F.when(region.isin(*REGIONS) & score.between(0, 3), F.struct(region.alias("region"), score.alias("score")))


def video_id(name: Column) -> Column:
    found = F.regexp_extract(name, r"^[a-z]+_\d+_(.+)_frame\d+\.jpg", 1)
    return F.when(found != "", found).otherwise(name)


def frame_number(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"frame(\d+)", 1).try_cast("bigint"), F.lit(0))


def extension(name: Column, default: str = ".mp4") -> Column:
    found = F.regexp_extract(name, r"\.\w+$", 0)
    return F.when(found == "", F.lit(default)).otherwise(found)


def media_type(name: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(MEDIA_TYPES), F.lower(extension(name))), F.lit("video/mp4"))


def is_live(analysis_id: Column) -> Column:
    return analysis_id.startswith("live_")


def socket_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^https:", "wss:"), "^http:", "ws:")


def id_list(text: Column) -> Column:
    """Numbers of a comma-separated text; others are dropped."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.filter(parts, lambda x: x.isNotNull())


# --- display


def duration_text(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def timestamp_text(seconds: Column) -> Column:
    """m:ss.f; tenths are rounded within the minute, so 59.96 gives 0:60.0."""
    minute = F.floor(seconds / 60)
    tenths = F.floor((seconds - minute * 60) * 10 + 0.5)
    return F.format_string("%d:%02d.%d", minute, F.floor(tenths / 10), tenths % 10)


def percent_text(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def size_text(n: Column) -> Column:
    def tenths(unit: int) -> Column:
        t = F.floor(n * 10 / unit + 0.5)
        return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))

    kb, mb, gb = 1 << 10, 1 << 20, 1 << 30
    return (
        F.when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < mb, F.concat(tenths(kb), F.lit(" KB")))
        .when(n < gb, F.concat(tenths(mb), F.lit(" MB")))
        .otherwise(F.concat(tenths(gb), F.lit(" GB")))
    )


# --- numbers


def clamped(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def frame_seconds(index: Column, fps: Column) -> Column:
    return F.when(fps > 0, rounded(index / fps, 2)).otherwise(F.lit(0.0))


def sampling_interval(fps: Column, rate: float = 2.0) -> Column:
    return F.greatest(F.lit(1), F.floor(fps / rate)).cast("bigint")


def bucket(seconds: Column, width: float = 0.5) -> Column:
    return F.floor(seconds / width)


def poll_delay(base: Column, step: Column, cap) -> Column:
    """The wait after ``step`` polls without news."""
    return F.least(base * F.pow(F.lit(1.5), step), F.lit(cap).cast("double"))


def drift(step: Column) -> Column:
    """p += (0.5 - p) * 0.08 from 0.4, in closed form."""
    return F.lit(0.5) - F.lit(0.1) * F.pow(F.lit(0.92), step)


def overall_progress(state: Column, part: Column) -> Column:
    return (
        F.when(state == "uploading", part * 0.4)
        .when(state == "queued", 0.4 + part * 0.1)
        .when(state == "processing", 0.5 + part * 0.5)
        .when(state == "completed", F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def cosine_rate(step: Column, base: float, warmup: int, epochs: int, least: float = 1e-6) -> Column:
    """The rate after ``step`` epochs: a cosine from base over all epochs; when the
    warm-up is over, a new one from a tenth of base over the rest."""

    def half_wave(top: float, t: Column, n: int) -> Column:
        return least + (top - least) * (1 + F.cos(3.141592653589793 * t / n)) / 2

    return F.when(step < warmup, half_wave(base, step, epochs)).otherwise(
        half_wave(base * 0.1, step - warmup, epochs - warmup)
    )


def usage_percent(count: Column, limit: Column) -> Column:
    return (
        F.when(limit == -1, F.lit(0.0))
        .when(limit == 0, F.lit(100.0))
        .otherwise(F.least(F.lit(100.0), 100.0 * count / limit))
    )


def usage_band(percent: Column) -> Column:
    return F.when(percent >= 100, "full").when(percent >= 80, "high").otherwise("ok")


def quality_band(x: Column) -> Column:
    return F.when(x.isNull(), "not visited").when(x >= 0.8, "good").when(x >= 0.6, "fair").otherwise("poor")


def or_default(x: Column, default) -> Column:
    """Like ``||``: null, zero and the empty text give way."""
    return F.when(x.isNull() | (x.cast("string").isin("", "0", "0.0")), F.lit(default)).otherwise(x)


# --- arrays


def softmax(logits: Column) -> Column:
    def shares(e: Column) -> Column:
        return F.transform(e[0], lambda x: x / e[1])

    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.array(powers), lambda p: F.transform(p, lambda x: x / total(p)))[0]


def argmax(values: Column) -> Column:
    """The first position of the greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def band_means(values: Column, bands: int, scale: float = 1.0) -> Column:
    """The means of equal bands, what is over left out, times ``scale``."""
    n = (F.size(values) / bands).cast("int")
    return F.array(*(mean(F.slice(values, n * k + 1, n)) * scale for k in range(bands)))


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    return F.transform(
        F.array(mean(values)), lambda m: F.sqrt(total(F.transform(values, lambda x: (x - m) * (x - m))) / F.size(values))
    )[0]


def mean_change(a: Column, b: Column) -> Column:
    return mean(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def half(values: Column, lower: bool) -> Column:
    n = (F.size(values) / 2).cast("int")
    return F.slice(values, n + 1, n) if lower else F.slice(values, F.lit(1), n)


def flow(dx: Column, dy: Column) -> Column:
    """Mean magnitude, mean vertical part and their ratio of a flow field."""
    magnitude = mean(F.zip_with(dx, dy, lambda x, y: F.hypot(x, y)))
    return F.struct(
        magnitude.alias("magnitude"), mean(dy).alias("vertical"), (mean(dy) / (magnitude + 1e-6)).alias("ratio")
    )


def normalised(pixels: Column, channel: int) -> Column:
    m, s = IMAGENET[0][channel], IMAGENET[1][channel]
    return F.transform(pixels, lambda x: (x / 255.0 - m) / s)


def cross_entropy(probabilities: Column, target: Column, weight: Column, smoothing: float = 0.1) -> Column:
    """Weighted, with label smoothing."""
    k = F.size(probabilities)
    picked = -F.ln(F.get(probabilities, target))
    spread = total(F.transform(probabilities, lambda p: -F.ln(p))) / k
    return weight * ((1 - smoothing) * picked + smoothing * spread)


def two_head_loss(region: Column, score: Column, weights: tuple[float, float] = (1.0, 1.0)) -> Column:
    """The weighted sum of a model's two losses."""
    return weights[0] * region + weights[1] * score


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two times, to one decimal."""
    return rounded((F.unix_micros(end) - F.unix_micros(start)) / 1000, 1)


# --- frame rules; their thresholds are fixed values


def heuristic_score(brightness: Column, contrast: Column, limits=((50, 20), (100, 40)), bright=170) -> Column:
    """Darker or flatter than a pair of limits gives 0 and 1; not bright, 2; else 3."""
    (b0, c0), (b1, c1) = limits
    return (
        F.when((brightness < b0) | (contrast < c0), 0)
        .when((brightness < b1) | (contrast < c1), 1)
        .when(brightness < bright, 2)
        .otherwise(3)
    )


def heuristic_motion(change: Column, top: Column, lower: Column, coin: Column, margin: float = 2) -> Column:
    """change: mean absolute difference; top, lower: mean shift of either half of the
    frame; coin: decides where neither half leads."""
    return (
        F.when(change < 30, "stationary")
        .when(lower > top + margin, "insertion")
        .when(top > lower + margin, "withdrawal")
        .otherwise(F.when(coin, "insertion").otherwise("withdrawal"))
    )


def heuristic_confidence(change: Column) -> Column:
    return F.least(F.lit(0.95), 0.5 + change / 100)


def flow_motion(magnitude: Column, vertical: Column) -> Column:
    ratio = vertical / (magnitude + 1e-6)
    return (
        F.when(
            magnitude < 1.5,
            F.struct(
                F.lit("stationary").alias("direction"),
                F.least(F.lit(0.95), 0.7 + (1.5 - magnitude) / 1.5 * 0.25).alias("confidence"),
            ),
        )
        .when(F.abs(ratio) < 0.4, F.struct(F.lit("stationary").alias("direction"), F.lit(0.5).alias("confidence")))
        .otherwise(
            F.struct(
                F.when(ratio > 0, "insertion").otherwise("withdrawal").alias("direction"),
                F.least(F.lit(0.95), 0.5 + F.abs(ratio)).alias("confidence"),
            )
        )
    )


def region_by_progress(at: Column, duration: Column) -> Column:
    done = at / F.nullif(duration, F.lit(0))
    return (
        F.when(duration.isNull() | (duration <= 0), "stomach")
        .when(done < 0.2, "esophagus")
        .when(done < 0.7, "stomach")
        .otherwise("duodenum")
    )


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
