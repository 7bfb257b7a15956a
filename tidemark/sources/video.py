"""Data sources of video: sampled frames, read by their byte ranges, and files' metadata.

Containers with frames that stand alone need no library: YUV4MPEG (raw frames of one size) and
AVI (an index of offsets; uncompressed or motion JPEG). A file is cut into slices of its sampled
frames; each task reads the header and the index, and then its own frames only. Filters on
``frame_index`` and ``analysis_id`` are pushed down: frames outside are not read. Other containers
are decoded by opencv, and JPEG frames by Pillow or opencv, if the executors have it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)

from ..functions.optical_flow import resized
from ..schemas import VIDEO
from .ranged import Ranged, listed

SCHEMA = (
    "analysis_id string, frame_index bigint, fps double, height int, width int, pixels binary, timestamp double, "
    "total_frames bigint, duration_seconds double, source_height int, source_width int, encoded binary"
)
#: Bytes of a file for each slice.
SLICE = 64 << 20


class Y4M:
    """Raw frames of one size, each after a line of its own."""

    def __init__(self, file: Ranged):
        self.file = file
        line, _, _ = file.at(0, 4096).partition(b"\n")
        tags = {x[:1]: x[1:].decode() for x in line.split(b" ")[1:] if x}
        self.width, self.height = int(tags[b"W"]), int(tags[b"H"])
        a, _, b = tags.get(b"F", "0:1").partition(":")
        self.fps = int(a) / int(b) if int(b or 0) else 0.0
        chroma = tags.get(b"C", "420")
        w2, h2 = (self.width + 1) // 2, (self.height + 1) // 2
        self.planes = {"mono": None, "444": (self.height, self.width), "422": (self.height, w2)}.get(chroma[:4] if chroma == "mono" else chroma[:3], (h2, w2))
        self.length = self.width * self.height + 2 * (self.planes[0] * self.planes[1] if self.planes else 0)
        self.start = len(line) + 1
        # frame lines seldom have parameters; where they do, they are gone through one by one
        each = len(b"FRAME\n") + self.length
        self.places = None
        if (file.size - self.start) % each == 0 and all(file.at(self.start + k * each, 6) == b"FRAME\n" for k in {0, max(0, (file.size - self.start) // each - 1)}):
            self.total, self.each = (file.size - self.start) // each, each
        else:
            self.places, at = [], self.start
            while (head := file.at(at, 256))[:5] == b"FRAME" and b"\n" in head:
                begin = at + head.index(b"\n") + 1
                if begin + self.length > file.size:
                    break
                self.places.append(begin)
                at = begin + self.length
            self.total = len(self.places)

    def place(self, k: int) -> tuple[int, int]:
        return (self.places[k] if self.places is not None else self.start + k * self.each + 6), self.length

    def decoded(self, data: bytes) -> np.ndarray:
        raw, n = np.frombuffer(data, np.uint8).astype(np.float64), self.width * self.height
        y = (raw[:n].reshape(self.height, self.width) - 16) * (255 / 219)
        if self.planes is None:
            rgb = np.stack([y] * 3, -1)
        else:
            h, w = self.planes
            down, across = -(-self.height // h), -(-self.width // w)
            u, v = (
                np.repeat(np.repeat(raw[n + k * h * w : n + (k + 1) * h * w].reshape(h, w), down, 0), across, 1)[: self.height, : self.width] - 128
                for k in (0, 1)
            )
            rgb = np.stack([y + 1.596 * v, y - 0.392 * u - 0.813 * v, y + 2.017 * u], -1)
        return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.uint8)


class AVI:
    """RIFF chunks; the frames' places come from the index, or from the chunks' heads."""

    def __init__(self, file: Ranged):
        self.file, self.places = file, []
        self.width = self.height = self.bits = 0
        self.fps, self.kind, self.stream, index, movies = 0.0, b"", None, None, []
        at = 0
        while at + 12 <= file.size and (head := file.at(at, 12))[:4] == b"RIFF":
            end, inner = at + 8 + struct.unpack("<I", head[4:8])[0], at + 12
            while inner + 8 <= min(end, file.size):
                name, size = struct.unpack("<4sI", file.at(inner, 8))
                kind = file.at(inner + 8, 4) if name == b"LIST" else b""
                if kind == b"hdrl":
                    self._headers(file.at(inner + 12, size - 4))
                elif kind == b"movi":
                    movies.append((inner + 8, inner + 8 + size))
                elif name == b"idx1":
                    index = file.at(inner + 8, size)
                inner += 8 + size + size % 2
            at = end + end % 2
        if self.stream is None:
            raise ValueError("an AVI file without a video stream")
        ids = {f"{self.stream:02d}{x}".encode() for x in ("dc", "db")}
        if index and len(movies) == 1:
            entries = [struct.unpack_from("<4sIII", index, k) for k in range(0, len(index) - 15, 16)]
            own = [(name, place, size) for name, _, place, size in entries if name in ids]
            # places count from the list's name, or from the file's start
            fits = lambda base: all(file.at(base + place, 8) == struct.pack("<4sI", name, size) for name, place, size in {own[0], own[-1]})
            base = movies[0][0] if own and fits(movies[0][0]) else 0
            self.places = [(base + place + 8, size) for _, place, size in own]
        else:
            for begin, end in movies:
                self._walked(begin + 4, min(end, file.size), ids)
        self.total = len(self.places)

    def _headers(self, data: bytes) -> None:
        at, number = 0, -1
        while at + 8 <= len(data):
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":  # its chunks follow
                at += 12
                continue
            body = data[at + 8 : at + 8 + size]
            if name == b"strh":
                number += 1
                if body[:4] == b"vids" and self.stream is None:
                    self.stream = number
                    scale, rate = struct.unpack_from("<II", body, 20)
                    self.fps = rate / scale if scale else 0.0
            elif name == b"strf" and number == self.stream:
                self.width, self.height, _, self.bits = struct.unpack_from("<iiHH", body, 4)
                self.kind = body[16:20]
            at += 8 + size + size % 2

    def _walked(self, at: int, end: int, ids: set[bytes]) -> None:
        while at + 8 <= end:
            name, size = struct.unpack("<4sI", self.file.at(at, 8))
            if name == b"LIST":  # a group of chunks
                at += 12
                continue
            if name in ids:
                self.places.append((at + 8, size))
            at += 8 + size + size % 2

    def place(self, k: int) -> tuple[int, int]:
        return self.places[k]

    def decoded(self, data: bytes) -> np.ndarray:
        if self.kind == b"\0\0\0\0" and self.bits == 24:
            row = (3 * self.width + 3) // 4 * 4
            image = np.frombuffer(data, np.uint8).reshape(abs(self.height), row)[:, : 3 * self.width].reshape(abs(self.height), self.width, 3)
            return image[:: -1 if self.height > 0 else 1, :, ::-1]
        return jpeg(data)


def jpeg(data: bytes) -> np.ndarray:
    try:
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except ImportError:
        pass
    try:
        import cv2
    except ImportError as e:
        raise RuntimeError("JPEG frames need Pillow or opencv on the executors; option decode=false gives them as they are") from e
    return cv2.cvtColor(cv2.imdecode(np.frombuffer(data, np.uint8), cv2.IMREAD_COLOR), cv2.COLOR_BGR2RGB)


class Other:
    """Frames one after the other, by opencv."""

    def __init__(self, path: str):
        try:
            import cv2
        except ImportError as e:
            raise RuntimeError("videos other than YUV4MPEG and AVI need the opencv library on the executors") from e
        self.cv2, self.video, self.at = cv2, cv2.VideoCapture(path), 0
        if not self.video.isOpened():
            raise ValueError(f"can't open {path}")
        self.fps, self.total, self.width, self.height = (
            kind(self.video.get(x)) for kind, x in ((float, cv2.CAP_PROP_FPS), (int, cv2.CAP_PROP_FRAME_COUNT), (int, cv2.CAP_PROP_FRAME_WIDTH), (int, cv2.CAP_PROP_FRAME_HEIGHT))
        )

    def frame(self, k: int) -> np.ndarray | None:
        """k rises from call to call."""
        while self.at <= k:
            if not self.video.grab():
                return None
            self.at += 1
        ok, image = self.video.retrieve()
        return self.cv2.cvtColor(image, self.cv2.COLOR_BGR2RGB) if ok else None


def container(file: Ranged) -> Y4M | AVI | None:
    head = file.at(0, 12)
    if head[:10] == b"YUV4MPEG2 ":
        return Y4M(file)
    if head[:4] == b"RIFF" and head[8:12] == b"AVI ":
        return AVI(file)
    return None


def rounded(x: float, digits: int = 2) -> float:
    return float(np.floor(x * 10**digits + 0.5) / 10**digits)


class _Slice(InputPartition):
    def __init__(self, path: str, k: int, of: int):
        self.path, self.k, self.of = path, k, of


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = listed(options)
        self.rate, self.most, self.side = float(options.get("rate", 2)), int(options.get("most", 500)), int(options.get("size", 224))
        self.decode, self.slice = options.get("decode", "true") == "true", int(options.get("slice", SLICE))
        self.low, self.high = 0, 1 << 62
        self.taken = 0  # bytes that this reader's last read took

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if name == ("frame_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            elif name == ("analysis_id",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.files = [x for x in self.files if x[0] in wanted]
            elif not (name in (("frame_index",), ("analysis_id",)) and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[_Slice]:
        return [_Slice(path, k, n) for path, size in self.files for n in [max(1, -(-size // self.slice))] for k in range(n)] or [_Slice("", 0, 1)]

    def _chosen(self, video, part: _Slice) -> list[int]:
        """The sampled frames of a slice that the filters let through."""
        step = max(1, int(video.fps / self.rate)) if video.fps > 0 else 1
        n = min(self.most, -(-video.total // step))
        return [j * step for j in range(n) if j * part.of // n == part.k and self.low <= j * step <= self.high]

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if not partition.path:
            return
        with Ranged(partition.path) as file:
            video = container(file)
            if video is None:
                if partition.k:
                    return
                video, partition = Other(partition.path), _Slice(partition.path, 0, 1)
            seconds = rounded(video.total / video.fps) if video.fps > 0 else 0.0
            for k in self._chosen(video, partition):
                encoded, image = None, None
                if isinstance(video, Other):
                    if (image := video.frame(k)) is None:
                        break
                else:
                    place, length = video.place(k)
                    encoded = file.at(place, length)
                    if len(encoded) < length:
                        break  # the file was cut off
                    image = video.decoded(encoded) if self.decode else None
                if image is not None and self.side:
                    image = np.floor(resized(image.transpose(2, 0, 1).astype(float), self.side, self.side) + 0.5).astype(np.uint8).transpose(1, 2, 0)
                height, width = image.shape[:2] if image is not None else (None, None)
                yield (
                    partition.path, k, video.fps, height, width, image.tobytes() if image is not None else None,
                    rounded(k / video.fps) if video.fps > 0 else 0.0, video.total, seconds, abs(video.height), video.width, None if self.decode else encoded,
                )
            self.taken = file.taken


class FrameSource(DataSource):
    """Options: paths (comma-separated) or path (a file or folder), rate (frames a second), most
    (frames a file), size (of the square frames; 0 for the video's own), decode (false: the
    frames' bytes as they are, in ``encoded``), slice (bytes of a file for each task)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Metadata(_Reader):
    def partitions(self) -> list[_Slice]:
        return [_Slice(path, 0, 1) for path, _ in self.files] or [_Slice("", 0, 1)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return filters

    def read(self, partition: _Slice) -> Iterator[tuple]:
        if not partition.path:
            return
        with Ranged(partition.path) as file:
            video = container(file) or Other(partition.path)
            seconds = rounded(video.total / video.fps) if video.fps > 0 else 0.0
            yield partition.path, seconds, video.fps, (video.width, abs(video.height)), video.total, len(self._chosen(video, partition))
            self.taken = file.taken


class VideoSource(FrameSource):
    """A row of metadata for each file, from its header and index."""

    @classmethod
    def name(cls) -> str:
        return "videos"

    def schema(self) -> str:
        return VIDEO

    def reader(self, schema) -> DataSourceReader:
        return _Metadata(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    spark.dataSource.register(VideoSource)
