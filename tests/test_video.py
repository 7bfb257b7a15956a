"""Videos made here: metadata, sampling, ranges and filters."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from tidemark.sources import ranged, video

W, H = 6, 4


def image(k):
    """A frame that tells its number."""
    x = np.full((H, W, 3), 40, np.uint8)
    x[0, 0] = (k % 256, k // 256, 7)
    x[-1, -1] = (200, 100, 50)
    return x


def chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def avi(path, frames, fps=30, kind=b"\0\0\0\0", index=True, absolute=False):
    """frames: bytes of each; with a sound stream's chunks between them."""
    video_head = b"vids" + (b"DIB " if kind == b"\0\0\0\0" else kind) + bytes(12) + struct.pack("<II", 1, fps) + bytes(28)
    form = struct.pack("<IiiHH4sI", 40, W, H, 1, 24, kind, 0) + bytes(16)
    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(52)) + chunk(b"strf", bytes(16)))
    head = chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + sound + chunk(b"LIST", b"strl" + chunk(b"strh", video_head) + chunk(b"strf", form)))
    body, entries = b"movi", b""
    start = 12 + len(head) + 8
    for data in frames:
        for name, part in ((b"01dc" if kind != b"\0\0\0\0" else b"01db", data), (b"00wb", b"sss")):
            entries += name + struct.pack("<III", 16, len(body) + (start if absolute else 0), len(part))
            body += chunk(name, part)
    riff = b"AVI " + head + chunk(b"LIST", body) + (chunk(b"idx1", entries) if index else b"")
    path.write_bytes(b"RIFF" + struct.pack("<I", len(riff)) + riff)
    return str(path)


def dib(k):
    row = np.zeros((H, (3 * W + 3) // 4 * 4), np.uint8)
    row[:, : 3 * W] = image(k)[::-1, :, ::-1].reshape(H, -1)
    return row.tobytes()


def y4m(path, frames, chroma="420jpeg", fps="30:1", head=b"FRAME\n"):
    path.write_bytes(f"YUV4MPEG2 W{W} H{H} F{fps} Ip A1:1 C{chroma}\n".encode() + b"".join(head + x for x in frames))
    return str(path)


def grey_yuv(k, size):
    return bytes([16 + k % 200] * (W * H)) + bytes([128] * size)


@pytest.fixture(scope="module")
def source(spark):
    video.register(spark)
    ranged.register(spark)
    return lambda name, **options: spark.read.format(name).options(**{k: str(v) for k, v in options.items()}).load()


def test_500_frames_at_two_a_second(source, tmp_path):
    path = avi(tmp_path / "long.avi", [dib(k) for k in range(8000)])
    rows = source("frames", paths=path, size=0, slice=200_000).orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == [15 * k for k in range(500)]
    for r in rows:
        assert bytes(r.pixels) == image(r.frame_index).tobytes()
        assert (r.fps, r.height, r.width, r.source_height, r.source_width, r.total_frames) == (30.0, H, W, H, W, 8000)
        assert r.timestamp == r.frame_index / 30 and r.duration_seconds == 266.67
    [meta] = source("videos", path=path).collect()
    assert (meta.total_frames, meta.analyzed_frames, meta.fps, meta.duration_seconds, tuple(meta.resolution)) == (8000, 500, 30.0, 266.67, (W, H))


@pytest.mark.parametrize("index,absolute", [(True, False), (True, True), (False, False)])
def test_frames_are_found_by_index_or_chunks(source, tmp_path, index, absolute):
    jpegs = [b"\xff\xd8" + bytes([k]) * (5 + k) for k in range(40)]
    path = avi(tmp_path / "m.avi", jpegs, fps=4, kind=b"MJPG", index=index, absolute=absolute)
    rows = source("frames", path=str(tmp_path), decode="false").orderBy("frame_index").collect()
    assert [(r.frame_index, bytes(r.encoded)) for r in rows] == [(k, jpegs[k]) for k in range(0, 40, 2)]
    assert {r.analysis_id for r in rows} == {path} and rows[0].pixels is None
    with pytest.raises(Exception, match="Pillow or opencv|cannot identify"):
        source("frames", path=path).collect()


@pytest.mark.parametrize("chroma,size", [("420jpeg", 2 * 3 * 2), ("422", 2 * 3 * 4), ("444", 2 * 24), ("mono", 0)])
def test_raw_frames(source, tmp_path, chroma, size):
    path = y4m(tmp_path / "a.y4m", [grey_yuv(k, size) for k in range(50)], chroma, "25:1")
    rows = source("frames", path=path, rate=5, size=3, slice=500).orderBy("frame_index").collect()
    assert [r.frame_index for r in rows] == list(range(0, 50, 5))
    for r in rows:
        want = min(255, int(np.floor(r.frame_index * 255 / 219 + 0.5)))
        assert bytes(r.pixels) == bytes([want] * 27) and r.timestamp == r.frame_index / 25


def test_colours_of_raw_frames(tmp_path):
    yuv = bytes([81] * 24 + [90] * 6 + [240] * 6)  # red
    with ranged.Ranged(y4m(tmp_path / "r.y4m", [yuv])) as file:
        found = video.Y4M(file)
        assert np.abs(found.decoded(file.at(*found.place(0))).astype(int) - (255, 0, 0)).max() <= 2


def test_frame_lines_with_parameters_and_files_cut_off(source, tmp_path):
    whole = y4m(tmp_path / "p.y4m", [grey_yuv(k, 12) for k in range(9)], head=b"FRAME Ip\n", fps="0:0")
    (tmp_path / "p.y4m").write_bytes((tmp_path / "p.y4m").read_bytes()[:-5])
    rows = source("frames", path=whole, size=0).collect()
    assert sorted(r.frame_index for r in rows) == list(range(8))
    assert {(r.fps, r.timestamp, r.duration_seconds, r.total_frames) for r in rows} == {(0.0, 0.0, 0.0, 8)}


def test_ranges_are_read_not_files(source, tmp_path):
    path = avi(tmp_path / "big.avi", [bytes(30_000)] * 300, fps=30, kind=b"MJPG")
    whole = (tmp_path / "big.avi").stat().st_size
    reader = video._Reader({"paths": path, "decode": "false", "slice": str(whole // 4 + 1)})
    parts = reader.partitions()
    assert len(parts) == 4
    taken = []
    for part in parts:
        rows = list(reader.read(part))
        assert len(rows) == 5
        taken.append(reader.taken)
    overhead = 2 * 16 * 300 + 2000  # the index and the headers
    assert all(5 * 30_000 <= t <= 5 * 30_000 + overhead for t in taken) and sum(taken) < whole / 10

    # filters on the frame's number leave the other frames unread
    narrow = video._Reader({"paths": path, "decode": "false"})
    assert list(narrow.pushFilters([GreaterThan(("frame_index",), 30), LessThanOrEqual(("frame_index",), 45), EqualTo(("width",), 3)])) == [EqualTo(("width",), 3)]
    [part] = narrow.partitions()
    assert [r[1] for r in narrow.read(part)] == [45] and narrow.taken <= 30_000 + overhead
    df = source("frames", paths=path, decode="false")
    assert [r[0] for r in df.where("frame_index >= 45 AND frame_index < 75").select("frame_index").orderBy("frame_index").collect()] == [45, 60]
    assert df.where(F.col("analysis_id") == "other").count() == 0 and df.where(F.col("analysis_id") == path).count() == 20


def test_byte_ranges(source, tmp_path):
    data = bytes(range(256)) * 40
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"")
    read = lambda **o: source("byte_ranges", **o).orderBy("path", "start").collect()
    rows = read(path=str(tmp_path), chunk=1000)
    assert b"".join(r.content for r in rows) == data and len(rows) == 11 and {r.size for r in rows} == {len(data)}
    rows = read(paths=str(tmp_path / "a.bin"), range="bytes=100-2299", chunk=1000)
    assert b"".join(r.content for r in rows) == data[100:2300] and [r.start for r in rows] == [100, 1100, 2100]
    assert b"".join(r.content for r in read(path=f"file://{tmp_path}/a.bin", range="bytes=10200-")) == data[10200:]
    reader = ranged._Reader({"path": str(tmp_path / "a.bin"), "range": "bytes=5-9", "chunk": "3"})
    assert [len(list(reader.read(p))[0][3]) for p in reader.partitions()] == [3, 2]
    assert [ranged.requested(h, 10) for h in (None, "bytes=2-4", "bytes=2-99", "bytes=7-", "bytes=10-", "bytes=4-2", "lines=1-2")] == [(0, 10), (2, 5), (2, 10), (7, 10), (0, 10), (0, 10), (0, 10)]
    with pytest.raises(Exception, match="can't open"):
        read(path=str(tmp_path / "none"))
