"""Files that are read in ranges: a reader that counts, and a data source of byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A local path, or one with a scheme that Arrow's file systems know."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+]*:", path) else (fs.LocalFileSystem(), path)


def listed(options: dict) -> list[tuple[str, int]]:
    """(path, size) of the files that ``paths`` (comma-separated) and ``path`` name; of folders,
    those below them. What isn't there has size -1."""
    out = []
    for path in [p for p in options.get("paths", "").split(",") if p] + ([options["path"]] if "path" in options else []):
        system, where = located(path)
        info = system.get_file_info(where)
        if info.type == fs.FileType.Directory:
            prefix = path[: len(path) - len(where)] if path.endswith(where) else "file://" if path.startswith("file:") else ""
            below = system.get_file_info(fs.FileSelector(where, recursive=True))
            out += sorted((prefix + x.path, x.size) for x in below if x.type == fs.FileType.File)
        else:
            out.append((path, info.size if info.type == fs.FileType.File else -1))
    return out


class Ranged:
    """A file open for reading at places; ``taken`` counts the bytes that were read."""

    def __init__(self, path: str):
        system, where = located(path)
        try:
            self.file = system.open_input_file(where)
        except OSError as e:
            raise ValueError(f"can't open {path}") from e
        self.size, self.taken = self.file.size(), 0

    def at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        data = self.file.read(max(0, length))
        self.taken += len(data)
        return data

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class _Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, length: int):
        self.path, self.size, self.start, self.length = path, size, start, length


def requested(header: str | None, size: int) -> tuple[int, int]:
    """(start, after last) of a request's ``bytes=a-b``; without one, or with one that
    can't be met, the whole file."""
    m = re.fullmatch(r"\s*bytes=(\d+)-(\d*)\s*", header or "")
    if not m or int(m[1]) >= size or (m[2] and int(m[2]) < int(m[1])):
        return 0, size
    return int(m[1]), min(size, int(m[2]) + 1) if m[2] else size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = listed(options)
        self.header, self.chunk = options.get("range"), int(options.get("chunk", 64 << 20))

    def partitions(self) -> list[_Range]:
        out = []
        for path, size in self.files:
            if size < 0:
                raise ValueError(f"can't open {path}")
            start, end = requested(self.header, size)
            out += [_Range(path, size, at, min(self.chunk, end - at)) for at in range(start, end, self.chunk)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        if partition.path:
            with Ranged(partition.path) as file:
                yield partition.path, partition.size, partition.start, file.at(partition.start, partition.length)


class RangeSource(DataSource):
    """Options: ``paths`` or ``path``; ``range``, as in a request's header; ``chunk``, the
    bytes of a row, each of which is a partition of its own. Only the range is read."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return "path string, size bigint, start bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RangeSource)
