"""A sink for uploads: one file for each, written in two phases.

Tasks write into a folder of their own below ``_pending``; the commit moves the files to their places.
What a failed write leaves there is removed, at the latest when the batch is written again. A file's name follows from the batch and the
upload's id, so that a batch that is written again finds its files and writes none.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .ranged import located

SCHEMA = "id string, name string, content binary"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def file_name(batch: str, upload_id: str, name: str | None) -> str:
    """A name for life: the same for the same upload of a batch; the suffix is the upload's own, or .mp4."""
    suffix = re.search(r"\.\w+$", name or "")
    return f"{uuid.uuid5(_SPACE, f'{batch}/{upload_id}')}{suffix[0].lower() if suffix else '.mp4'}"


class _Written(WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class _Writer(DataSourceWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch = path.rstrip("/"), batch

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, root = located(self.path)
        folder, names = f"{root}/_pending/{self.batch}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = file_name(self.batch, row["id"], row["name"])
            if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name}") as out:
                    out.write(row["content"] or b"")
                names.append(name)
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = located(self.path)
        for m in messages:
            for name in m.names if m else ():
                if system.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._cleared()

    def abort(self, messages: list[_Written | None]) -> None:
        self._cleared()

    def _cleared(self) -> None:
        system, root = located(self.path)
        if system.get_file_info(f"{root}/_pending/{self.batch}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_pending/{self.batch}")


class UploadSink(DataSource):
    """Options: path, and batch, a name that a repeated write of the same uploads has again."""

    @classmethod
    def name(cls) -> str:
        return "upload_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["batch"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UploadSink)


def store_files(uploads: DataFrame, path: str, batch: str) -> None:
    """Admitted uploads (id, name, content) as files below ``path``."""
    register(uploads.sparkSession)
    uploads.select("id", "name", "content").write.format("upload_files").option("path", path).option("batch", batch).mode("append").save()
