"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in
    ``spark.checkpoint.dir``; where that is unset (tests), an own one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends
    there, so that a lost executor costs no recomputation, and the size of
    the table is known to later joins."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Rows that a function gets at once: what it makes of them is held beside them.
ROWS = 1024


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def per_row(
    df: DataFrame,
    schema: str,
    f: Callable[[list], list[tuple]],
    inputs: list[str],
) -> DataFrame:
    """Apply ``f`` to lists of ROWS input tuples. Each returned tuple is a row of
    ``schema``; rows are made where they are read, with no shuffle, and memory is
    bounded by an Arrow batch."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = f(list(zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)))
            columns = list(zip(*rows, strict=True)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target
            )
        returned()

    return df.select(*inputs).mapInArrow(run, schema)


def returned() -> None:
    """Give free memory back at a task's end: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def add_columns(df: DataFrame, added: str, f: Callable[[list], list[tuple]], inputs: list[str]) -> DataFrame:
    """Like per_row, with one row out for each row in; the columns of ``df``
    go along untouched, and those named in ``added`` replace or follow them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    names = {x.name for x in new}
    others = [x for x in df.schema.fields if x.name not in names]
    carried = [f"_c{i}" for i in range(len(others))]
    # positional names: inputs may be replaced, and names may need quoting
    own = df.select(
        *(df[f"`{x.name}`"].alias(c) for x, c in zip(others, carried, strict=True)),
        *(df[f"`{x}`"].alias(f"_i{i}") for i, x in enumerate(inputs)),
    )
    out = StructType([*(own.schema[c] for c in carried), *new.fields])
    target, k = to_arrow_schema(new), len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = batch.columns
            rows = f(list(zip(*(c.to_pylist() for c in columns[k:]), strict=True)))
            made = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), target, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:k], *made], names=[*carried, *target.names])
        returned()

    made = own.mapInArrow(run, out)
    back = {x.name: F.col(c).alias(x.name) for x, c in zip(others, carried, strict=True)}
    order = [*df.columns, *(x.name for x in new if x.name not in df.columns)]
    return made.select(*(back.get(n, F.col(n)) for n in order))
