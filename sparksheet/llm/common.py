"""What the training-data operators share: scratch tables, safe names, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, discard, shared_dir  # noqa: F401


def tidy() -> None:
    """Gives memory that a task is done with back to the system: workers live on, and several share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidily(run):
    """A task function (an iterator to an iterator) that is tidy at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A name like this that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str = "text"):
    """The column with null read as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def batch(names_types: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names_types, strict=True)], names=[n for n, _ in names_types])


def chunks(batches, rows: int = 500):
    """Arrow batches in slices of few rows, so that what is made from them stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
