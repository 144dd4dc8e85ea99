"""Workbooks as a data source of Spark: a partition reads one sheet of one file by ranges of it, a write is committed whole or not at all.

Reading takes the archive's directory and the members it needs from wherever pyarrow opens the file; the file is never in
memory as a whole, and its size has no bound.  Writing puts each task's files into a folder of the job's own beside their place;
the commit moves them there, an abort deletes that folder with whatever tasks that failed or ran twice have left in it.
"""

from __future__ import annotations

import itertools
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "sparksheet_workbooks"
CELLS = "file string, at long, cells array<string>"
BATCH = 2_000


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it; raises ArrowInvalid (a ValueError) for one that pyarrow does not know."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opens(path: str) -> bool:
    """Whether pyarrow opens this file: tasks can then read it by ranges."""
    try:
        store, at = store_of(path)
        return store.get_file_info(at).type == fs.FileType.File
    except (ValueError, OSError):
        return False


@dataclass
class SheetParts(InputPartition):
    """What one task reads: sheets by (file, sheet or null)."""

    sheets: list[tuple[str, str | None]]


@dataclass
class Written(WriterCommitMessage):
    """Of each file a task has written: where it is, where it belongs."""

    files: list[tuple[str, str]]


class SheetReader(DataSourceReader):
    """options: sheets, a list of (file, sheet or null) in JSON; tasks, how many share them at most; head, 1 for the first rows alone."""

    def __init__(self, options: dict):
        self.sheets, self.head = json.loads(options["sheets"]), options.get("head") == "1"
        self.tasks = int(options.get("tasks", len(self.sheets)))

    def __getstate__(self) -> dict:
        """Each task gets the reader beside its own part, so not the list of all files."""
        return {**self.__dict__, "sheets": []}

    def partitions(self) -> list[SheetParts]:
        return [SheetParts(self.sheets[i :: self.tasks]) for i in range(min(self.tasks, len(self.sheets)))]

    def read(self, partition: SheetParts) -> Iterator[pa.RecordBatch]:
        for file, sheet in partition.sheets:
            yield from self._one(file, sheet)

    def _one(self, file: str, sheet: str | None) -> Iterator[pa.RecordBatch]:
        from .workbook import sheet_rows

        store, at = store_of(file)
        with store.open_input_file(at) as f:
            rows = enumerate(sheet_rows(f, sheet))
            while part := list(itertools.islice(rows, 1 if self.head else BATCH)):
                places, cells = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(places, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["file", "at", "cells"])
                if self.head:
                    break


class PartsWriter(DataSourceArrowWriter):
    """options: folder, stem, style, parts, job.  Rows have their part's number first; a part's rows come in order and together, to one task."""

    def __init__(self, options: dict):
        self.folder, self.stem, self.style, self.parts = options["folder"], options["stem"], options["style"], int(options["parts"])
        self.aside = posixpath.join(self.folder, f"_writing-{options['job']}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from ..sinks import cells_of, part_name, save_rows

        store, aside = store_of(self.aside)
        names: list[str] = []

        def rows():
            for b in iterator:
                names[:] = b.schema.names[1:]
                for i in range(0, b.num_rows, 1000):
                    part, *columns = b.slice(i, 1000).columns
                    yield from zip(part.to_pylist(), map("".join, zip(*map(cells_of, columns), strict=True)), strict=True)

        done = []
        for part, group in itertools.groupby(rows(), key=lambda r: r[0]):
            name = part_name(self.stem, part, self.parts, self.style) + ".xlsx"
            at = f"{aside}/{uuid.uuid4().hex}.xlsx"
            store.create_dir(aside, recursive=True)
            with store.open_output_stream(at) as out:
                save_rows(out, names, (r for _, r in group))
            done.append((at, name))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.folder)
        for m in messages:
            for at, name in m.files if m else []:
                store.move(at, f"{folder}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, aside = store_of(self.aside)
        if store.get_file_info(aside).type == fs.FileType.Directory:
            store.delete_dir(aside)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> SheetReader:
        out = SheetReader(self.options)
        self.options = {}  # tasks get the source too
        return out

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        return PartsWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)
