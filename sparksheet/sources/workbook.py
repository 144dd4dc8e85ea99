"""Workbooks (.xlsx): one task reads one sheet of one file and streams its rows; the format itself bounds a sheet's size.

Files that pyarrow opens are read by ranges (`workbook_source`); others by Spark's own reader of whole files, up to 2 GB each.
"""

from __future__ import annotations

import io
import itertools
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from xml.etree.ElementTree import iterparse
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import SheetError, unique_names
from ..functions.convert import lossless
from ..scratch import cut
from . import workbook_source
from .text import literal_path

#: Fixed values of the format: the built-in number formats that show dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
BATCH = 2_000
#: Up to FILES_ALONE files are read by a task each; of more, one task reads FILES_A_TASK at most, unless there are fewer tasks than three for each core.
FILES_ALONE, FILES_A_TASK = 64, 16
_PLAIN = re.compile(r"-?[0-9]+(\.[0-9]+)?").fullmatch


def _elements(book: zipfile.ZipFile, member: str, tag: str):
    """Elements of one name (namespaces put aside), each emptied after its use."""
    with book.open(member) as f:
        for _, e in iterparse(f):
            if e.tag.rpartition("}")[2] == tag:
                yield e
                e.clear()


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names in their order, with their members."""
    files = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    member = lambda target: target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
    of = lambda e: next(v for k, v in e.attrib.items() if k.rpartition("}")[2] == "id")
    return {e.get("name"): member(files[of(e)]) for e in _elements(book, "xl/workbook.xml", "sheet")}


def _all_text(e) -> str:
    """The text of an element's runs, phonetic hints left out."""
    runs = [x for x in e if x.tag.rpartition("}")[2] in ("t", "r")]
    return "".join(t.text or "" for x in runs for t in ([x] if x.tag.endswith("}t") else [y for y in x if y.tag.rpartition("}")[2] == "t"]))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Which cell styles show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    own, out = set(), set()
    for e in _elements(book, "xl/styles.xml", "numFmt"):
        if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "")).lower()):
            own.add(int(e.get("numFmtId")))
    for e in _elements(book, "xl/styles.xml", "cellXfs"):
        out |= {i for i, x in enumerate(e) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
    return out


def _moment(serial: float, since_1904: bool) -> str:
    """A date serial as ISO text, without a time at midnight."""
    days = serial + 1 if not since_1904 and serial < 60 else serial  # the format counts a 29 February 1900
    at = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 30)
    at = at + timedelta(microseconds=round(days * 86_400_000) * 1000)
    return at.strftime("%Y-%m-%d") if at.time() == at.min.time() else at.isoformat(sep=" ")


@lru_cache(10_000)
def _shown_date(v: str, since_1904: bool) -> str:
    return _moment(float(v), since_1904)


@lru_cache(20_000)
def _column(letters: str) -> int:
    """The place of a column from 1; 0 without letters."""
    at = 0
    for letter in re.match("[A-Z]*", letters)[0]:
        at = at * 26 + ord(letter) - 64
    return at


def _rows(member, strings: list[str], dates: set[int], since_1904: bool) -> Iterator[list[str | None]]:
    """The rows of an open sheet, every cell as text.  The parser's events are taken as they come: no tree of the cells is made."""
    ready: list[list[str | None]] = []
    row: list[str | None] = []
    here: dict[str, str] = {}
    # depth: 1 in a row, 2 in a cell of it, and so on; value and texts: the cell's so far; take: whether characters count.
    depth, form, value, texts, take, inline, in_run = 0, "n", None, None, False, False, False

    def start(tag, attributes):
        nonlocal depth, here, form, value, texts, take, inline, in_run, row
        if ":" in tag:
            tag = tag.rpartition(":")[2]
        if not depth:
            if tag == "row":
                depth, row = 1, []
            return
        depth += 1
        if depth == 2:
            here, form, value, texts = attributes, attributes.get("t", "n"), None, None
        elif depth == 3:
            take, inline = tag == "v", tag == "is"
            if take:
                value = ""
            elif inline:
                texts = ""
        elif depth == 4:
            in_run = inline and tag == "r"
            take = inline and tag == "t"
        else:
            take = depth == 5 and in_run and tag == "t"

    def characters(text):
        nonlocal value, texts
        if take:
            if depth == 3:
                value += text
            else:
                texts += text

    def end(tag):
        nonlocal depth, take
        if not depth:
            return
        depth -= 1
        take = False
        if depth == 1:
            if r := here.get("r"):
                if (at := _column(r.rstrip("0123456789")) - 1) > len(row):
                    row.extend([None] * (at - len(row)))
            if form == "inlineStr":
                row.append(texts)
            elif not value:
                row.append(None)
            elif form == "n":
                if int(here.get("s", 0)) in dates:
                    row.append(_shown_date(value, since_1904))
                else:
                    row.append(value if _PLAIN(value) else repr(float(value)))
            elif form == "s":
                row.append(strings[int(value)])
            elif form == "b":
                row.append("TRUE" if value == "1" else "FALSE")
            else:
                row.append(value)
        elif not depth:
            ready.append(row)

    parser = expat.ParserCreate()
    parser.buffer_text, parser.buffer_size = True, 1 << 16
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    while block := member.read(1 << 16):
        parser.Parse(block, False)
        yield from ready
        ready.clear()
    parser.Parse(b"", True)
    yield from ready


def sheet_rows(file, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows that are not blank of a sheet of a file that can be sought in, every cell as text."""
    with zipfile.ZipFile(file) as book:
        sheets = _sheets(book)
        name = sheet if sheet is not None else next(iter(sheets), None)
        if name not in sheets:
            raise SheetError(f"no sheet {name!r}; there are {list(sheets)}")
        strings = [_all_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        dates = _date_styles(book)
        since_1904 = any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr"))
        with book.open(sheets[name]) as member:
            for cells in _rows(member, strings, dates, since_1904):
                if any(x is not None and x.strip() for x in cells):
                    yield cells


def _files(spark: SparkSession, path: str) -> list[str]:
    """The workbooks' paths: one row a file."""
    return [r["path"] for r in spark.read.format("binaryFile").load(literal_path(path)).select("path").orderBy("path").collect()]


def _over_files(spark: SparkSession, path: str, make, form: str) -> DataFrame:
    """make(file's name, open file) -> Arrow batches, for each file: one task a file opens it by ranges, or has its content from Spark where pyarrow cannot."""
    files = _files(spark, path)
    if files and all(map(workbook_source.opens, files[:1])):

        def run(batches):
            for b in batches:
                for file in b.column(0).to_pylist():
                    store, at = workbook_source.store_of(file)
                    with store.open_input_file(at) as f:
                        yield from make(file, f)

        return spark.createDataFrame([(f,) for f in files], "path string").repartition(len(files)).mapInArrow(run, form)

    def whole(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from make(file, io.BytesIO(content))

    return spark.read.format("binaryFile").load(literal_path(path)).select("path", "content").mapInArrow(whole, form)


def sheet_names(spark: SparkSession, path: str) -> DataFrame:
    """file, sheet, at: every sheet of every workbook."""

    def make(file: str, f):
        with zipfile.ZipFile(f) as book:
            names = list(_sheets(book))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32())], names=["file", "sheet", "at"])

    return _over_files(spark, path, make, "file string, sheet string, at int")


def _cells(spark: SparkSession, path: str, sheet: str | None, files: list[str], head: bool = False) -> DataFrame:
    """file, at, cells of one sheet of each file; head: their first rows alone.  Tasks read several files each where there are many."""
    if files and workbook_source.opens(files[0]):
        workbook_source.register(spark)
        tasks = max(FILES_ALONE, 3 * spark.sparkContext.defaultParallelism, len(files) // FILES_A_TASK)
        return spark.read.format(workbook_source.NAME).options(sheets=json.dumps([(f, sheet) for f in files]), head="1" if head else "0", tasks=tasks).load()

    def make(file: str, f):
        rows = enumerate(sheet_rows(f, sheet))
        while part := list(itertools.islice(rows, 1 if head else BATCH)):
            at, cells = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(cells, pa.list_(pa.string()))], names=["file", "at", "cells"])
            if head:
                break

    return _over_files(spark, path, make, workbook_source.CELLS).where(F.col("file").isin(*files) if len(files) == 1 else F.lit(True))


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, all_text: bool = False, about: dict | None = None) -> DataFrame:
    """One sheet (the first, if not named) of a workbook or of each workbook of a folder, which share a header.

    Blank rows are left out; the first other row of the first file names the columns, every file's first one is skipped;
    rows are padded or trimmed to the header's width and typed without loss.  Each file is parsed once: its cells are written down as
    text, and types are told from these.  A sheet that is missing or empty is refused.  about: given notes of the other sheets."""
    files = _files(spark, path)
    if not files:
        raise SheetError(f"no workbook at {path}")
    first = files[0]
    known = [r["sheet"] for r in sheet_names(spark, first).orderBy("at").collect()]  # one file's sheets
    if not known or (sheet is not None and sheet not in known):
        raise SheetError(f"no sheet {sheet!r}; there are {known}")
    if about is not None and len(known) > 1:
        read = sheet if sheet is not None else known[0]
        about["notes"] = [f"sheet {read!r} was read; the others are {', '.join(map(repr, [k for k in known if k != read][:20]))}"]
    head = _cells(spark, first, sheet, [first], head=True).first()
    if head is None:
        raise SheetError("the sheet is empty")
    names = unique_names([x or "" for x in head["cells"]])
    body = _cells(spark, path, sheet, files).where("at > 0")
    df = body.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return df if all_text else lossless(cut(df))
