"""Exports: plans, exact-size parts in order, cell rules, flat formats."""

from __future__ import annotations

import datetime
import io
import math
import re
import uuid
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.columns import SheetError, col, kind
from .operators.paging import sorted_copy

MOST_ROWS, MOST_COLUMNS, SAFE, MOST_CHARS = 1_048_575, 16_384, 999_999_999_999_999, 32_767


def plan(rows: int, columns: int, rows_per_file: int) -> dict:
    if columns > MOST_COLUMNS:
        raise SheetError(f"more than {MOST_COLUMNS} columns")
    size = min(max(1, rows_per_file), MOST_ROWS)
    parts = max(1, math.ceil(rows / size))
    warnings = (["no rows"] if not rows else []) + ([f"{parts} files"] if parts > 200 else [])
    return {"rows": rows, "rows_per_file": size, "parts": parts, "warnings": warnings}


def part_name(stem: str, i: int, parts: int, style: str = "alpha") -> str:
    stem = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", stem)
    if parts == 1:
        return stem
    letters, n = "", i + 1
    while n:
        n, r = divmod(n - 1, 26)
        letters = chr(97 + r) + letters
    return stem + {"alpha": f"_{letters}", "numeric": f"_{i + 1}", "part": f"_part{i + 1}", "padded": f"_{i + 1:0{len(str(parts))}d}"}[style]


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with dense positions `_at` from 0."""
    return sorted_copy(df, [col(df, n).asc_nulls_last() for n in order]).numbered()


def split_parts(df: DataFrame, order: list[str], rows_per_file: int) -> DataFrame:
    """df with `_part`: exactly rows_per_file rows each but the last, in order."""
    return numbered(df, order).withColumn("_part", F.floor(F.col("_at") / rows_per_file).cast("int")).drop("_at")


def precise(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Whole-number and decimal columns with values beyond 15 digits become text; their names."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.LongType, T.DecimalType))]
    if not names:
        return df, []
    row = df.agg(*[F.max(F.abs(col(df, n).cast("decimal(38,0)"))).alias(f"m{i}") for i, n in enumerate(names)]).first()
    wide = [n for i, n in enumerate(names) if row[i] is not None and row[i] > SAFE]
    return df.withColumns({n: col(df, n).cast("string") for n in wide}) if wide else df, wide


def cell_rules(df: DataFrame) -> DataFrame:
    """Text cells as a workbook takes them: line ends unified, at most 32,767 characters (cut ones end in an ellipsis)."""
    out = {}
    for f in df.schema:
        if kind(f.dataType) == "text":
            c = F.replace(col(df, f.name).cast("string"), F.lit("\r\n"), F.lit("\n"))
            out[f.name] = F.when(F.char_length(c) > MOST_CHARS, F.concat(F.substring(c, 1, MOST_CHARS - 1), F.lit("…"))).otherwise(c)
    return df.withColumns(out) if out else df


def _too_long(df: DataFrame, name: str) -> Column:
    return F.char_length(F.replace(col(df, name).cast("string"), F.lit("\r\n"), F.lit("\n"))) > MOST_CHARS


def cut_cells(df: DataFrame) -> DataFrame:
    """One row: for each text column how many cells are longer than a workbook's cells may be."""
    names = [f.name for f in df.schema if kind(f.dataType) == "text"]
    return df.agg(*[F.count(F.when(_too_long(df, n), 1)).alias(n) for n in names]) if names else df.sparkSession.range(1).select()


def write(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, compression: str = "zstd") -> dict:
    """A folder of one format; its own source is never written over.  Returns how many rows were written, and of each text column how many of
    its cells are longer than a workbook's may be: counted on the way."""
    bare = lambda p: p.removeprefix("file://").removeprefix("file:").rstrip("/")
    if overwrite and any(f"{bare(f)}/".startswith(f"{bare(path)}/") for f in df.inputFiles()):
        raise SheetError(f"{path} is what the table is read from")
    seen, texts = Observation(), [f.name for f in df.schema if kind(f.dataType) == "text"]
    w = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count(F.when(_too_long(df, n), 1)).alias(f"n{i}") for i, n in enumerate(texts)]).write.mode("overwrite" if overwrite else "errorifexists")
    if form == "parquet":
        w.option("compression", compression).parquet(path)
    elif form in ("csv", "tsv"):
        w.option("header", "true").option("sep", "\t" if form == "tsv" else ",").option("escape", '"').csv(path)
    elif form == "jsonl":
        w.option("ignoreNullFields", "false").json(path)
    else:
        raise SheetError(f"unknown format {form!r}")
    got = seen.get
    return {"rows": got["rows"], "long_cells": {n: got[f"n{i}"] for i, n in enumerate(texts) if got[f"n{i}"]}}


def report(spark: SparkSession, path: str, rows: int, source_bytes: int | None = None) -> dict:
    """What an export has written: files (name, bytes), rows, bytes, and how much smaller than its source it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    files = sorted((f.getPath().getName(), f.getLen()) for f in found if not f.getPath().getName().startswith(("_", ".")))
    total = sum(n for _, n in files)
    return {"files": files, "rows": rows, "bytes": total, "compression_ratio": round(1 - total / source_bytes, 3) if source_bytes and total else None}


#: Up to PARTS_ALONE workbooks are written by a task each; of more, a task writes several, about ROWS_A_TASK rows, unless there are fewer tasks than three for each core.
PARTS_ALONE, ROWS_A_TASK = 64, 80_000

#: Fixed values of the workbook format: the members every file has besides its sheet.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
MEMBERS = {
    "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET_TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELATIONS}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELATIONS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_RELATIONS}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf numFmtId="14" applyNumberFormat="1"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
}
_EPOCH, _FIRST_DAY = datetime.datetime(1899, 12, 30), datetime.date(1900, 3, 1)


def cell(v) -> str:
    """One value as a workbook cell: blank for null and non-finite numbers; dates before March 1900, which the format lacks, as text."""
    if v is None or (isinstance(v, float) and not math.isfinite(v)):
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime.datetime) and v.date() >= _FIRST_DAY:
        return f'<c s="2"><v>{(v.replace(tzinfo=None) - _EPOCH) / datetime.timedelta(days=1)!r}</v></c>'
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime) and v >= _FIRST_DAY:
        return f'<c s="1"><v>{(v - _EPOCH.date()).days}</v></c>'
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"<c><v>{v}</v></c>"
    return _text_cell(str(v))


_BARRED, _MARKED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"), re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff&<>]")


def _text_cell(v: str) -> str:
    if _MARKED.search(v):
        v = escape(_BARRED.sub("", v))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{v}</t></is></c>'


def cells_of(values: pa.Array) -> list[str]:
    """cell() of each value of an Arrow column; the common types are told once for all values."""
    kind = values.type
    if pa.types.is_integer(kind):
        return ["<c/>" if v is None else f"<c><v>{v}</v></c>" for v in values.to_pylist()]
    if pa.types.is_floating(kind):
        return ["<c/>" if v is None or v - v != 0 else f"<c><v>{v}</v></c>" for v in values.to_pylist()]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return ["<c/>" if v is None else _text_cell(v) for v in values.to_pylist()]
    if pa.types.is_date32(kind):
        first, shift = (_FIRST_DAY - datetime.date(1970, 1, 1)).days, (datetime.date(1970, 1, 1) - _EPOCH.date()).days
        days = values.cast(pa.int32()).to_pylist()
        return ["<c/>" if d is None else f'<c s="1"><v>{d + shift}</v></c>' if d >= first else cell(v.as_py()) for d, v in zip(days, values, strict=True)]
    return [cell(v) for v in values.to_pylist()]


def save_rows(out, names: list[str], rows) -> int:
    """One sheet with a header, written to an open stream as its rows (their cells as text of the format) come; how many these were."""
    n = 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        for member, xml in MEMBERS.items():
            book.writestr(member, xml)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as raw, io.BufferedWriter(raw, 1 << 16) as f:
            for n, row in enumerate(rows, 1):
                if n == 1:
                    f.write(_head(names))
                f.write(f"<row>{row}</row>".encode())
            if not n:
                f.write(_head(names))
            f.write(b"</sheetData></worksheet>")
    return n


def _head(names: list[str]) -> bytes:
    return f'<worksheet xmlns="{_MAIN}"><sheetData><row>{"".join(map(cell, names))}</row>'.encode()


def write_workbooks(df: DataFrame, order: list[str], folder: str, stem: str, rows_per_file: int = MOST_ROWS, style: str = "alpha", overwrite: bool = False) -> DataFrame:
    """df as workbooks of exactly rows_per_file rows (the last: the rest), in order, each with the header; a file is written by one task.

    Returns the report: part, file, rows, bytes.  All files are there when the write has ended, or none: tasks write aside, the commit
    moves (`sources.workbook_source`).  Folders are shared paths or whatever store pyarrow opens by its URI; on a cluster, name one
    that all machines see.  Existing files are refused unless overwrite.  An empty df gives one file with the header."""
    from pyarrow import fs

    from .sources import workbook_source

    spark, ready = df.sparkSession, precise(cell_rules(df))[0]
    names, sheet = ready.columns, numbered(ready, order)
    total = df.count()
    todo = plan(total, len(names), rows_per_file)
    parts, size = todo["parts"], todo["rows_per_file"]
    tasks = min(parts, max(PARTS_ALONE, 3 * spark.sparkContext.defaultParallelism, math.ceil(total / ROWS_A_TASK)))
    store, base = workbook_source.store_of(folder)
    store.create_dir(base, recursive=True)
    files = [f"{base}/{part_name(stem, i, parts, style)}.xlsx" for i in range(parts)]
    taken = [x.path for x in store.get_file_info(files) if x.type != fs.FileType.NotFound]
    if taken and not overwrite:
        raise SheetError(f"{taken[0]} exists")
    if total:
        dealt = sheet.withColumn("_part", F.floor(F.col("_at") / size).cast("int")).repartitionByRange(tasks, "_part").sortWithinPartitions("_part", "_at")
        workbook_source.register(spark)
        out = dealt.select("_part", *[col(dealt, n) for n in names]).write.format(workbook_source.NAME).mode("append")
        out.options(folder=folder, stem=stem, style=style, parts=parts, job=uuid.uuid4().hex).save()
    else:
        with store.open_output_stream(files[0]) as f:
            save_rows(f, names, [])
    held = store.get_file_info(files)
    return spark.createDataFrame([(i, f.path, min(size, total - i * size), f.size) for i, f in enumerate(held)], "part int, file string, rows long, bytes long")
