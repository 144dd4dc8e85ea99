"""Opening a file: the sheet, and what is worth saying about how it was read."""

from __future__ import annotations

import codecs
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import kind
from ..functions.convert import typed
from ..sinks import MOST_COLUMNS, MOST_ROWS
from . import text

#: Suffixes that are not delimited text.
OTHERS = (".parquet", ".pq", ".json", ".jsonl", ".ndjson", ".xlsx", ".xlsm", ".zip")


#: What lines are rejected for.
REASONS = {"bytes": "bytes that are not text", "quotes": "a quote that never ends"}


@dataclass
class Sheet:
    """A table, how many rows it has, and the notes and warnings of its reading."""

    df: DataFrame
    rows: int
    notes: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def open_sheet(spark: SparkSession, path: str, encoding: str | None = None, layout: str | None = None, all_text: bool = False, **options) -> Sheet:
    """Any file that read_any reads, by two scans of delimited text: one for its shape, one for types, dates and rows; a third names rejected lines if there may be some.
    layout: the pattern its dates are written in; without it, dates that could be read two ways stay text and are named."""
    notes, warnings, rows, about = [], [], None, {}
    if path.lower().endswith(OTHERS):
        workbooks = path.lower().endswith(text.WORKBOOKS)
        df = text.read_any(spark, path, **options, **({"about": about} if workbooks else {}))
        notes += about.get("notes", [])
        if path.lower().endswith(".zip"):
            members = [r["member"] for r in text.zip_members(spark, path).orderBy("file", "at").limit(100).collect()]
            opened = next(n for n in members if not n.lower().endswith(text.WORKBOOKS))
            notes += [f"{len(members)} files in the archive: {opened} was opened"] * (len(members) > 1)
    else:
        if encoding:
            try:
                codecs.lookup(encoding)
            except LookupError:
                notes.append(f"unknown encoding {encoding}: read as ISO-8859-1")
                encoding = "ISO-8859-1"
        else:
            encoding = text.detect_encoding(spark, path)
            notes += [f"not UTF-8: read as {encoding}"] * (encoding != "UTF-8")
        df = text.read_text(spark, path, encoding=encoding, all_text=True, about=about, **options)
        notes += about.get("notes", [])
        if about.get("suspect"):
            bad = text.rejected(spark, path).orderBy("file").limit(5).collect()
            warnings += [f"{r['file'].rpartition('/')[2]}: {r['rejected']} lines hold {' or '.join(REASONS[x] for x in r['reasons'])} (line {', '.join(map(str, r['lines']))})" for r in bad]
        if not all_text:
            df, rows, two_ways = typed(df, layout=layout)
            warnings += [f"{n} dates of column {name} could be day or month first: they stay text, name a layout" for name, n in two_ways.items()]
            if layout:
                dated = [f.name for f in df.schema if kind(f.dataType) == "date"]
                notes += [f"dates of {', '.join(dated)} read as {layout}"] * bool(dated)
    rows = df.count() if rows is None else rows
    warnings += [f"{rows} rows: a workbook holds {MOST_ROWS}, it takes {-(-rows // MOST_ROWS)} files"] * (rows > MOST_ROWS)
    warnings += [f"{len(df.columns)} columns: a workbook holds {MOST_COLUMNS}"] * (len(df.columns) > MOST_COLUMNS)
    warnings += ["no rows"] * (rows == 0)
    return Sheet(df, rows, notes, warnings)
