"""Delimited text without losing rows: everything is read as text, long rows widen the table, then columns are typed."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import zipfile
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import SheetError, unique_names
from ..functions.convert import lossless
from .records import fields, records, stays_open, unended

DELIMITERS = (",", "\t", ";", "|")
#: Members of archives that are no text.
WORKBOOKS = (".xlsx", ".xlsm", ".xls")


def literal_path(path: str) -> str:
    """A path of which no character is a pattern."""
    return "".join("\\" + c if c in "[]{}*?" else c for c in path)


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that cuts most of the first lines, as quotes have them, into one same number of fields above one; then the one with most fields, then the earlier."""

    def fits(d: str) -> tuple[float, int]:
        widths = Counter(len(cells) for cells in csv.reader(lines, delimiter=d) if cells)
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]), default=(0, 0))
        return (n / sum(widths.values()), width) if width > 1 else (0.0, 0)

    return max(DELIMITERS, key=fits)


def has_header(cells: list[str]) -> bool:
    """Unless a cell of the first row is blank or a number."""
    number = lambda s: s.replace(".", "", 1).replace("-", "", 1).strip().isdigit()
    return bool(cells) and all(c is not None and c.strip() and not number(c) for c in cells)


def detect_encoding(spark: SparkSession, path: str) -> str:
    """By the first lines' bytes (through .gz, .bz2 and .zst): a byte-order mark, valid UTF-8, else windows-1252."""
    rows = spark.read.text(literal_path(path)).select(F.substring(F.col("value").cast("binary"), 1, 1 << 16).alias("b")).limit(500).collect()
    head = b"\n".join(bytes(r["b"]) for r in rows)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16"
    try:
        codecs.getincrementaldecoder("utf-8")().decode(head)
    except UnicodeDecodeError:
        return "windows-1252"
    return "UTF-8"


def decoded(c: Column, encoding: str) -> Column:
    """Binary lines as text.  Spark's own decoder has no windows-1252: that is Latin-1 but for 0x80 to 0x9F."""
    if encoding.lower() not in ("windows-1252", "cp1252"):
        return F.decode(c, encoding)
    low = bytes(range(0x80, 0xA0))
    known = {b: x for b in low if (x := bytes([b]).decode("cp1252", "ignore"))}
    return F.translate(F.decode(c, "ISO-8859-1"), "".join(map(chr, known)), "".join(known.values()))


def read_lines(lines: DataFrame, delimiter: str | None = None, header: bool | None = None, all_text: bool = False) -> DataFrame:
    """A sheet of the one text column `value`, its lines in order of `at`; a field ends with its line."""
    lines = lines.select("at", F.regexp_replace("value", "^\ufeff|\r$", "").alias("value")).where("value <> ''")
    head = [r["value"] for r in lines.orderBy("at").limit(50).collect()]
    delimiter = delimiter or sniff_delimiter(head)
    cells = [x or "" for x in next(csv.reader(head[:1], delimiter=delimiter), [])]
    header = has_header(cells) if header is None else header
    width = lines.agg(F.max(fields(F.col("value"), delimiter))).first()[0] or len(cells)
    names = unique_names([*(cells if header else []), *[""] * (max(width, len(cells)) - (len(cells) if header else 0))])
    if header:
        first = lines.agg(F.min("at")).first()[0]
        lines = lines.where(F.col("at") > F.lit(first)) if first is not None else lines
    df = _cut(lines, names, delimiter)
    return df if all_text else lossless(df)


def _cut(lines: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """The fields of records (value) as text columns."""
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "maxCharsPerColumn": "-1"}
    parsed = lines.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))), options).alias("r"))
    return parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """file, member, at: what the archives hold, in its order; read_zip reads the first text file."""

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/")]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(range(len(names)), pa.int32())], names=["file", "member", "at"])

    return spark.read.format("binaryFile").load(literal_path(path)).select("path", "content").mapInArrow(run, "file string, member string, at int")


def _whole(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """at, value: the lines of files whose encoding has no line splits of its own; one task a file."""
    text = spark.read.format("binaryFile").load(literal_path(path)).select(F.decode("content", encoding).alias("t"))
    return text.select(F.posexplode(F.split("t", "\n")).alias("at", "value"))


def read_zip(spark: SparkSession, path: str, **options) -> DataFrame:
    """The first member of a zip archive that is not a workbook; one task an archive streams its lines."""

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if not n.endswith("/") and not n.lower().endswith(WORKBOOKS)]
                    if not names:
                        raise SheetError("no text file in the archive")
                    with archive.open(names[0]) as f:
                        at = 0
                        while part := list(itertools.islice(f, 2_000)):
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int64()), pa.array([x.rstrip(b"\n") for x in part], pa.binary())], names=["at", "b"])
                            at += len(part)

    raw = spark.read.format("binaryFile").load(literal_path(path)).select("content").mapInArrow(run, "at long, b binary")
    wrong = raw.where(~F.is_valid_utf8(F.col("b").cast("string"))).limit(1).count()
    return read_lines(raw.select("at", decoded(F.col("b"), "windows-1252" if wrong else "UTF-8").alias("value")), **options)


def read_text(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool | None = None, all_text: bool = False, multi_line: bool | None = None, about: dict | None = None) -> DataFrame:
    """Columns named by the header; extra fields of long rows in added columns, short rows filled with null.  encoding None: detected.

    multi_line None: quoted fields go on over line ends where a line leaves one open; False: every field ends with its line.
    about: given notes (what is worth saying about uneven rows) and suspect (whether lines may have to be rejected)."""
    at = literal_path(path)
    encoding = encoding or detect_encoding(spark, path)
    if encoding.upper().startswith("UTF-16"):
        return read_lines(_whole(spark, path, encoding), delimiter, header, all_text)
    if encoding.upper() not in ("UTF-8", "UTF8"):
        raw = spark.read.text(at).select(F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("b"))
        return read_lines(raw.select("at", decoded(F.col("b"), encoding).alias("value")), delimiter, header, all_text)
    head = [r["value"] for r in spark.read.option("encoding", encoding).text(at).limit(50).collect()]
    delimiter = delimiter or sniff_delimiter(head)
    options = {"sep": delimiter, "quote": '"', "escape": '"', "encoding": encoding, "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}
    first = spark.read.options(**options).csv(spark.sparkContext.parallelize(head[:1], 1)).first() if head else None
    cells, body = list(first) if first else [], spark.read.option("encoding", encoding).text(at)
    found = _survey(body, delimiter, len(cells), multi_line is not False)
    over_lines = bool(found["over_lines"])
    if over_lines:
        body = records(spark, at, delimiter).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where("value <> ''")
        top = body.where("block = 0").orderBy("file", "line").select("value").first()
        cells = next(csv.reader(io.StringIO(top[0], newline=""), delimiter=delimiter), []) if top else []
        found = _survey(body, delimiter, len(cells), False)
    header = has_header(cells) if header is None else header
    width = found["width"] or len(cells)
    names = unique_names([*(cells if header else []), *[""] * (max(width, len(cells)) - (len(cells) if header else 0))])
    if about is not None:
        notes = [f"{found['long']} rows have more fields than the first: columns were added, none was dropped"] * bool(found["long"])
        notes += [f"{found['short']} rows have fewer fields than the first: filled with blanks"] * bool(found["short"])
        about |= {"notes": notes + ["quoted fields go on over line ends"] * over_lines, "suspect": bool(found["bad"]) or over_lines}
    if over_lines:
        if header:  # each file's own
            tops = body.where("block = 0").groupBy("file").agg(F.min("line").alias("top"))
            body = body.join(tops, "file", "left").where((F.col("block") > 0) | (F.col("line") > F.coalesce("top", F.lit(-1))))
        df = _cut(body, names, delimiter)
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        df = spark.read.schema(schema).options(**options, header=str(header).lower(), enforceSchema="true").csv(at)
    return df if all_text else lossless(df)


def _survey(body: DataFrame, delimiter: str, width: int, lines: bool) -> dict:
    """By one scan: width (the most fields), long and short (records with more or fewer fields than the first), over_lines (whether a line leaves a field open), bad (records with bytes that are no text)."""
    value = F.col("value")
    n = fields(value, delimiter)
    open_ = stays_open(value, delimiter) if lines else F.lit(False)
    some = value != ""
    return body.agg(F.max(n).alias("width"), F.count(F.when(some & (n > width), 1)).alias("long"), F.count(F.when(some & (n < width), 1)).alias("short"), F.max(open_).alias("over_lines"), F.count(F.when(~F.is_valid_utf8(value), 1)).alias("bad")).first().asDict()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1, each file's own), value: by the lines counted in each file's splits, so no task sees a whole file."""
    m = F.col("_metadata")
    lines = spark.read.text(literal_path(path)).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def rejected(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """file, rejected, lines, reasons for each file with lines that are no text or no records: how many different ones there are, the numbers of
    the first five, and why: bytes that are not UTF-8; where a file's last quote never ends, each line that leaves a field open."""
    lines = numbered_lines(spark, path)
    bad = lines.where(~F.is_valid_utf8("value")).select("file", "line", F.lit("bytes").alias("reason"))
    delimiter = delimiter or sniff_delimiter([r["value"] for r in spark.read.text(literal_path(path)).limit(50).collect()])
    broken = unended(spark, literal_path(path), delimiter)
    if broken:  # files' names, of files that cannot be cut into records
        bad = bad.unionByName(lines.where(F.col("file").isin(*sorted(broken)) & stays_open(F.col("value"), delimiter)).select("file", "line", F.lit("quotes").alias("reason")))
    each = bad.groupBy("file", "line").agg(F.collect_set("reason").alias("reasons"))
    first = each.withColumn("place", F.row_number().over(W.partitionBy("file").orderBy("line"))).where("place <= 5")
    few = first.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    why = each.select("file", F.explode("reasons").alias("reason")).groupBy("file").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    return each.groupBy("file").agg(F.count(F.lit(1)).alias("rejected")).join(few, "file").join(why, "file")


def sniff(spark: SparkSession, path: str, rows: int = 20) -> dict:
    """How read_text would read a file, and its first rows as text: encoding, delimiter, header, columns, sample, notes."""
    encoding = detect_encoding(spark, path)
    sheet = read_text(spark, path, encoding=encoding, all_text=True)
    if encoding.upper().startswith("UTF-16"):
        lines = _whole(spark, path, encoding).orderBy("at").limit(50)
    else:
        lines = spark.read.text(literal_path(path)).limit(50).select(decoded(F.col("value").cast("binary"), encoding).alias("value"))
    head = [r["value"].removeprefix("\ufeff").rstrip("\r") for r in lines.collect() if r["value"]]
    delimiter = sniff_delimiter(head)
    header = has_header(next(csv.reader(head[:1], delimiter=delimiter), []))
    notes = [f"not UTF-8, read as {encoding}"] * (encoding != "UTF-8") + ["no header row: columns are named column1, column2, ..."] * (not header)
    return {"encoding": encoding, "delimiter": delimiter, "header": header, "columns": sheet.columns, "sample": [tuple(r) for r in sheet.limit(rows).collect()], "notes": notes}


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: Parquet, JSON lines, JSON arrays, zip archives, workbooks, or delimited text (.gz, .bz2 and .zst by Spark's codecs)."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(literal_path(path))
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(literal_path(path))
    if low.endswith(".zip"):
        return read_zip(spark, path, **options)
    if low.endswith((".xlsx", ".xlsm")):
        from .workbook import read_workbooks

        return read_workbooks(spark, path, **options)
    if low.endswith(".json"):
        return spark.read.option("multiLine", "true").json(literal_path(path))
    return read_text(spark, path, **options)
