"""A folder of text files that differ in encoding, delimiter, header and columns, read by one scan: each file by its own verdict."""

from __future__ import annotations

import codecs
import csv

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SheetError, unique_names
from ..functions.convert import lossless
from ..scratch import cut
from .records import fields
from .text import DELIMITERS, decoded, has_header, literal_path, sniff_delimiter

HEAD = 50
FORM = "file string, encoding string, delimiter string, header boolean, names array<string>"
LATIN = "windows-1252"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at (in order within a block), value."""
    m = F.col("_metadata")
    return spark.read.text(literal_path(path)).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, delimiter, header, names: how each file is to be read.

    One grouped scan of all lines tells whether a file has bytes that are no UTF-8 and how many fields each delimiter would give its
    longest line; its first 50 lines that are not blank, one group a file, choose the delimiter and tell of a header.  Wider
    lines than the first get columns of their own.  Files without lines have no verdict."""
    lines = _lines(spark, path)
    widths = [F.max(fields(F.col("value"), d)).alias(f"w{i}") for i, d in enumerate(DELIMITERS)]
    facts = lines.groupBy("file").agg(F.max(~F.is_valid_utf8("value")).alias("bad"), *widths)
    first = lines.where("block = 0 and trim(value) <> ''").withColumn("n", F.row_number().over(W.partitionBy("file").orderBy("at"))).where(F.col("n") <= HEAD)
    heads = first.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("n", F.col("value").cast("binary").alias("b")))).alias("head"))

    def judge(frames):
        for x in frames:
            out = []
            for r in x.to_dict("records"):
                raw = b"\n".join(bytes(h["b"]) for h in r["head"])
                if raw[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
                    out.append((r["file"], "UTF-16", None, None, None))
                    continue
                encoding = LATIN if r["bad"] else "UTF-8"
                head = [t.rstrip("\r") for t in raw.decode("cp1252" if r["bad"] else "utf-8-sig", "replace").split("\n")]
                delimiter = sniff_delimiter(head)
                cells = next(csv.reader(head[:1], delimiter=delimiter), [])
                header, width = has_header(cells), max(int(r[f"w{DELIMITERS.index(delimiter)}"]), len(cells))
                out.append((r["file"], encoding, delimiter, header, unique_names([*(cells if header else [""] * len(cells)), *[""] * (width - len(cells))])))
            yield pd.DataFrame(out, columns=["file", "encoding", "delimiter", "header", "names"])

    return facts.join(heads, "file").mapInPandas(judge, FORM)


def read_folder(spark: SparkSession, path: str, all_text: bool = False, file_col: str | None = None) -> DataFrame:
    """The rows of all files, columns of one name together (whatever its case), those that a file lacks blank; file_col: a column for the file.

    Fields end with their line.  Files in UTF-16 have no lines that tasks could share: read_text takes them one by one."""
    known = cut(verdicts(spark, path))
    wide = [r["file"] for r in known.where("encoding = 'UTF-16'").select("file").limit(5).collect()]
    if wide:
        raise SheetError(f"files in UTF-16: {', '.join(wide)}")
    # The columns, in the order of their first places, each as most files spell it: bounded by what a table can have.
    spelled = known.select(F.posexplode("names").alias("place", "name")).groupBy(F.lower("name").alias("key"), "name").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    names = [r["name"] for r in spelled.groupBy("key").agg(F.min("place").alias("place"), F.max(F.struct("n", "name"))["name"].alias("name")).orderBy("place", "key").collect()]
    if not names:
        raise SheetError(f"no lines in {path}")
    lines = _lines(spark, path)
    tops = lines.where("block = 0 and trim(value) <> ''").groupBy("file").agg(F.min("at").alias("top"))
    rows = lines.where("trim(value) <> ''").join(known, "file").join(tops, "file", "left").where(~F.col("header") | F.col("top").isNull() | (F.col("at") > F.col("top")) | (F.col("block") > 0))
    value = F.when(F.col("encoding") == LATIN, decoded(F.col("value").cast("binary"), LATIN)).otherwise(F.col("value"))
    rows = rows.select("file", "delimiter", F.transform("names", F.lower).alias("names"), F.regexp_replace(value, "^﻿|\r$", "").alias("value"))
    most = known.agg(F.max(F.size("names"))).first()[0]
    form = ", ".join(f"c{i} string" for i in range(most))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "", "emptyValue": ""}
    parsed = F.coalesce(*[F.when(F.col("delimiter") == d, F.from_csv("value", form, {"sep": d, **options})) for d in DELIMITERS])
    cells = rows.withColumn("r", parsed).select("file", "names", F.array(*[F.col(f"r.c{i}") for i in range(most)]).alias("cells"))
    place = lambda n: F.array_position("names", n.lower()).cast("int") - 1
    df = cells.select(*[F.when(place(n) >= 0, F.get("cells", F.greatest(place(n), F.lit(0)))).alias(n) for n in names], *([F.col("file").alias(file_col)] if file_col else []))
    return df if all_text else lossless(df, names)
