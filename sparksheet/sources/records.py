"""Records of delimited text whose quoted fields hold line breaks, read by as many tasks as the files have splits.

Whether a line begins inside a quoted field depends on all lines before it.  What a line does to that is one of four functions of
inside or outside, told by the line alone; the functions of a split's lines compose to one.  A first pass composes them split by
split, the splits' functions in their order tell each split's state at its beginning, and a second pass joins lines to
records, each split on its own.  Only what a record leaves in several splits is shuffled.

A file whose last quote never ends is read line by line: its records cannot be told (`text.rejected` names it).
Line breaks within a field become a line feed each.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The functions, bit 0: inside after a beginning outside, bit 1: inside after a beginning inside.
ENDS_OUTSIDE, SWAPS, STAYS, ENDS_INSIDE = 0, 1, 2, 3
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
FORM = "file string, block long, line long, kind int, value string"
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3


def _rest(delimiter: str) -> tuple[str, str]:
    """Patterns of the delimiter, and of what stands before the next one."""
    d = "\\Q" + delimiter + "\\E"
    return d, f"(?:(?!{d}).)*+" if len(delimiter) > 1 else f"[^{d}]*+"


def left_open(value: Column, delimiter: str) -> Column:
    """What is left of a line after its closed fields: empty, or from the quote of a field that does not end with the line."""
    d, rest = _rest(delimiter)
    return F.regexp_replace(value, f'(?s)\\G(?:{_QUOTED}{rest}|(?!"|{d}).{rest}|)(?:{d}|\\z)', "")


def stays_open(value: Column, delimiter: str) -> Column:
    """Whether a line that begins outside quotes ends inside."""
    return value.contains('"') & (left_open(value, delimiter) != "")


def fields(value: Column, delimiter: str) -> Column:
    """How many fields a record has: delimiters outside quotes, and one."""
    return F.size(F.split(F.regexp_replace(value, f"(?s){_QUOTED}", ""), _rest(delimiter)[0], -1))


def effect(value: Column, delimiter: str) -> Column:
    """Which of the four functions a line is."""
    d, rest = _rest(delimiter)
    close = f'(?s)^[^"]*+(?:""[^"]*+)*+"{rest}(?:{d}|\\z)'
    outside = F.when(left_open(value, delimiter) != "", 1).otherwise(0)
    inside = F.when(~value.rlike(close), 2).when(left_open(F.regexp_replace(value, close, ""), delimiter) != "", 2).otherwise(0)
    return F.when(~value.contains('"'), STAYS).otherwise(outside + inside).cast("int")


def composed(codes: np.ndarray) -> int:
    """One function of many, in order."""
    fixed = np.flatnonzero((codes == ENDS_OUTSIDE) | (codes == ENDS_INSIDE))
    after = codes[fixed[-1] + 1 :] if len(fixed) else codes
    odd = int((after == SWAPS).sum()) & 1
    return (ENDS_INSIDE if (codes[fixed[-1]] & 1) ^ odd else ENDS_OUTSIDE) if len(fixed) else (SWAPS if odd else STAYS)


def states(codes: np.ndarray, start: int) -> np.ndarray:
    """Whether one is inside after each line."""
    swaps = np.cumsum(codes == SWAPS) & 1
    fixed = (codes == ENDS_OUTSIDE) | (codes == ENDS_INSIDE)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(codes)), -1))
    known = (codes & 1)[last] ^ swaps[last]
    return np.where(last >= 0, known, start) ^ swaps


def lines_of(spark: SparkSession, at: str, delimiter: str) -> DataFrame:
    """file, block, code, value: each split's lines in their order."""
    m = F.col("_metadata")
    return spark.read.text(at).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), effect(F.col("value"), delimiter).alias("code"), "value")


def _by_block(batches):
    """(file, block), batch: batches cut where the split changes."""
    for b in batches:
        file, block = b.column(0), b.column(1).to_numpy()
        names = file.dictionary_encode().indices.to_numpy() if b.num_rows else np.zeros(0, int)
        edges = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi > lo:
                yield (file[lo].as_py(), int(block[lo])), b.slice(lo, hi - lo)


def beginnings(lines: DataFrame) -> tuple[dict[str, tuple[list[int], list[int]]], set[str]]:
    """For each file the blocks after which the state may be another, with the state after them; and the files whose last quote never ends.  One row for a split with quotes over several lines visits the driver."""

    def run(batches):
        now, code = None, STAYS
        for at, b in _by_block(batches):
            if at != now:
                if now:
                    yield now, code
                now, code = at, STAYS
            more = composed(b.column(2).to_numpy())
            code = (more >> (code & 1) & 1) | ((more >> (code >> 1) & 1) << 1)
        if now:
            yield now, code

    def rows(batches):
        for (file, block), code in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([code], pa.int32())], names=["file", "block", "code"])

    held: dict[str, list] = {}
    for r in lines.where(F.col("code") != STAYS).select("file", "block", "code").mapInArrow(rows, "file string, block long, code int").where(F.col("code") != STAYS).collect():
        held.setdefault(r["file"], []).append((r["block"], r["code"]))
    out, broken = {}, set()
    for file, blocks in held.items():
        state, after = 0, []
        for _, code in sorted(blocks):
            state = code >> state & 1
            after.append(state)
        out[file] = ([b for b, _ in sorted(blocks)], after)
        if state:
            broken.add(file)
    return out, broken


def unended(spark: SparkSession, at: str, delimiter: str) -> set[str]:
    """The files whose last quote never ends."""
    return beginnings(lines_of(spark, at, delimiter))[1]


def records(spark: SparkSession, at: str, delimiter: str) -> DataFrame:
    """file, block, line (of the split; the record's first), value: the records of files (a path whose characters are no patterns)."""
    lines = lines_of(spark, at, delimiter)
    known, broken = beginnings(lines)

    def emit(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=["file", "block", "line", "kind", "value"])

    def run(batches):
        now, line, state, open_, began = None, 0, 0, [], None

        def left():
            """What the split before leaves behind."""
            if open_ and state:
                yield emit([(*now, began if began is not None else 0, TAIL if began is not None else MIDDLE, "\n".join(open_))])

        for at, b in _by_block(batches):
            file, block = at
            if at != now:
                yield from left()
                blocks, after = known.get(file, ([], []))
                i = bisect_left(blocks, block)
                now, line, open_, began = at, 0, [], None
                state = after[i - 1] if i and file not in broken else 0
            codes = b.column(2).to_numpy() if file not in broken else np.full(b.num_rows, STAYS)
            after = states(codes, state)
            if not open_ and not state and not after.any():  # every line is a record
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.arange(line, line + b.num_rows)), pa.array(np.full(b.num_rows, WHOLE, np.int32)), b.column(3)], names=["file", "block", "line", "kind", "value"])
                line += b.num_rows
                continue
            found = []
            for value, inside in zip(b.column(3).to_pylist(), after.tolist(), strict=True):
                if not state and not open_:
                    began = line
                open_.append(value)
                state = inside
                if not inside:
                    found.append((file, block, began if began is not None else 0, WHOLE if began is not None else HEAD, "\n".join(open_)))
                    open_ = []
                line += 1
            if found:
                yield emit(found)
        yield from left()

    # Record by record, and what records leave in several splits: these are put together in order, from the one it began in.
    made = lines.mapInArrow(run, FORM)
    parts = made.where(F.col("kind") != WHOLE)
    nth = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("block", "kind"))
    joined = parts.withColumn("nth", nth).groupBy("file", "nth").agg(F.min(F.struct("block", "kind", "line")).alias("first"), F.array_sort(F.collect_list(F.struct("block", "kind", "value"))).alias("parts"))
    joined = joined.select("file", F.col("first.block").alias("block"), F.col("first.line").alias("line"), F.array_join(F.col("parts.value"), "\n").alias("value"))
    return made.where(F.col("kind") == WHOLE).select("file", "block", "line", "value").unionByName(joined)
