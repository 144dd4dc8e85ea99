"""Sorting, pages and frequent values.

A sheet may carry the hidden column `_row_key`, its rows' places in the files it was read from.  Where it is there, unsorted
pages follow it and it breaks ties of sorted ones; no result shows it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SheetError, col, text_form
from ..scratch import cut, discard
from .predicates import keep

ROW_KEY = "_row_key"
#: Pages that begin further down are looked up in a sorted copy, as tasks would else keep all rows before them.
DEEP = 10_000


def keyed(df: DataFrame) -> DataFrame:
    """A sheet just read from files, with its row key: file and row number where the format numbers its rows (Parquet), else file, split and place in the split."""
    m = F.col("_metadata")
    if "row_index" in df.select(m).schema[0].dataType.names:
        return df.select("*", F.struct(m["file_path"], m["row_index"]).alias(ROW_KEY))
    return df.select("*", F.struct(m["file_path"], m["file_block_start"], F.monotonically_increasing_id().alias("at")).alias(ROW_KEY))


def shown(df: DataFrame) -> DataFrame:
    return df.drop(ROW_KEY)


def select(df: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        raise SheetError("no columns asked for")
    return df.select(*[col(df, n) for n in names])


def sort_keys(df: DataFrame, sort: list[dict], tiebreak: list[str] = ()) -> list[Column]:
    """By several keys, blanks last either way; then by the row key."""
    down = lambda s: str(s.get("direction", "")).lower() in ("desc", "descending", "-1")
    keys = [col(df, s["column"]).desc_nulls_last() if down(s) else col(df, s["column"]).asc_nulls_last() for s in sort or []]
    keys += [col(df, n).asc_nulls_last() for n in tiebreak]
    return keys + [F.asc(ROW_KEY)] * (ROW_KEY in df.columns)


def order(df: DataFrame, sort: list[dict], tiebreak: list[str] = ()) -> DataFrame:
    keys = sort_keys(df, sort, tiebreak)
    return df.orderBy(*keys) if keys else df


def prefix(held: DataFrame, what: Column) -> list[tuple]:
    """For each part `_p` of a table the sum of `what` over the parts before it; None before the first.  One row a part visits the driver."""
    starts, total = [], None
    for r in sorted(held.groupBy("_p").agg(what.alias("n")).collect(), key=lambda r: r["_p"]):
        starts.append((r["_p"], total))
        total = r["n"] if total is None else total + r["n"]
    return starts


@dataclass
class SortedCopy:
    """A table once sorted and written down in parts: `_p` is a row's part, `_m` its place there.  Pages are read from the parts that hold them."""

    table: DataFrame
    starts: list[tuple[int, int]]

    def numbered(self) -> DataFrame:
        """The table with `_at`, each row's position from 0."""
        base = self.table.sparkSession.createDataFrame(self.starts or [(0, 0)], "_p int, _start long")
        return self.table.join(F.broadcast(base), "_p").withColumn("_at", F.col("_start") + F.col("_m")).drop("_p", "_m", "_start")

    def page(self, offset: int, limit: int) -> DataFrame:
        """Part p was written by task p, whose files bear its number: only those of the parts that hold the page are opened."""
        wanted, parts = F.lit(False), []
        for (p, lo), (_, hi) in zip(self.starts, [*self.starts[1:], (0, 1 << 62)], strict=True):
            if lo < offset + limit and hi > offset:
                parts.append(p)
                wanted = wanted | ((F.col("_p") == p) & (F.col("_m") >= offset - lo) & (F.col("_m") < offset + limit - lo))
        folder = "".join("\\" + c if c in "[]{}*?" else c for c in self.table._scratch)
        held = self.table.sparkSession.read.schema(self.table.schema).parquet(*[f"{folder}/part-{p:05d}-*" for p in parts]) if parts else self.table
        return held.where(wanted).coalesce(1).sortWithinPartitions("_p", "_m").drop("_p", "_m")  # a page: 5,000 rows at most


def sorted_copy(df: DataFrame, keys: list[Column]) -> SortedCopy:
    """By a range sort and a count for each of its parts, so that no task sees all rows.  It is written down first: parts must not be dealt anew afterwards."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_m")))
    return SortedCopy(held, [(p, n or 0) for p, n in prefix(held, F.count(F.lit(1)))])


def running(df: DataFrame, keys: list[Column], value: str, out: str) -> DataFrame:
    """df with the running sum of a column in an order: within each part of a sorted copy, and the parts before it."""
    copy = sorted_copy(df, keys)
    kind = copy.table.agg(F.sum(value)).schema[0].dataType.simpleString()
    base = df.sparkSession.createDataFrame(prefix(copy.table, F.sum(F.coalesce(F.col(value), F.lit(0)))) or [(0, None)], f"_p int, _before {kind}")
    inner = F.sum(value).over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, W.currentRow))
    return copy.table.withColumn("_inner", inner).join(F.broadcast(base), "_p").withColumn(out, F.col("_inner") + F.coalesce("_before", F.lit(0).cast(kind))).drop("_p", "_m", "_inner", "_before")


def page(df: DataFrame, offset: int = 0, limit: int = 200, sort: list[dict] = (), filters: list[dict] = (), tiebreak: list[str] = ()) -> DataFrame:
    """One page of the filtered and sorted table; unsorted ones in file order where the row key is there, else in the order of partitions."""
    if offset < 0 or not 1 <= limit <= 5000:
        raise SheetError("offset must be 0 or more, limit 1 to 5000")
    rows = keep(df, filters)
    keys = sort_keys(rows, list(sort), tiebreak)
    if keys and offset > DEEP:
        return shown(sorted_copy(rows, keys).page(offset, limit))
    return shown((rows.orderBy(*keys) if keys else rows).offset(offset).limit(limit))


class Pages:
    """Pages of one table: sorted copies are kept by filters and sort, the `most` used last, so only the first deep page of an order sorts.

    Unsorted pages of Parquet files read by `keyed` are looked up by row numbers: a count of each file's rows, then the page's ranges.
    The table must not change while its pages are read; `close` deletes the copies."""

    def __init__(self, df: DataFrame, most: int = 4):
        self.df, self.most = df, most
        self.copies: dict[str, SortedCopy] = {}
        self.files: list[tuple[str, int]] | None = None

    def page(self, offset: int = 0, limit: int = 200, sort: list[dict] = (), filters: list[dict] = (), tiebreak: list[str] = ()) -> DataFrame:
        """The same rows as page()."""
        if offset < 0 or not 1 <= limit <= 5000:
            raise SheetError("offset must be 0 or more, limit 1 to 5000")
        if not sort and not tiebreak and not filters and (held := self._by_rows(offset, limit)) is not None:
            return shown(held)
        rows = keep(self.df, filters)
        keys = sort_keys(rows, list(sort), tiebreak)
        if not keys or offset <= DEEP:
            return shown((rows.orderBy(*keys) if keys else rows).offset(offset).limit(limit))
        name = repr((list(sort), list(filters), list(tiebreak)))
        copy = self.copies.pop(name, None) or sorted_copy(rows, keys)
        self.copies[name] = copy  # the last used stands last
        while len(self.copies) > self.most:
            discard(self.copies.pop(next(iter(self.copies))).table)
        return shown(copy.page(offset, limit))

    def _by_rows(self, offset: int, limit: int) -> DataFrame | None:
        """A page in file order by each file's row numbers; None if rows have none, or some are missing."""
        if ROW_KEY not in self.df.columns or "row_index" not in self.df.schema[ROW_KEY].dataType.names:
            return None
        at = F.col(ROW_KEY)
        if self.files is None:
            found = self.df.groupBy(at["file_path"].alias("file")).agg(F.count(F.lit(1)).alias("n"), F.max(at["row_index"]).alias("last")).collect()  # one row a file
            self.files = sorted((r["file"], r["n"]) for r in found) if all(r["last"] == r["n"] - 1 for r in found) else []
        start, wanted = 0, F.lit(False)
        for file, n in self.files:
            low, high = max(offset - start, 0), min(offset + limit - start, n)
            if low < high:
                wanted = wanted | ((at["file_path"] == file) & (at["row_index"] >= low) & (at["row_index"] < high))
            start += n
        return self.df.where(wanted).orderBy(at) if self.files else None

    def close(self) -> None:
        discard(*[c.table for c in self.copies.values()])
        self.copies = {}


def counts(df: DataFrame, filters: list[dict] = ()) -> DataFrame:
    """One row beside a page: total_rows, filtered_rows."""
    total, kept = df.agg(F.count(F.lit(1)).alias("total_rows")), keep(df, list(filters)).agg(F.count(F.lit(1)).alias("filtered_rows"))
    return total.join(F.broadcast(kept))


def top_values(df: DataFrame, name: str, limit: int = 12, search: str = "", filters: list[dict] = ()) -> DataFrame:
    """value (text form), n: the most frequent first, ties by value."""
    rows = keep(df, list(filters)).select(text_form(df, name).alias("value"))
    if search:
        rows = rows.where(F.lower("value").contains(search.lower()))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit)


def checklist(df: DataFrame, name: str, limit: int = 1000, search: str = "", filters: list[dict] = ()) -> tuple[DataFrame, bool, int]:
    """The most frequent values, whether there are more, and about how many there are in all."""
    if not 1 <= limit <= 1000:
        raise SheetError("limit must be 1 to 1000")
    values = top_values(df, name, limit + 1, search, filters)
    about = keep(df, list(filters)).agg(F.approx_count_distinct(text_form(df, name))).first()[0]
    return values.limit(limit), values.count() > limit, about
