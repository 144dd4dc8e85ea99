"""Cleaning steps, and recipes of them that can be replayed on another table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import SheetError, col, kind, unique_names
from ..functions.convert import converted
from ..scratch import cut, discard
from .paging import ROW_KEY
from .predicates import delete, keep


def remove_duplicates(df: DataFrame, columns: list[str] = (), keep_last: bool = False, order: list[str] = ()) -> DataFrame:
    """One row for each combination of columns (all if none), the first or last by `order` (without it in file order, by the row key); nulls are equal."""
    names = list(columns) or [c for c in df.columns if c != ROW_KEY]
    places = [col(df, n) for n in order] or [F.col(ROW_KEY) if ROW_KEY in df.columns else F.monotonically_increasing_id()]
    keys = [c.desc_nulls_last() if keep_last else c.asc_nulls_last() for c in places]
    w = W.partitionBy(*[col(df, n) for n in names]).orderBy(*keys)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def _texts(df: DataFrame, columns: list[str]) -> list[str]:
    return list(columns) or [f.name for f in df.schema if kind(f.dataType) == "text"]


def find_replace(df: DataFrame, find: str, replace: str = "", columns: list[str] = (), match_case: bool = False, whole_cell: bool = False, regex: bool = False) -> DataFrame:
    if not find:
        raise SheetError("nothing to find")
    if regex:
        try:
            df.sparkSession._jvm.java.util.regex.Pattern.compile(find)  # the one that will run
        except IllegalArgumentException as e:
            raise SheetError(f"not a pattern: {e}") from e
    pattern = find if regex else "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in find)
    pattern = ("" if match_case else "(?i)") + (f"^(?:{pattern})$" if whole_cell else pattern)
    into = re.sub(r"\\(\d)", r"$\1", replace) if regex else replace.replace("\\", "\\\\").replace("$", "\\$")
    return df.withColumns({n: F.regexp_replace(col(df, n).cast("string"), pattern, into) for n in _texts(df, columns)})


def clean_text(df: DataFrame, columns: list[str], control: bool = True, spaces: bool = True, trim: bool = True, case: str | None = None) -> DataFrame:
    """In this order: control characters go, runs of blanks become one, ends are trimmed, letters change case."""
    if not columns:
        raise SheetError("no columns to clean")
    how = {None: lambda c: c, "upper": F.upper, "lower": F.lower, "proper": F.initcap}
    if case not in how:
        raise SheetError(f"unknown case {case!r}")
    out = {}
    for n in columns:
        c = col(df, n).cast("string")
        c = F.regexp_replace(c, r"[\x00-\x1F\x7F]", "") if control else c
        c = F.regexp_replace(c, r"\s+", " ") if spaces else c
        c = F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+$", "") if trim else c
        out[n] = how[case](c)
    return df.withColumns(out)


def split_column(df: DataFrame, column: str, delimiter: str, into: int = 2, keep_original: bool = True) -> DataFrame:
    """Pieces column_1.. (missing ones null, further ones dropped), names made free."""
    if not delimiter or not 2 <= into <= 32:
        raise SheetError("a delimiter, and 2 to 32 pieces")
    parts = F.split(col(df, column).cast("string"), "\\Q" + delimiter + "\\E")
    taken = unique_names([*df.columns, *[f"{column}_{i + 1}" for i in range(into)]])[len(df.columns) :]
    out = df.withColumns({n: F.get(parts, i) for i, n in enumerate(taken)})
    return out if keep_original else out.drop(column)


def change_type(df: DataFrame, column: str, to: str, keep_original: bool = False, day_first: bool | None = None, layout: str | None = None) -> DataFrame:
    out = df.withColumn(unique_names([*df.columns, f"{column} (original)"])[-1], col(df, column)) if keep_original else df
    return out.withColumn(column, converted(df, column, to, day_first, layout))


def rename(df: DataFrame, column: str, to: str) -> DataFrame:
    col(df, column)
    if not to or to.lower() in [c.lower() for c in df.columns if c != column]:
        raise SheetError(f"name {to!r} is taken or empty")
    return df.withColumnRenamed(column, to)


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    for n in columns:
        col(df, n)
    if not columns or set(columns) == set(df.columns):
        raise SheetError("some columns must go and some stay")
    return df.drop(*columns)


def fill_blanks(df: DataFrame, column: str, value) -> DataFrame:
    """Nulls become the value, which must fit the column's type."""
    c = F.lit(str(value)).try_cast(df.schema[column].dataType) if column in df.columns else col(df, column)
    if df.sparkSession.range(1).select(c.isNull()).first()[0]:
        raise SheetError(f"{value!r} does not fit {column!r}")
    return df.withColumn(column, F.coalesce(col(df, column), c))


STEPS = {"remove_duplicates": remove_duplicates, "find_replace": find_replace, "clean_text": clean_text, "split_column": split_column, "change_type": change_type, "rename": rename, "remove_columns": remove_columns, "fill_blanks": fill_blanks, "keep": keep, "delete": delete}


def apply_recipe(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Ordered steps {op, params}; undo is the recipe less its last step."""
    for s in steps:
        if s.get("op") not in STEPS:
            raise SheetError(f"unknown step {s.get('op')!r}")
        df = STEPS[s["op"]](df, **s.get("params", {}))
    return df


@dataclass
class Version:
    """A table after a step (the first: before any), the written table it is made from, and how many rows it has, once known."""

    df: DataFrame
    base: DataFrame | None
    step: dict | None = None
    rows: int | None = None


class History:
    """A table under cleaning: steps are applied one by one and the last `most` can be undone.

    A version is a plan over an earlier one; every `every` steps one is written down, so that no plan grows long, and the rows of
    the versions since are counted on the way.  A written table is deleted when no version is made from it any more."""

    def __init__(self, df: DataFrame, most: int = 12, every: int = 4):
        self.most, self.every, self.pending = most, every, []
        self.versions = [Version(df, None)]

    @property
    def table(self) -> DataFrame:
        return self.versions[-1].df

    def recipe(self) -> list[dict]:
        """The steps that can be undone, in order."""
        return [v.step for v in self.versions[1:]]

    def apply(self, op: str, **params) -> DataFrame:
        step, last = {"op": op, "params": params}, self.versions[-1]
        made = Version(apply_recipe(last.df, [step]), last.base, step)
        self.versions.append(made)
        self.pending.append(made)
        if len(self.pending) == self.every:
            self._write()
        self._drop([self.versions.pop(0) for _ in range(len(self.versions) - self.most - 1)])
        return self.table

    def undo(self) -> DataFrame:
        if len(self.versions) == 1:
            raise SheetError("nothing to undo")
        gone = self.versions.pop()
        self.pending = [v for v in self.pending if v is not gone]
        self._drop([gone])
        return self.table

    def close(self) -> None:
        """Deletes all that was written; the versions cannot be read after that."""
        gone, self.versions, self.pending = self.versions, [], []
        self._drop(gone)

    def _write(self) -> None:
        """Writes the last version down; the rows after each step since the last time are counted by the same job."""
        df, seen = self.versions[-1 - self.every].df, []
        for v in self.pending:
            seen.append(Observation())
            df = apply_recipe(df, [v.step]).observe(seen[-1], F.count(F.lit(1)).alias("rows"))
        last = self.pending[-1]
        last.df = last.base = cut(df)
        for v, counted in zip(self.pending, seen, strict=True):
            v.rows = counted.get["rows"]
        self.pending = []

    def _drop(self, gone: list[Version]) -> None:
        held = {id(v.base) for v in self.versions}
        for base in {id(v.base): v.base for v in gone if v.base is not None and id(v.base) not in held}.values():
            discard(base)
