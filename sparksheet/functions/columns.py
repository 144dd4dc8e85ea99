"""Column kinds, text forms and names, as a spreadsheet sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SheetError(ValueError):
    """A request that cannot be answered: unknown column, unknown operation, missing value."""


def kind(data_type: T.DataType) -> str:
    """number, date, boolean or text; anything else counts as text."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)):
        return "date"
    return "boolean" if isinstance(data_type, T.BooleanType) else "text"


def col(df: DataFrame, name: str) -> Column:
    """The column of exactly this name."""
    if name not in df.columns:
        raise SheetError(f"no column {name!r}")
    return F.col("`" + name.replace("`", "``") + "`")


def text_form(df: DataFrame, name: str) -> Column:
    """The column as text; doubles in plain notation with at least one decimal place."""
    c, t = col(df, name), df.schema[name].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
        return F.when(F.abs(c).between(1e-3, 1e15) | (c == 0), plain).otherwise(c.cast("string"))
    return c.cast("string")


def unique_names(names: list[str]) -> list[str]:
    """Header names told apart whatever their case: the first keeps its name, each further one has the next number that makes it free; blank ones become columnN."""
    taken, last = set(), {}

    def free(name: str) -> str:
        key = name.lower()
        if key in taken:
            number = last.get(key, 1) + 1
            while f"{key}_{number}" in taken:
                number += 1
            last[key] = number
            name = f"{name}_{number}"
        taken.add(name.lower())
        return name

    return [free((raw or "").strip() or f"column{place}") for place, raw in enumerate(names, 1)]
